"""GIF media, URL rules, the language model, the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import gif_media as M
from gridloom.llm import language_model as L
from gridloom.llm import url_rules as U

# --- GIF ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 300, 576, 766])
@pytest.mark.parametrize("top", [1, 2, 256])
def test_code_streams(n, top):
    pixels = np.random.default_rng(n + top).integers(0, top, (40, n)).astype(np.uint8)
    data, sizes = M.lzw_encode(pixels)
    found, good = M.lzw_decode(data, n)
    assert good.all() and (found == pixels).all()
    for i in range(0, 40, 9):
        assert (M.lzw_decode_any(data[i, : sizes[i]].tobytes(), 8, n) == pixels[i]).all()


def test_broken_streams_are_noticed():
    data, _ = M.lzw_encode(np.arange(200, dtype=np.uint8)[None, :])
    data[0, 40] ^= 0xFF
    found, good = M.lzw_decode(data, 200)
    assert not good[0] or (found[0] != np.arange(200)).any()


@given(st.lists(st.one_of(st.none(), st.text(max_size=400)), max_size=5))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(texts):
    sizes, media = M.media_of(pa.array(texts, pa.string()))
    for t, n, m in zip(texts, sizes, media.to_pylist()):
        raw = (t or "").encode()
        gif = M.parse(m)
        payload = b"".join(p.tobytes() for p in M.pixels_of(gif.frames))
        assert n == len(raw) and payload == raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert b"".join(c[..., 0].tobytes() for _, _, c in M.compose(gif)) == payload


def test_composition_rules():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255])
    gif = M.Gif(4, 2, 0, b"")
    gif.frames = [M.Frame(0, 0, 4, 2, 5, 1, -1, False, palette, 2, b""), M.Frame(1, 0, 2, 1, 7, 2, 0, False, palette, 2, b""), M.Frame(0, 0, 1, 1, 1, 3, -1, False, palette, 2, b""), M.Frame(3, 1, 1, 1, 1, 0, -1, False, palette, 2, b"")]
    shown = M.compose(gif, [np.zeros(8, np.uint8), np.array([0, 1], np.uint8), np.array([2], np.uint8), np.array([1], np.uint8)])
    assert [(s, d) for s, d, _ in shown] == [(0, 5), (5, 7), (12, 1), (13, 1)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown[1][2][0].tolist() == [red, red, green, red]  # the transparent pixel shows what was there
    assert shown[2][2][0].tolist() == [blue, none, none, red]  # cleared by the frame before
    assert shown[3][2].tolist() == [[red, none, none, red], [red, red, red, green]]  # and then restored
    assert M.histogram(shown[3][2])[0b110000] == 5 and M.histogram(shown[3][2]).sum() == 6


def test_interlaced_small_palette_with_clear_codes():
    """A stream of two-bit pixels with a clear code before every pixel, rows in interlaced order."""
    image = np.arange(40).reshape(10, 4) % 4
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, 10, step)]
    bits = []
    for v in image[order].ravel().tolist():
        for code in (4, v):
            bits += [code >> k & 1 for k in range(3)]
    bits += [1, 0, 1]
    data = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    frame = M.Frame(0, 0, 4, 10, 1, 0, -1, True, bytes(12), 2, data)
    assert (M.pixels_of([frame])[0].reshape(10, 4) == image).all()


def test_op8(spark, sample):
    texts = {r.doc_id: r.text.encode() for r in sample.collect()}
    rows = M.op8_gif_media(spark, "/root/testdata/sf0.001").collect()
    features = {}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        own = (r.media_bytes, r.media_sha256, r.feature)
        assert features.setdefault(raw, own) == own
    assert len(rows) == len(texts)


def test_media_of_odd_rows(odd, no_documents):
    kept = M.to_media(odd)
    rows = M.read_media(kept).collect()
    assert len(rows) == odd.count() and [len(r.samples) for r in rows if r.doc_id == 2] == [576]
    assert M.read_media(M.to_media(no_documents)).count() == 0
    frames = M.timed_frames(kept.where("doc_id = 1")).collect()
    assert [(f.frame, f.start, f.duration, f.width, f.height) for f in frames] == [(0, 0, 10, 24, 24)] and sum(frames[0].colour_histogram) == 576


# --- URLs -----------------------------------------------------------------------------------------------------------


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    tail = rest[len(host) :]
    ends = [tail.find(c) for c in "?#" if c in tail]
    return host.translate({c: c + 32 for c in range(65, 91)}), tail[: min(ends)] if ends else tail


def test_hosts_paths_and_fixed_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x", "http://net/", "http://net", "http://xnet/", "http://a.net?x", "https://example.com/de/1#t", "https://example.com/de", "http://b.org/fr/?q", "http://org/fr/", "a://b://c/d", "no", "", None, "://", "http://ÄB.example.net/en/", "http://x.net/\nline", "http://example.net:80/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in U.judge(pages, U.MinedRules()).collect():
        host, path = brute_host_path(r.url)
        fits = [(h + p, v) for h, p, v in U.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *rule)


def test_rules_are_mined_and_matched(spark):
    """Planted: bad.example.org is bad nine times of ten, all else one time of ten, most pages are good."""
    rng = np.random.default_rng(5)
    urls = [f"https://{h}.example.org/{p}/{i}.html" for i, (h, p) in enumerate(zip(rng.choice(["bad", "good", "fine", "well"], 2000), rng.choice(["x", "y"], 2000)))]
    bad = [bool(rng.random() < (0.9 if "//bad." in u else 0.1)) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    mined = U.mine(pages, labels)
    base = {"block": np.mean(bad), "allow": 1 - np.mean(bad)}
    sets = [set(U.tokens_of(u)) for u in urls]
    assert "block" in {v for _, v, _ in mined.rules}  # the rarer verdict has its rules
    for tokens, verdict, lift in mined.rules:  # counted anew, row by row
        hit = [b for s, b in zip(sets, bad) if tokens <= s]
        share = np.mean(hit) if verdict == "block" else 1 - np.mean(hit)
        assert lift == pytest.approx(share / base[verdict]) and lift >= 1.3 and sum(hit) >= 8
    verdicts = {r.page_id: r.verdict for r in U.judge(pages, mined, ()).collect()}
    assert all((verdicts[i] == "block") == ("//bad." in u) for i, u in enumerate(urls))
    assert U.mine(pages, labels.limit(0)).rules == [] and U.judge(pages.limit(0), mined).count() == 0


def test_labels_that_say_nothing_make_no_rules(spark):
    rng = np.random.default_rng(6)
    pages = spark.createDataFrame([(i, f"http://{'abcdefgh'[i % 8]}.example.org/{i % 5}/p.html") for i in range(3000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.75), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    assert U.mine(pages, labels).rules == []


# --- the language model ---------------------------------------------------------------------------------------------


def brute_grams(text):
    """Each symbol with the three before it; white space runs are one space."""
    s = " " * (L.ORDER - 1) + re.sub("[ \\t-\\r]+", " ", text or "")
    return [s[i : i + L.ORDER] for i in range(len(s) - L.ORDER + 1)]


def key(gram):
    return sum(ord(c) * int(f) for c, f in zip(gram, L.FACTORS)) % 2**64


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB C1.é漢😀\n\x0b#", max_size=15)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_symbols_and_grams(texts):
    column = pa.array(texts, pa.string())
    want = [brute_grams(t) for t in texts]
    gram, lengths = L.grams_of(column)
    assert lengths.tolist() == [len(w) for w in want] and gram.tolist() == [key(g) for w in want for g in w]
    got = {}
    for symbols, times in L._counted([column, column]):
        got |= dict(zip(L._strings(symbols).to_pylist(), times.tolist()))
    assert got == {g: 2 * n for g, n in Counter(g for w in want for g in w).items()}


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its textbook recursion, for one gram at a time."""
    orders = {L.ORDER: Counter(g for t in texts for g in brute_grams(t))}
    for k in range(L.ORDER - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    stats = {}
    for k, c in orders.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [np.clip(1 - 2 * y * n[2] / n[1], 0.05, 0.95), np.clip(2 - 3 * y * n[3] / n[2], 0.05, 1.95), np.clip(3 - 4 * y * n[4] / n[3], 0.05, 2.95)]
        else:
            d = [0.5, 0.75, 0.9]
        contexts = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            contexts[g[:-1]][0] += v
            contexts[g[:-1]][1] += d[min(v, 3) - 1]
        stats[k] = (c, d, contexts)

    def p(g):
        if not g:
            return 1 / (len(orders[1]) + 1)
        c, d, contexts = stats[len(g)]
        if g[:-1] not in contexts:
            return p(g[1:])
        total, taken = contexts[g[:-1]]
        v = c.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total + taken / total * p(g[1:])

    return p, sorted(orders[1])


def test_probabilities_and_their_sums(spark, sample):
    docs = sample.orderBy("doc_id").limit(40)
    p, alphabet = brute_model([r.text for r in docs.collect()])
    model = L.learn(docs)
    rng = np.random.default_rng(0)
    seen = [g for r in docs.limit(3).collect() for g in brute_grams(r.text)[:60]]
    asked = {*seen, *("".join(rng.choice([*alphabet, "漢", "~"], L.ORDER)) for _ in range(200))}
    asked |= {c + x for c in [g[:-1] for g in seen[::25]] for x in [*alphabet, "漢"]}
    got = {r.gram: r.p for r in model.probability(spark.createDataFrame([(g,) for g in asked], "gram string")).collect()}
    assert got.keys() == asked
    for g in asked:
        assert got[g] == pytest.approx(p(g), rel=1e-9)
    for c in [g[:-1] for g in seen[::25]]:  # all symbols and one never seen
        assert sum(got[c + x] for x in [*alphabet, "漢"]) == pytest.approx(1, abs=1e-9)


def test_perplexity_of_whole_documents(spark, sample, odd, tmp_path):
    trained = sample.orderBy("doc_id").limit(20)
    p, _ = brute_model([r.text for r in trained.collect()])
    model = L.learn(trained)
    for size in (L.CHUNK_BYTES, 300):  # one chunk a partition, and many
        docs = sample.select("doc_id", "text").orderBy("doc_id").limit(30).union(odd.select("doc_id", "text").where("length(text) < 1000 or text is null"))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{size}")
        docs = spark.read.parquet(f"{tmp_path}/{size}")
        rows = L.perplexity(docs, model, ("doc_id", "text"), size).collect()
        assert len(rows) == docs.count()
        for r in rows:
            grams = brute_grams(r.text)
            assert r.n_symbols == len(grams)
            want = math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None
            assert r.perplexity == (None if want is None else pytest.approx(want, rel=1e-4))


def test_filter_keeps_what_is_labelled(spark, sample):
    ids = sample.where("doc_id % 7 = 1").selectExpr("cast(doc_id as string) doc_id")
    got = L.labelled(sample.withColumn("doc_id", sample.doc_id.cast("string")), ids)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in ids.collect())


def test_other_scripts_are_told_apart(spark, tmp_path):
    """Word salad in a script of its own is as surprising as in ASCII: no code points are folded."""
    rng = np.random.default_rng(3)
    words = ["привет", "мир", "книга", "дорога", "вода", "город"]
    prose = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    junk = ["".join(rng.permutation(list(prose[0])))]
    model = L.learn(spark.createDataFrame([(t,) for t in prose], "text string"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([prose[0], *junk])], "doc_id int, text string")
    rows.write.mode("overwrite").parquet(f"{tmp_path}/docs")
    a, b = sorted(L.perplexity(spark.read.parquet(f"{tmp_path}/docs"), model).collect(), key=lambda r: r.doc_id)
    assert b.perplexity > 3 * a.perplexity


def test_verdicts(spark, odd, no_documents, some_labels, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    rows = {r.doc_id: r for r in L.classify(odd, some_labels).collect()}
    assert not rows[2].kept and not rows[3].kept and rows[9].kept  # nothing to read; too short for a verdict
    assert L.classify(odd, some_labels).count() == odd.count()
    assert L.classify(no_documents, some_labels).count() == 0
    assert all(r.kept == (r.n_symbols > 0) for r in L.classify(odd, some_labels.limit(0)).collect())


def test_junk_goes_and_prose_stays(sample, sample_labels):
    found = L.classify(sample, sample_labels).join(sample_labels, "doc_id").toPandas()
    assert found.loc[found.quality == 1, "kept"].mean() > 0.97
    assert found.loc[found.quality == 0, "perplexity"].median() > found.loc[found.quality == 1, "perplexity"].median()


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, sample):
    import corpus_pipeline as C

    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "personal_data", "packing"]
    docs, seen = sample, []
    for name, stage in C.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == sample.columns
            from gridloom.llm.common import stored

            out = stored(out, "t")
            seen.append(out.count())
            docs = out
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
    assert sample.count() >= seen[0] >= seen[1] >= seen[2] == seen[3] > 0
    assert C.run(spark, "/root/testdata/sf0.001").count() == out.count()


def test_whole_frames_are_composed_by_their_palette():
    """The quick way for frames that cover the canvas gives what composing one by one does."""
    rng = np.random.default_rng(2)
    palette = rng.integers(0, 256, 768, np.uint8).tobytes()
    _, media = M.media_of(pa.array(["some text", "x" * 2000]))
    for m in media.to_pylist():
        gif = M.parse(m)
        for f in gif.frames:
            f.palette = palette
        pixels = M.pixels_of(gif.frames)
        plane, colours = M._composed(gif, pixels)
        canvases = [c for _, _, c in M.compose(gif, pixels)]
        assert plane.tolist() == np.concatenate([c[..., 0].ravel() for c in canvases]).tolist()
        assert colours.tolist() == sum(M.histogram(c) for c in canvases).tolist()


def test_media_are_decoded_from_what_was_written(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "read_media", lambda kept, read=M.read_media: seen.append(kept) or read(kept))
    rows = M.op8_gif_media(spark, "/root/testdata/sf0.001")
    assert len(rows.inputFiles()) and all("/gridloom/media-" in f for f in rows.inputFiles())
    assert seen[0].select("media").where("media is not null").count() == rows.count()


def test_all_tokens_of_a_url_are_mined(spark):
    """URLs of eleven or twelve frequent tokens, all of which are mined."""
    rng = np.random.default_rng(8)
    signal = rng.random(600) < 0.5
    keys = [[f"k{j}" for j in range(12) if (i + j) % 12 < 11] for i in range(600)]
    urls = [f"http://a.example.org/{i}?" + "&".join([*ks, *(["sig"] if s else [])]) for i, (ks, s) in enumerate(zip(keys, signal))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not s), 0) for i, s in enumerate(signal)], "doc_id long, quality int, toxic int")
    mined = U.mine(pages, labels, min_support=0.2)
    assert (frozenset(["query:sig"]), "block") in {(t, v) for t, v, _ in mined.rules}
    assert not [t for t, v, _ in mined.rules if v == "block" and len(t) > 1]  # a pure rule needs no more tokens
