import re

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash as S


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, ids, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(fps))]


def test_against_brute_force(sample):
    rows = sample.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(fps, brute_components(fps, [r.doc_id for r in rows]))))
    for r in S.near_duplicates(sample).collect():
        assert (r.fp & (1 << 64) - 1, r.component_id) == want[r.doc_id]


@pytest.mark.parametrize("groups", [6, 7, 8])
def test_linked_points_share_a_cell(groups):
    rng = np.random.default_rng(groups)
    for _ in range(200):
        a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        cells = S.grid_cells(np.array([a, b], np.uint64).view(np.int64), groups)
        assert (cells[0] == cells[1]).any()
        x, y = S.embed(np.array([a, b], np.uint64)).astype(int)
        assert np.abs(x - y).sum() <= 4


def test_the_lower_bound_is_the_manhattan_distance():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, 5000)).astype(np.uint64)
    near = a.copy()
    for _ in range(6):
        near ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    for other in (b, near, a):
        bound = np.bitwise_count(S.unary(a) ^ S.unary(other))
        bits = np.bitwise_count(a ^ other)
        assert (bound == np.abs(S.embed(a).astype(int) - S.embed(other).astype(int)).sum(axis=1)).all()
        assert (bound <= bits).all()
        assert (S.linked(a.view(np.int64), other.view(np.int64), 4) == (bits <= 4)).all()


@pytest.mark.parametrize("cell_limit", [4096, 8])
def test_clusters_chains_and_hot_cells(spark, cell_limit):
    """Near copies in a star and a chain, with the cells dealt into blocks and not."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = [base ^ (1 << int(b)) for b in range(40)]
    chain = int(rng.integers(0, 2**62))
    for k in range(12):
        chain ^= 0b1111 << (5 * k)
        fps.append(chain)
    fps += [int(x) for x in rng.integers(0, 2**62, 60)]
    fps = list(dict.fromkeys(fps))
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {r.node: r.root for r in S.components(S.links(distinct, 6, cell_limit=cell_limit)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    assert [found.get(f, f) for f in signed] == brute_components(fps, signed)


def test_odd_rows(odd, no_documents):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, r)
    assert by_id[2].fp == by_id[3].fp == by_id[4].fp == 0
    assert by_id[2].component_id == by_id[4].component_id == 2
    assert by_id[6].component_id == by_id[7].component_id == 6
    assert S.near_duplicates(no_documents).count() == 0
    kept = S.drop_near_duplicates(odd.sparkSession, odd, "")
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 not in ids and ids.count(6) == 1 and ids.count(2) == 1 and 3 not in ids and None in ids


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, n_words, edits):
    words = [f"w{x}" for x in rng.integers(0, 10**6, n_words)]
    other = list(words)
    for at in rng.choice(n_words, edits, replace=False):
        other[at] = f"e{at}"
    return " ".join(words), " ".join(other)


@pytest.mark.parametrize("cell_limit", [4096, 5])
def test_similar_texts(spark, cell_limit):
    rng = np.random.default_rng(8)
    texts = [t for k in range(60) for t in edited(rng, int(rng.integers(150, 400)), int(rng.integers(1, 9)))]
    one, _ = edited(rng, 200, 1)
    texts += [one + f" tail{i}" for i in range(30)]  # a group of near copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [brute_shingles(t) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [(r.a, r.b) for r in S.similar_links(docs, cell_limit=cell_limit).collect()]
    assert all(a < b and alike(a, b) for a, b in links)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(b)] = find(a)
    want = [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)]
    assert np.mean([find(a) == find(b) for a, b in want]) >= 0.9
    assert len({find(i) for i in range(120, 150)}) == 1


def test_sketches_estimate_common_shingles():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    pairs = [edited(rng, 600, e) for e in (0, 5, 20, 60)]
    for a, b in pairs:
        _, sketch, some = S.sketch_column(pa.array([a, b, "", None]))
        x, y = brute_shingles(a), brute_shingles(b)
        assert abs(float(S.likeness(sketch[0], sketch[1])) - len(x & y) / len(x | y)) < 0.12
        assert some.tolist() == [True, True, False, False]


def test_similar_links_of_odd_rows(odd, no_documents):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert {(r.a, r.b) for r in S.similar_links(unique).collect()} == {(6, 7)}
    assert S.similar_links(no_documents).count() == 0


def test_stage_drops_similar_texts_and_keeps_the_rest(spark):
    rng = np.random.default_rng(1)
    a, b = edited(rng, 300, 4)
    c, _ = edited(rng, 300, 1)
    docs = spark.createDataFrame([(5, a), (3, b), (9, c), (None, c + " x"), (11, c)], "doc_id long, text string")
    kept = [r.doc_id for r in S.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in kept if x is not None) == [3, 9]
    assert sorted(r.doc_id for r in S.drop_near_duplicates(spark, docs, "", None).collect() if r.doc_id is not None) in ([3, 5, 9], [3, 9])


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(b)] = find(a)
    return [find(x) for x in range(n)]


def test_similar_texts_of_any_length_are_found(spark):
    """Pairs barely 0.8 alike, from ten words on: their fingerprints may differ in more bits than long texts' do."""
    rng = np.random.default_rng(21)
    texts = []
    while len(texts) < 800:
        a, _ = edited(rng, int(rng.integers(10, 80)), 0)
        b = a.split()
        for k in range(int(rng.integers(1, 4))):
            b[-1 - k] = f"e{k}"
        if 0.8 <= len(brute_shingles(a) & brute_shingles(" ".join(b))) / len(brute_shingles(a) | brute_shingles(" ".join(b))) < 0.9:
            texts += [a, " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = groups_of(len(texts), [(r.a, r.b) for r in S.similar_links(docs).collect()])
    assert np.mean([root[k] == root[k + 1] for k in range(0, len(texts), 2)]) >= 0.995


@pytest.mark.parametrize("cell_limit", [4096, 7])
def test_links_within_a_family_of_texts_that_are_not_quite_alike(spark, cell_limit):
    """The first texts are 0.75 or 0.79 alike to all others of their family; only pairs among the others are alike enough."""
    rng = np.random.default_rng(4)
    texts = []
    for tail, pair_tail in ((57, 32), (47, 42)):  # 0.75 and 0.85, 0.79 and 0.81, of 400 shingles
        base = [f"w{x}" for x in rng.integers(0, 10**6, 404)]
        new = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
        texts += [base[:-tail] + new(tail) for _ in range(20)]
        for _ in range(20):
            b = base[:-tail] + new(tail)
            texts += [b, b[:-pair_tail] + new(pair_tail)]
    texts = [" ".join(x) for x in texts]
    sets = [brute_shingles(t) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) == 40 and 0.74 < len(sets[0] & sets[20]) / len(sets[0] | sets[20]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.a, r.b) for r in S.similar_links(docs, cell_limit=cell_limit).collect()} == want


@pytest.mark.parametrize("similarity", [0.8, None])
def test_rows_without_an_id_or_with_the_same_one_are_no_copies(spark, similarity):
    rng = np.random.default_rng(12)
    texts = [edited(rng, 60, 0)[0] for _ in range(60)]
    ids = [None] * 20 + [7] * 20 + list(range(100, 120))
    rows = [(i, t, "en") for i, t in zip(ids, texts)]
    copies = [(None, texts[0], "en"), (5, texts[1], "de"), (None, texts[25], "en"), (7, texts[26], "en"), (300, texts[45], "en")]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string")
    kept = [(r.doc_id, r.text, r.lang) for r in S.drop_near_duplicates(spark, docs, "", similarity).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != texts[1]] + [(5, texts[1], "de")], key=str)


def test_both_kinds_of_link_join_one_group(spark):
    """The third text is alike to the second alone, which the contract's bits link to the first."""
    rng = np.random.default_rng(30)
    share = lambda a, b: len(brute_shingles(a) & brute_shingles(b)) / len(brute_shingles(a) | brute_shingles(b))
    apart = lambda a, b: bin(brute_fingerprint(a) ^ brute_fingerprint(b)).count("1")
    while True:
        words = [f"w{x}" for x in rng.integers(0, 10**6, 304)]
        a, b, c = (" ".join([*(f"x{k}" for k in range(n)), *words[n : 304 - m], *(f"y{k}" for k in range(m))]) for n, m in ((0, 0), (10, 0), (10, 29)))
        if apart(a, b) <= 4 and min(apart(a, c), apart(b, c)) > 4:
            break
    assert share(b, c) >= 0.8 > share(a, c)
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    assert [r.doc_id for r in S.drop_near_duplicates(spark, docs, "").collect()] == [1]
