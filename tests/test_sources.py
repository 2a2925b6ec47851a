"""Files in and out, loops, and border cases of the relational operators."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.operators import clustering as C
from gridloom.operators import geometry as G
from gridloom.operators import histograms as H
from gridloom.operators import iterative as I
from gridloom.operators import kernels as K
from gridloom.operators import morphology as M
from gridloom.operators import regions as R
from gridloom.operators import thresholds as T
from gridloom.operators import tiles as TI
from gridloom.sources import documents as D
from gridloom.sources import generated as GE
from gridloom.sources import images as S

RNG = np.random.default_rng(5)


def png(a):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bands(rows, shape):
    out = np.zeros((*shape, 3), int)
    for x in rows:
        out[x.r, x.c] = (x.red, x.green, x.blue)
    return out


def test_png_files(spark, tmp_path):
    colour = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(colour))
    assert (bands(S.read_images(spark, str(tmp_path)).collect(), (5, 7)) == colour).all()


def test_gray_png(spark, tmp_path):
    gray = RNG.integers(0, 256, (4, 6)).astype(np.uint8)
    (tmp_path / "g.png").write_bytes(png(gray))
    assert (bands(S.read_images(spark, str(tmp_path)).collect(), (4, 6)) == gray[..., None]).all()


def test_netpbm(spark, tmp_path):
    for a in (RNG.integers(0, 256, (3, 5)), RNG.integers(0, 256, (3, 5, 3))):
        assert (S.decode_netpbm(S.encode_netpbm(a)) == a).all()
    assert S.decode_netpbm(b"P5 # note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    with pytest.raises(ValueError):
        S.decode_netpbm(b"P2\n1 1\n255\n1")
    px = GE.bimodal(spark, 6, 9)
    content = S.to_netpbm(px).first().content
    (tmp_path / "x.pgm").write_bytes(content)
    back = {(x.r, x.c): x.red for x in S.read_netpbm(spark, str(tmp_path)).collect()}
    assert back == {(x.r, x.c): x.v for x in px.collect()}


def test_video_files(spark, tmp_path):
    frames = RNG.integers(0, 256, (3, 4, 5, 3)).astype(np.uint8)
    data = S.encode_avi(frames, 12.0)
    found, fps = S.decode_avi(data)
    assert (found == frames).all() and fps == 12.0
    (tmp_path / "v.avi").write_bytes(data)
    assert S.video_table(spark, str(tmp_path)).drop("origin").first() == (3, 4, 5, 12.0)
    rows = S.read_videos(spark, str(tmp_path))
    again = S.to_videos(rows.select(F.lit(0).cast("bigint").alias("video_id"), "frame_idx", "r", "c", "red", "green", "blue")).first().content
    assert (S.decode_avi(bytes(again))[0] == frames).all()
    with pytest.raises(ValueError):
        S.decode_avi(b"nothing at all")


def test_documents(spark, tmp_path):
    doc = spark.createDataFrame([(1, [(2, 3.5)])], "image_id bigint, floes array<struct<piece:bigint,area:double>>")
    for form in ("parquet", "json"):
        D.save(doc, str(tmp_path / form), form)
        assert D.load(spark, str(tmp_path / form), doc.schema, form).collect() == doc.collect()
    with pytest.raises(ValueError):
        D.save(doc, str(tmp_path / "x"), "xml")


def image(spark, a, kind="bigint"):
    rows = [(0, int(r), int(c), a[r, c].item()) for r, c in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"image_id bigint, r bigint, c bigint, v {kind}")


def array_of(df, shape, name="v"):
    out = np.zeros(shape, object)
    for x in df.collect():
        out[x.r, x.c] = x[name]
    return out


def test_loops_equal_kernels(spark):
    mask = RNG.integers(0, 9, (7, 9))
    marker = np.maximum(mask - 3, 0)
    found, steps = I.reconstruct_by_steps(image(spark, marker), image(spark, mask))
    assert (array_of(found, mask.shape) == K.reconstruct(marker, mask)).all() and steps >= 0
    blob = RNG.random((8, 8)) < 0.6
    blob[4, 4] = True
    seeds = spark.createDataFrame([(0, 4, 4)], "image_id bigint, r bigint, c bigint")
    grown = {(x.r, x.c) for x in I.grow_from_seeds(image(spark, blob, "boolean"), seeds).collect()}
    labels, _ = K.label(blob, 8)
    assert grown == {tuple(p) for p in np.argwhere(labels == labels[4, 4]).tolist()}


def test_tiled_labels_on_a_spiral(spark):
    a = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        a[k, k : 21 - k] = a[20 - k, k : 21 - k] = True
        a[k : 21 - k, 20 - k] = True
        a[k + 2 : 21 - k, k] = True
    want, n = K.label(a, 4)
    found = R.label_tiled(image(spark, a, "boolean"), 4, 4).collect()
    assert {(x.r, x.c): x.label for x in found} == {tuple(p): want[tuple(p)] for p in np.argwhere(a).tolist()}


def test_empty_and_constant_images(spark):
    empty = image(spark, np.zeros((1, 1), int)).limit(0)
    assert H.gray_histogram(empty).count() == 0 and T.otsu(H.gray_histogram(empty)).count() == 0
    flat = T.otsu(H.gray_histogram(image(spark, np.full((3, 4), 9)))).first()
    assert (flat.threshold, flat.effectiveness) == (0.0, 0.0)
    with pytest.raises(ValueError):
        T.block_otsu(image(spark, np.zeros((3, 4), int)), 3, 4, 2, 2)


def test_histogram_rules(spark):
    values = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, float("nan"), float("inf"), float("-inf"), None)], "x double")
    assert [r.n for r in H.centre_histogram(values, "x", [1.0, 2.0, 3.0]).orderBy("bin").collect()] == [3, 1, 1]
    assert H.equal_centres(4.0, 4.0, 3) == [3.0, 4.0, 5.0] or len(H.equal_centres(4.0, 4.0, 3)) == 3
    many = [float(i) for i in range(1, 101)]
    even = spark.createDataFrame([(i / 7.0,) for i in range(-20, 900)], "x double")
    got = {r.bin: r.n for r in H.centre_histogram(even, "x", many).collect()}
    edges = np.array(H.centre_edges(many))
    want = np.bincount(np.searchsorted(edges, np.arange(-20, 900) / 7.0, side="right"), minlength=100)
    assert [got[i] for i in range(100)] == want.tolist()


def test_structuring_elements():
    assert len(M.diamond(2)) == 13 and len(M.square(2)) == 4 and M.square(2)[0] == (0, 0)
    assert set(M.disk_by_lines(2)) == set(M.disk(2))
    big = M.disk_by_lines(5)
    assert max(i for i, _ in big) == 5 and set(big) == {(-i, -j) for i, j in big}
    assert set(M.octagon(3)) <= set(M.square(7)) and len(M.line(5, 0)) == 5 and len(M.line(1, 45)) == 1
    with pytest.raises(ValueError):
        M.octagon(4)


def test_tiles():
    assert TI.tile_starts(10, 16, 4) == [0] and TI.tile_starts(40, 16, 4) == [0, 12, 24]
    cores = TI.tile_grid(25, 40, 16, 4)
    assert sum(b - a for a, b in {(t[5], t[6]) for t in cores}) == 25 and sum(b - a for a, b in {(t[7], t[8]) for t in cores}) == 40
    with pytest.raises(ValueError):
        TI.tile_starts(10, 4, 4)


def test_number_rules(spark):
    row = spark.range(1).select(*[E.round_half_away(F.lit(x)).alias(f"c{i}") for i, x in enumerate((2.5, -2.5, 0.49999999999999994, -0.5))]).first()
    assert list(row) == [3.0, -3.0, 1.0, -1.0]
    assert spark.range(1).select(E.saturate(F.lit(300.2)), E.saturate(F.lit(-4.0)), E.saturate(F.lit(-40000.0), "int16")).first() == (255, 0, -32768)
    assert spark.range(1).select(E.number_text(F.lit(3.25)), E.number_text(F.lit(7.0)), E.number_text(F.lit(123456.789))).first() == ("3.25", "7", "123456.789")
    assert spark.range(1).select(E.colon(0, 0.1, 0.5)).first()[0] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 0.5])


def test_kmeans_rules(spark):
    a = np.array([[10, 10, 200], [11, 12, 210]])
    rows = C.gray_kmeans(image(spark, a), 2).orderBy("k").collect()
    assert [r.centre for r in rows] == [10.75, 205.0] and [r.n for r in rows] == [4, 2]
    with pytest.raises(Exception, match="empty cluster"):
        C.gray_kmeans(image(spark, np.array([[5, 5, 200]])), 3).collect()


def test_code_strings(spark):
    square = np.zeros((4, 4), bool)
    square[1:3, 1:3] = True
    chain = R.chain_codes(R.contours(R.label_images(image(spark, square, "boolean"))))
    row = R.code_strings(chain).first()
    assert row.code == [0, 6, 4, 2] and row.min_code == [0, 6, 4, 2] and row.reversed == [6, 0, 2, 4]
    back = [(x.r, x.c) for x in R.decoded(chain).orderBy("seq").collect()]
    assert back == [(x.r, x.c) for x in chain.orderBy("seq").collect()]


def test_overlap_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "a_id bigint, b_id bigint")
    assert [tuple(x) for x in G.asymmetric(edges).collect()] == [(3, 1)]
    boxes = spark.createDataFrame([(1, 0, 0, 2, 2), (2, 2, 0, 4, 2), (3, 1, 1, 3, 3)], "box_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    assert sorted(tuple(x) for x in G.box_overlaps(boxes, 1.0).collect()) == [(1, 3), (2, 3)]  # a shared edge is no overlap


def test_mixed_overlaps(spark):
    from gridloom.plans import pieces as P

    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    circle = lambda x, y, r: [(float(x + r * np.cos(0.05 * k)), float(y + r * np.sin(0.05 * k))) for k in range(126)]
    rows = [
        (0, 1, "floe", 2.0, 2.0, None, square(0.0, 0.0, 4.0)),
        (0, 2, "brash", 4.5, 2.0, 1.0, circle(4.5, 2.0, 1.0)),  # over the edge of 1
        (0, 3, "brash", 2.0, 2.0, 0.5, circle(2.0, 2.0, 0.5)),  # within 1
        (0, 4, "floe", 9.0, 9.0, None, square(8.0, 8.0, 2.0)),
        (0, 5, "brash", 5.9, 2.0, 0.5, circle(5.9, 2.0, 0.5)),  # near 2
        (1, 6, "floe", 2.0, 2.0, None, square(0.0, 0.0, 4.0)),  # another image
    ]
    shapes = spark.createDataFrame(rows, "image_id bigint, id bigint, kind string, x double, y double, radius double, ring array<struct<x:double,y:double>>")
    pairs = lambda **kw: sorted((r.a_id, r.b_id) for r in P.overlaps(shapes, 4.0, **kw).collect())
    assert pairs() == [(1, 2), (2, 5)]
    assert pairs(nested=True) == [(1, 2), (1, 3), (2, 5)]
