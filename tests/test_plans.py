"""Plans in blocks and tiles give what the plain form gives."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.operators import resample as R
from gridloom.operators.regions import label_images, label_tiled
from gridloom.operators.thresholds import class_table
from gridloom.plans.frames import running


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("how", [F.sum, F.max, F.min])
def test_running_in_blocks(spark, how, later):
    values = [(i, v) for i, v in zip([0, 1, 2, 5, 6, 7, 8, 14, 15, 40], [None, 4, -1, None, 9, 2, 2, 0, None, 5])]
    found = running(spark.createDataFrame(values, "at bigint, x bigint"), "at", "x", "out", how, later, block=3).orderBy("at").collect()
    plain = {F.sum: sum, F.max: max, F.min: min}[how]
    for k, row in enumerate(found):
        seen = [v for _, v in (values[k:] if later else values[: k + 1]) if v is not None]
        assert row["out"] == (plain(seen) if seen else None)


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], "at bigint, x bigint"), "at", "x", "out").collect() == []


def test_tiles_join_a_long_component(spark):
    rows = np.zeros((12, 12), bool)
    rows[::2] = True
    rows[1::4, -1] = rows[3::4, 0] = True  # one snake
    other = np.zeros((12, 12), bool)
    other[0, 0] = other[5, 5:8] = other[11, 11] = True  # pieces that no seam or one seam meets
    px = [(k, r, c, bool(a[r, c])) for k, a in enumerate((rows, other)) for r, c in itertools.product(range(12), range(12))]
    mask = spark.createDataFrame(px, "image_id bigint, r bigint, c bigint, v boolean")
    tiled = {tuple(x) for x in label_tiled(mask, 4).collect()}
    plain = {tuple(x) for x in label_images(mask).where("label > 0").select("image_id", "r", "c", "label").collect()}
    assert tiled == plain


def test_class_table_of_levels(spark):
    px = spark.createDataFrame([(0, 3), (0, 3), (0, 9), (1, 9)], "image_id bigint, v bigint")
    label = F.when(F.col("v") > 5, 2).otherwise(1).cast("bigint")
    levels = px.groupBy("image_id", "v").agg(F.count("*").alias("pixels"))
    plain = class_table(px, label, 3).orderBy("image_id", "class").collect()
    assert plain == class_table(levels, label, 3, F.col("pixels")).orderBy("image_id", "class").collect()
    assert [tuple(x)[1:] for x in plain if x["image_id"] == 1] == [(1, 0.0, None), (2, 1.0, 9.0), (3, 0.0, None)]


def _sampled(px, points, reach, kernel, h, w):
    """Tap by tap: the sum over the pixels there are of weight times value, borders replicated."""
    out = {}
    for q, y, x in points:
        y, x = min(max(y, 0.0), h - 1.0), min(max(x, 0.0), w - 1.0)
        taps = [(min(max(int(y) + i, 0), h - 1), min(max(int(x) + j, 0), w - 1), kernel(y - int(y) - i) * kernel(x - int(x) - j)) for i in reach for j in reach]
        met = [(px[r, c], k) for r, c, k in taps if k and (r, c) in px]
        if met:
            values = [v * k for v, k in met if v is not None]
            out[q] = round(sum(values), 9) + 0.0 if values else None
    return out


@pytest.mark.parametrize("method", ["bilinear", "bicubic"])
def test_sampling_tap_by_tap(spark, method):
    """Holes, nulls, borders and points off the lattice."""
    keys = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    reach, kernel = ((0, 1), lambda d: max(0.0, 1 - abs(d))) if method == "bilinear" else ((-1, 0, 1, 2), lambda d: keys(abs(d)))
    px = {(r, c): float((7 * r + 13 * c) % 11) for r in range(6) for c in range(5) if (5 * r + c) % 4} | {(2, 2): None, (5, 4): 3.0}
    points = [(k, (k % 17) * 0.5 - 1, (k % 13) * 0.375 - 0.5) for k in range(17 * 13)]
    pixels = spark.createDataFrame([(0, r, c, v) for (r, c), v in px.items()], "image_id long, r long, c long, v double")
    queries = spark.createDataFrame([(0, *p) for p in points], "image_id long, q long, y double, x double")
    found = {r.q: None if r.out is None else round(r.out, 9) + 0.0 for r in R.sample(pixels, queries, method, "replicate").collect()}
    assert found == pytest.approx(_sampled(px, points, reach, kernel, 6, 5))


def test_exploded_points_are_never_broadcast(spark, tmp_path):
    """Their estimated size is that of the few images they come from; as a broadcast they filled the driver."""
    spark.range(2000).selectExpr("id as event_id", "cast(id % 256 as double) as value").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("resize_nearest", "resize_bilinear", "resize_bicubic"):
        df = catalog.queries()[name](spark, str(tmp_path))
        assert len(df.collect()) == 2 * 38 * 60
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_segments_cross_in_blocks(spark, monkeypatch):
    """Copies of a segment keep all their pairs, over several blocks of ids; an id's copies give a crossing once."""
    from gridloom.operators import geometry as G

    monkeypatch.setattr(G, "BLOCK", 4)
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    level = spark.createDataFrame([(k, 0.0, 1.0, 3.0, 1.0) for k in range(11)] + [(50, 0.0, 9.0, 3.0, 9.0)], schema)
    upright = spark.createDataFrame([(k, 0.5 + k % 2, 0.0, 0.5 + k % 2, 2.0) for k in range(100, 118)] + [(100, 0.5, 0.0, 0.5, 2.0)], schema)
    plain = {(a, b, 0.5 + b % 2, 1.0) for a in range(11) for b in range(100, 118)}
    once = [tuple(r) for r in G.segment_crossings(level, upright, 4.0).collect()]
    assert len(once) == len(plain) and set(once) == plain
    every = G.segment_crossings(level, upright, 4.0, distinct=False)
    assert every.count() == len(plain) + 11
    assert "Aggregate [a_id" not in every._jdf.queryExecution().optimizedPlan().toString()
