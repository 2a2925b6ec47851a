"""Resampling: query points join the row of pixels that their kernel reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import keys_kernel, round_half_away
from gridloom.operators.rasters import dealt_by


def _extent(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


REACH = {"nearest": (0,), "bilinear": (0, 1), "bicubic": (-1, 0, 1, 2)}


def _shifted(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def _neighbours(px: DataFrame, reach: tuple[int, ...]) -> DataFrame:
    """image_id, _r, _c, v_i_j, _has: for every place with a pixel in reach, the sum of v at (_r + i, _c + j) and a bit
    for each of them that there is. Columns first, then rows: two small sums, not a row for each pair of offsets."""
    n = len(reach)
    at = lambda k, value: F.sum(F.when(F.col("_k") == k, value))
    spread = F.explode(F.array(*[F.lit(k) for k in range(n)]))
    offset = F.array(*[F.lit(i).cast("bigint") for i in reach])
    along = px.select("image_id", "r", "c", F.col("v").cast("double").alias("v"), spread.alias("_k"))
    along = along.groupBy("image_id", "r", (F.col("c") - F.get(offset, F.col("_k"))).alias("_c"))
    along = along.agg(*[at(k, F.col("v")).alias(f"_{k}") for k in range(n)], F.bit_or(_shifted(F.lit(1), F.col("_k"))).alias("_has"))
    down = along.select("*", spread.alias("_k")).groupBy("image_id", (F.col("r") - F.get(offset, F.col("_k"))).alias("_r"), "_c")
    return down.agg(*[at(i, F.col(f"_{j}")).alias(f"v_{i}_{j}") for i in range(n) for j in range(n)], F.bit_or(_shifted(F.col("_has"), F.col("_k") * n)).alias("_has"))


def _sample(px: DataFrame, q: DataFrame, method: str, border: str, a: float) -> DataFrame:
    """``sample`` of points that know their image's size (h, w)."""
    reach = REACH[method]
    n = len(reach)
    inside = (F.col("y") >= 0) & (F.col("y") <= F.col("h") - 1) & (F.col("x") >= 0) & (F.col("x") <= F.col("w") - 1)
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), (F.col(top) - 1).cast("double"))
    q = q.withColumns({"_in": inside, "_y": clamp(F.col("y").cast("double"), "h"), "_x": clamp(F.col("x").cast("double"), "w")})
    base = round_half_away if method == "nearest" else F.floor
    q = q.withColumns({"_r": base(F.col("_y")).cast("bigint"), "_c": base(F.col("_x")).cast("bigint")})

    kernel = {"nearest": lambda d: F.lit(1.0), "bilinear": lambda d: F.greatest(F.lit(0.0), 1 - F.abs(d)), "bicubic": lambda d: keys_kernel(d, a)}[method]
    offsets = F.array(*[F.lit(i) for i in reach])

    def weights(v: str, floor: str, top: str) -> Column:
        """The weight of the pixel at each offset. What lies off the image counts for the pixel that the border holds there."""
        floor, last = F.col(floor), F.col(top) - 1
        plain = F.transform(offsets, lambda i: kernel(F.col(v) - (floor + i)))
        place = lambda i: F.least(F.greatest(floor + i, F.lit(0)), last)
        own = lambda i: F.aggregate(offsets, F.lit(0.0), lambda s, j: s + F.when(place(j) == floor + i, kernel(F.col(v) - (floor + j))).otherwise(0.0))
        return F.when((floor + reach[0] >= 0) & (floor + reach[-1] <= last), plain).otherwise(F.transform(offsets, own))

    # arrays, as sixteen terms spelled out make a method that the JVM leaves uncompiled
    q = q.select("image_id", "q", "_in", "_r", "_c", weights("_y", "_r", "h").alias("_wy"), weights("_x", "_c", "w").alias("_wx"))
    # the points come from few rows by exploding, which Spark's size estimate doesn't see: it must not broadcast them
    met = q.hint("merge").join(_neighbours(px, reach), ["image_id", "_r", "_c"])
    bits = lambda axis, width: sum((F.when(F.get(F.col(axis), F.lit(k)) != 0, 1 << k * width).otherwise(0) for k in range(n)), F.lit(0))
    # the rows' bits, each times the columns' bits: the pixels that have a weight
    met = met.where((bits("_wy", n) * bits("_wx", 1)).bitwiseAND(F.col("_has")) != 0)

    def weighed(weight: Column, values: Column) -> Column:
        """Sum over the offsets; null where no value is. A weight of nought takes nothing, be the value NaN."""
        terms = F.zip_with(weight, values, lambda w, v: F.when(w != 0, w * v))
        return F.aggregate(terms, F.lit(None).cast("double"), lambda s, t: F.coalesce(s + t, s, t))

    rows = F.array(*[F.array(*[F.col(f"v_{i}_{j}") for j in range(n)]) for i in range(n)])
    met = met.withColumn("out", weighed(F.col("_wy"), F.transform(rows, lambda row: weighed(F.col("_wx"), row))))
    return met.select("image_id", "q", "out" if border == "replicate" else F.when(F.col("_in"), F.col("out")).alias("out"))


def sample(px: DataFrame, queries: DataFrame, method: str = "bilinear", border: str = "null", a: float = -0.5) -> DataFrame:
    """queries (image_id, q, y, x) with ``out``: the image at row y, column x.

    border 'null': points off the lattice have no value; 'replicate': they take the border's. A point meets one row by
    an equal join, which has the 1, 4 or 16 pixels of its kernel; a cubic's outermost pixels replicate the border.
    Pixels that are missing or null add nothing; a point without any has no row, one with nulls alone is null.
    """
    return _sample(px, queries.join(_extent(px), "image_id"), method, border, a)


def target_grid(images: DataFrame, height: int, width: int) -> DataFrame:
    """image_id, q, r, c over every place of an output grid."""
    return _grid_of(images.select("image_id").distinct(), height, width)


def _grid_of(images: DataFrame, height: int, width: int) -> DataFrame:
    """``target_grid`` of one row an image, with its other columns. The rows are dealt first: few images make many points."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    grid = dealt_by(images.withColumn("r", upto(height)), "image_id", "r").withColumn("c", upto(width))
    return grid.select(*images.columns, (F.col("r") * width + F.col("c")).alias("q"), "r", "c")


def warp(px: DataFrame, inverse: Callable[[Column, Column], tuple[Column, Column]], height: int, width: int, method: str = "bilinear", border: str = "null") -> DataFrame:
    """image_id, r, c, out: each output place takes the input at ``inverse(r, c)``, a pair of column expressions."""
    grid = _grid_of(_extent(px), height, width)
    y, x = inverse(F.col("r"), F.col("c"))
    sampled = _sample(px, grid.select("image_id", "h", "w", "q", y.alias("y"), x.alias("x")), method, border, -0.5)
    return sampled.select("image_id", F.expr(f"q div {width}").alias("r"), (F.col("q") % width).alias("c"), "out")


def resize(px: DataFrame, scale: float, height: int, width: int, method: str = "bilinear") -> DataFrame:
    """Pixel centres keep their places: out r comes from (r + 0.5) / scale - 0.5; sizes round up, borders replicate."""
    import math

    h, w = math.ceil(scale * height), math.ceil(scale * width)
    return warp(px, lambda r, c: ((r + 0.5) / scale - 0.5, (c + 0.5) / scale - 0.5), h, w, method, "replicate")
