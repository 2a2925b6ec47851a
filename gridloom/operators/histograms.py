"""Histograms as aggregates: one row per image and bin, empty bins included."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import round_half_away


def gray_histogram(px: DataFrame, bins: int = 256, top: float = 255.0, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, bin, n. Only counts are shuffled; noughts come from the bins of the images that there are."""
    at = F.least(F.lit(bins - 1.0), F.greatest(F.lit(0.0), round_half_away(F.col("v") * (bins - 1) / top))).cast("bigint")
    counts = px.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # at most `bins` entries
    every = whole.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"), "m")
    return every.select(*keys, "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("n"))


def normalized_histogram(px: DataFrame, bins: int = 256) -> DataFrame:
    from pyspark.sql import Window

    return gray_histogram(px, bins).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image_id")))


def channel_histograms(rgb: DataFrame, bins: int = 256) -> DataFrame:
    """image_id, band, bin, n of the three bands in one pass."""
    bands = F.expr("stack(3, 'red', red, 'green', green, 'blue', blue) as (band, v)")
    return gray_histogram(rgb.select("image_id", bands), bins, keys=("image_id", "band"))


def _ulp(x: float) -> float:
    return math.ulp(abs(x))


def centre_edges(centres: list[float]) -> list[float]:
    """Inner edges between given centres, moved up by one unit: a value on an edge counts to the lower bin."""
    middles = [a + (b - a) / 2 for a, b in zip(centres, centres[1:])]
    return [e + _ulp(e) for e in middles]


def equal_centres(low: float, high: float, n: int) -> list[float]:
    if low == high:
        low, high = low - math.floor(n / 2) - 0.5, high + math.ceil(n / 2) - 0.5
    width = (high - low) / n
    return [low + (i + 0.5) * width for i in range(n)]


def bin_of(x: Column, centres: list[float]) -> Column:
    """Index of the bin: how many moved edges x reaches. NaN has none; both infinities fall in the outer bins."""
    edges = centre_edges(centres)
    if not edges:
        return F.when(F.isnan(x) | x.isNull(), None).otherwise(0).cast("bigint")
    step = edges[1] - edges[0] if len(edges) > 1 else 1.0
    even = len(edges) > 8 and step > 0 and all(abs((b - a) - step) < 1e-9 * max(1.0, abs(b)) for a, b in zip(edges, edges[1:]))
    if even:  # start next to the right place, then settle it against the edges themselves
        table = F.array(*[F.lit(float(e)) for e in edges])
        near = F.least(F.lit(len(edges)), F.greatest(F.lit(0), F.floor((F.least(F.greatest(x, F.lit(edges[0] - 1)), F.lit(edges[-1] + step)) - edges[0]) / step).cast("int")))
        at = sum(((near + k < len(edges)) & (near + k >= 0) & (F.try_element_at(table, near + k + 1) <= x)).cast("bigint") for k in (-1, 0, 1))
        found = F.greatest(near - 1, F.lit(0)) + F.coalesce(at, F.lit(0))
        return F.when(F.isnan(x) | x.isNull(), None).otherwise(found.cast("bigint"))
    found = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: x >= e)).cast("bigint")
    return F.when(F.isnan(x) | x.isNull(), None).otherwise(found)


def centre_histogram(values: DataFrame, column: str, centres: list[float]) -> DataFrame:
    """bin, centre, n over given centres; the outer bins are open, NaN and null are in none."""
    spark = values.sparkSession
    counts = values.select(bin_of(F.col(column).cast("double"), centres).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(i, float(c)) for i, c in enumerate(centres)], "bin bigint, centre double")
    return every.join(F.broadcast(counts), "bin", "left").select("bin", "centre", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))  # one row a bin


def equal_histogram(values: DataFrame, column: str, n: int = 10) -> DataFrame:
    """n bins of equal width from the least to the greatest finite value; without any, noughts at 1 to n."""
    x = F.col(column).cast("double")
    row = values.where(~F.isnan(x) & (F.abs(x) < float("inf"))).agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    if row["low"] is None:
        return centre_histogram(values.where("false"), column, [float(i + 1) for i in range(n)])
    return centre_histogram(values, column, equal_centres(row["low"], row["high"], n))
