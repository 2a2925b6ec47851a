"""Size distributions and curve fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import caliper_diameter, size_colour
from gridloom.operators import kernels as K
from gridloom.operators.histograms import centre_histogram


def cumulative_sizes(values: DataFrame, column: str = "area", keys: tuple[str, ...] = ()) -> DataFrame:
    """size, n, share: how much of all is at least as large; ties share a value.

    Sizes are counted before the running sum, so it runs over distinct sizes only.
    """
    counts = values.groupBy(*keys, F.col(column).alias("size")).agg(F.count("*").alias("n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return counts.withColumn("share", F.sum("n").over(above) / F.sum("n").over(whole))


def size_histogram(values: DataFrame, column: str = "area", low: int = 20, step: int = 70, high: int = 3500) -> DataFrame:
    """bin, centre, n, colour on centres low, low + step, ... up to high."""
    centres = [float(x) for x in range(low, high + 1, step)]
    return centre_histogram(values, column, centres).withColumn("colour", size_colour("centre"))


def histogram_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """bin, n_a, n_b, difference of two histograms on the same bins."""
    both = a.select("bin", F.col("n").alias("n_a")).join(b.select("bin", F.col("n").alias("n_b")), "bin", "full")
    return both.select("bin", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).withColumn("difference", F.col("n_a") - F.col("n_b"))


def shifted_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """bin, difference: a's count less b's count in the next bin; the last bin takes nought."""
    later = b.select((F.col("bin") - 1).alias("bin"), F.col("n").alias("later"))
    return a.join(later, "bin", "left").select("bin", (F.col("n") - F.coalesce("later", F.lit(0))).alias("difference"))


def triplets(values: DataFrame, column: str = "area", bins: int = 50) -> DataFrame:
    """low, high, n of a size distribution in whole steps: each centre up to the next less one, the last to the maximum."""
    row = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if row["a"] is None:
        return values.sparkSession.createDataFrame([], "low bigint, high bigint, n bigint")
    step = max(1, int((row["b"] - row["a"]) / bins))
    centres = [float(x) for x in range(int(row["a"]), int(row["b"]) + 1, step)]
    hist = centre_histogram(values, column, centres)
    following = F.lead("centre").over(Window.orderBy("bin"))  # one row a bin
    return hist.select(F.col("centre").cast("bigint").alias("low"), F.coalesce(following - 1, F.lit(float(row["b"]))).cast("bigint").alias("high"), "n")


def colour_ticks(low: int, high: int, n: int = 6) -> list[int]:
    """Tick values from low by a truncated step."""
    step = max(1, int((high - low) / max(1, n - 1)))
    return list(range(low, high + 1, step))[:n]


_MODELS = {
    "power": (lambda q, x: q[0] * x ** -q[1], lambda x, y: [x.min(), 1.0], None, None),
    "truncated": (lambda q, x: q[0] * (x ** -q[1] - q[2] ** -q[1]), lambda x, y: [x.min(), 1.0, x.max()], lambda x: [x.min() / 10, 0.0, 1.0], lambda x: [1e6, 1e6, 1e6]),
    "weibull": (lambda q, x: np.exp(-((x / q[1]) ** q[0])), lambda x, y: [1.0, x.mean()], lambda x: [1e-6, 1e-6], None),
}


def fit_curves(points: DataFrame, kinds: tuple[str, ...] = ("power",), key: str = "id") -> DataFrame:
    """key, model, p1, p2, p3, residual, steps: least-squares fits of (x, y) points, one task group per key. The points
    are a distribution's distinct sizes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        rows = []
        for kind in kinds:
            model, start, low, high = _MODELS[kind]
            p, cost, n = K.least_squares(model, start(x, y), x, y, low(x) if low else None, high(x) if high else None)
            p = [*map(float, p), float("nan")][:3]
            rows.append((pdf[key].iloc[0], kind, p[0], p[1], p[2], cost, n))
        return pd.DataFrame(rows, columns=[key, "model", "p1", "p2", "p3", "residual", "steps"])

    return points.select(key, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(key).applyInPandas(run, f"{key} bigint, model string, p1 double, p2 double, p3 double, residual double, steps bigint")


def diameter_analysis(pieces: DataFrame, scale: float, bins: int = 100) -> DataFrame:
    """bin (diameters 1, 2, ...), n_polygon, n_pixel, difference: how many pieces (polygon_area, pixel_area) have each
    equivalent diameter, and polygons of one less pixel pieces of the next."""
    centres = [float(i + 1) for i in range(bins)]
    of = lambda c: centre_histogram(pieces.select(caliper_diameter(c, scale).alias("d")), "d", centres)
    a, b = of("polygon_area"), of("pixel_area")
    both = histogram_difference(a, b).drop("difference")
    return both.join(shifted_difference(a, b), "bin").select("bin", F.col("n_a").alias("n_polygon"), F.col("n_b").alias("n_pixel"), "difference")
