"""Distances and k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.histograms import gray_histogram


def vector_distance(a: Column, b: Column, metric: str = "euclidean", inverse: list[list[float]] | None = None) -> Column:
    """Distance of two array columns: euclidean, sqeuclidean, cityblock, chebyshev, cosine, mahalanobis."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    if metric in ("euclidean", "sqeuclidean"):
        square = total(F.transform(diff, lambda x: x * x))
        return F.sqrt(square) if metric == "euclidean" else square
    if metric == "cityblock":
        return total(F.transform(diff, F.abs))
    if metric == "chebyshev":
        return F.array_max(F.transform(diff, F.abs))
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
        size = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
        return 1 - F.try_divide(dot, size(a) * size(b))
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in inverse]
    parts = [F.get(diff, i) * total(F.zip_with(diff, row, lambda x, y: x * y)) for i, row in enumerate(rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.sqrt(out)


def pairwise(left: DataFrame, centres: list[list[float]], feature: str = "f", metric: str = "euclidean", inverse: list[list[float]] | None = None) -> DataFrame:
    """The rows of ``left`` against a fixed set of centres: k (from 0) and distance."""
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("k"), F.array(*[F.lit(float(x)) for x in c]).alias("centre")) for i, c in enumerate(centres)])
    return left.withColumn("_c", F.explode(arr)).select(*left.columns, F.col("_c.k").alias("k"), vector_distance(F.col(feature), F.col("_c.centre"), metric, inverse).alias("distance"))


def nearest(feature: Column, centres: list[list[float]]) -> Column:
    """Struct (d2, k) of the nearest centre, the first among equals."""
    each = [F.struct(vector_distance(feature, F.array(*[F.lit(float(x)) for x in c]), "sqeuclidean").alias("d2"), F.lit(i).cast("bigint").alias("k")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*each))


def lloyd(points: DataFrame, start: list[list[float]], feature: str = "f", max_iter: int = 50, tolerance: float = 0.0) -> tuple[list[list[float]], list[float], int]:
    """Centres, objective by iteration, iterations. An empty cluster keeps its centre; stops once no centre moves more
    than the tolerance. Each round is one aggregate of k rows; the points are never collected."""
    centres, history = [list(map(float, c)) for c in start], []
    dims = len(centres[0])
    for n in range(1, max_iter + 1):
        near = points.select(F.col(feature).alias("f"), nearest(F.col(feature), centres).alias("n"))
        rows = near.groupBy("n.k").agg(F.sum("n.d2").alias("j"), *[F.avg(F.col("f")[i].cast("double")).alias(f"m{i}") for i in range(dims)]).collect()
        fresh = [list(c) for c in centres]
        for row in rows:
            fresh[row["k"]] = [row[f"m{i}"] for i in range(dims)]
        history.append(float(sum(sorted(row["j"] for row in rows))))
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for x, y in zip(centres, fresh))
        centres = fresh
        if moved <= tolerance:
            break
    return centres, history, n


def equal_start(points: DataFrame, k: int, feature: str = "f") -> list[list[float]]:
    """Centres at equal parts of each feature's range."""
    dims = points.select(F.size(feature).alias("n")).first()["n"]
    row = points.agg(*[f(F.col(feature)[i].cast("double")).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    return [[row[f"a{i}"] + (row[f"b{i}"] - row[f"a{i}"]) * (j + 1) / (k + 1) for i in range(dims)] for j in range(k)]


def plus_plus_start(points: DataFrame, k: int, feature: str = "f", seed: int = 0) -> list[list[float]]:
    """k-means++: each next centre by a draw weighted with the squared distance, one aggregate a draw."""
    draw = F.rand(seed)
    first = points.orderBy(F.xxhash64(feature)).limit(1).select(feature).first()[0]
    centres = [[float(x) for x in first]]
    while len(centres) < k:
        weight = nearest(F.col(feature), centres)["d2"]
        key = F.when(weight > 0, F.log(draw + 1e-300) / weight)  # the largest wins: exponential race
        row = points.select(feature, key.alias("key")).agg(F.max_by(feature, "key").alias("f")).first()
        if row["f"] is None:
            break
        centres.append([float(x) for x in row["f"]])
    return centres


def gray_kmeans(px: DataFrame, k: int = 3, max_iter: int = 1000) -> DataFrame:
    """image_id, k (from 0, dark first), centre, n, coverage, mean_gray, iterations.

    Runs on each image's 256-row histogram. Levels count from 1 at the darkest; centres start at equal parts, take
    weighted means, and stop once nothing changes; the first centre wins a tie. An empty cluster raises.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = pdf.sort_values("bin")
        n, g = hist["n"].to_numpy(float), hist["bin"].to_numpy(float)
        seen = n > 0
        low = g[seen].min()
        s, n = g[seen] - low + 1, n[seen]
        mu = np.arange(1, k + 1) * (s.max() + 1) / (k + 1)
        for it in range(1, max_iter + 1):
            own = np.abs(s[:, None] - mu[None, :]).argmin(axis=1)
            mass = np.bincount(own, weights=n, minlength=k)
            if (mass == 0).any():
                raise ValueError("empty cluster")
            fresh = np.bincount(own, weights=n * s, minlength=k) / mass
            if np.array_equal(fresh, mu):
                break
            mu = fresh
        centre = mu + low - 1
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "k": np.arange(k), "centre": centre, "n": mass.astype(np.int64), "coverage": mass / mass.sum(), "iterations": it})

    return gray_histogram(px).groupBy("image_id").applyInPandas(run, "image_id bigint, k bigint, centre double, n bigint, coverage double, iterations bigint")


def gray_labels(px: DataFrame, centres: DataFrame) -> DataFrame:
    """Pixels with the number of their nearest centre, the first on a tie; k centres an image."""
    folded = centres.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "centre"))).alias("m"))
    joined = px.join(folded, "image_id")
    each = F.transform("m", lambda x: F.struct(F.abs(F.col("v") - x["centre"]).alias("d"), x["k"].alias("k")))
    return joined.select("image_id", "r", "c", "v", F.array_min(each)["k"].alias("k"))


def brightest_share(centres: DataFrame, top: int = 1) -> DataFrame:
    """image_id, concentration: the share of the ``top`` brightest clusters."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("centre")))
    return centres.withColumn("rank", rank).groupBy("image_id").agg(F.sum(F.when(F.col("rank") <= top, F.col("coverage")).otherwise(0.0)).alias("concentration"))


def nearest_centre(value: Column, centres: list[float]) -> Column:
    """Index (from 0) of the nearest centre, the first on a tie."""
    return F.array_min(F.array(*[F.struct(F.abs(value - float(c)).alias("d"), F.lit(i).cast("bigint").alias("k")) for i, c in enumerate(centres)]))["k"]
