"""Generated images and videos: integer formulas and hashed noise, the same on every cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, height: int, width: int, images: int = 1) -> DataFrame:
    cell = spark.range(images * height * width)
    return cell.select(F.expr(f"id div {height * width}").alias("image_id"), F.expr(f"(id % {height * width}) div {width}").alias("r"), (F.col("id") % width).alias("c"))


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash of its place."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def normal(*parts: Column | int) -> Column:
    u, v = uniform(*parts, 1), uniform(*parts, 2)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)


def _place() -> list[Column]:
    return [F.col("image_id"), F.col("r"), F.col("c")]


def level(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("bigint")


def bimodal(spark: SparkSession, height: int = 120, width: int = 160, dark: float = 60.0, bright: float = 190.0, sigma: float = 12.0, share: float = 0.4, seed: int = 0) -> DataFrame:
    """Two gray modes: a share of columns is bright."""
    base = F.when(F.col("c") < width * share, bright).otherwise(dark)
    return grid(spark, height, width).withColumn("v", level(base + sigma * normal(*_place(), seed)))


def touching_disks(spark: SparkSession, height: int = 96, width: int = 81, noise: float = 6.0, seed: int = 0) -> DataFrame:
    """Two bright ellipses that touch on a dark ground."""
    inside = F.lit(False)
    for y, x, a, b in ((height * 0.33, width * 0.5, height * 0.19, width * 0.3), (height * 0.67, width * 0.5, height * 0.17, width * 0.26)):
        inside = inside | (F.pow((F.col("r") - y) / a, F.lit(2)) + F.pow((F.col("c") - x) / b, F.lit(2)) <= 1)
    return grid(spark, height, width).withColumn("v", level(F.when(inside, 200.0).otherwise(50.0) + noise * normal(*_place(), seed)))


def u_shape(spark: SparkSession, side: int = 64, thickness: int = 8, margin: int = 8) -> DataFrame:
    r, c = F.col("r"), F.col("c")
    box = r.between(margin, side - margin - 1) & c.between(margin, side - margin - 1)
    hollow = c.between(margin + thickness, side - margin - thickness - 1) & (r < side - margin - thickness)
    return grid(spark, side, side).withColumn("v", box & ~hollow)


def tank(spark: SparkSession, height: int = 60, width: int = 240, cell: int = 12, share: float = 0.8, seed: int = 0, frames: int = 1, drift: int = 2) -> DataFrame:
    """Square floes on a lattice, each there with a given chance; frames drift by whole columns. image_id is the frame."""
    c = F.col("c") + F.col("image_id") * drift
    row, column = F.floor(F.col("r") / cell), F.floor(c / cell)
    present = uniform(row, column, seed) < share
    inner = (F.col("r") % cell >= 1) & (c % cell >= 1)
    return grid(spark, height, width, frames).withColumn("v", level(F.when(present & inner, 205.0).otherwise(55.0) + 6 * normal(*_place(), seed)))


def masks_video(spark: SparkSession, frames: int = 12, height: int = 60, width: int = 80, blank: int | None = None) -> DataFrame:
    """Binary frames of drifting squares; one frame may be blank. frame_idx, r, c, v (0 or 255)."""
    k = F.col("image_id")
    on = (F.pmod(F.col("r") + k, F.lit(20)) < 12) & (F.pmod(F.col("c") + 2 * k, F.lit(25)) < 6 + k % 9)
    if blank is not None:
        on = on & (k != blank)
    return grid(spark, height, width, frames).select(k.alias("frame_idx"), "r", "c", F.when(on, 255).otherwise(0).cast("bigint").alias("v"))


def clusters(spark: SparkSession, n: int = 15, centres: tuple[tuple[float, float], ...] = ((2.5, 2.5), (6.5, 6.5)), spread: float = 0.6, outlier: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """id, f: points about centres, and an outlier if asked for."""
    points = spark.range(n * len(centres))
    k = F.expr(f"id div {n}").cast("int")
    at = lambda axis: F.get(F.array(*[F.lit(float(c[axis])) for c in centres]), k) + spread * normal(F.col("id"), axis, seed)
    out = points.select("id", F.array(at(0), at(1)).alias("f"))
    return out if outlier is None else out.union(spark.createDataFrame([(n * len(centres), list(map(float, outlier)))], "id bigint, f array<double>"))
