"""Set and logic operations on masks as point sets and as pixel columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "r", "c"]


def points(mask: DataFrame) -> DataFrame:
    """The object's pixels alone: rows present are the set."""
    return mask.where("v").select(*KEY)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return points(a).union(points(b)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return points(a).join(points(b), KEY, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return points(a).join(points(b), KEY, "left_anti")


def complement(mask: DataFrame) -> DataFrame:
    return mask.where(~F.col("v")).select(*KEY)


def translate(mask: DataFrame, dr: int, dc: int, height: int, width: int) -> DataFrame:
    moved = points(mask).select("image_id", (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"))
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def reflect(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Half a turn about the centre."""
    return points(mask).select("image_id", (height - 1 - F.col("r")).alias("r"), (width - 1 - F.col("c")).alias("c"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two images of the same grid side by side: a and b."""
    left, right = a.select(*KEY, F.col("v").alias("a")), b.select(*KEY, F.col("v").alias("b"))
    return left.join(right, KEY)


def gray_union(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def gray_intersection(a: Column, b: Column) -> Column:
    return F.least(a, b)


def bit_not(v: Column, bits: int = 8) -> Column:
    return F.lit(2**bits - 1) - v


def truth_tables(spark) -> DataFrame:
    """not, or, and of two truth values."""
    rows = spark.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "a boolean, b boolean")
    return rows.select("a", "b", (~F.col("a")).alias("not_a"), (F.col("a") | F.col("b")).alias("a_or_b"), (F.col("a") & F.col("b")).alias("a_and_b"))
