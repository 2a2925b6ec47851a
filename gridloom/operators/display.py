"""What a display shows: gray levels stretched to bytes, labels as colours, and categories on another grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import round_half_away

#: Largest value of a class of pixels; floating ones are shown from 0 to 1.
TOP = {"uint8": 255.0, "uint16": 65535.0, "logical": 1.0, "double": 1.0}


def display_scale(px: DataFrame, kind: str = "uint8", stretch: bool = False, value: str = "v") -> DataFrame:
    """px with ``shown`` (0 to 1): by the range of the pixels' class, or each image's own range (``stretch``; an image
    of one value, or without a finite one, shows nought). NaN stays NaN."""
    v = F.col(value).cast("double")
    if not stretch:
        x = v / TOP[kind]
        clipped = F.when(F.isnan(v), v).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
        return px.withColumn("shown", clipped if kind == "double" else x)
    known = F.when(~F.isnan(v), v)
    ends = px.groupBy("image_id").agg(F.min(known).alias("_low"), F.max(known).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(v - low, high - low)))
    flat = low.isNull() | (high <= low) | F.abs(low).eqNullSafe(float("inf")) | F.abs(high).eqNullSafe(float("inf"))
    return px.join(ends, "image_id").withColumn("shown", F.when(flat, 0.0).when(F.isnan(v), v).otherwise(inside)).drop("_low", "_high")


def display_byte(shown: Column) -> Column:
    """0 to 255; NaN shows nought."""
    return F.when(F.isnan(shown), 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), round_half_away(shown * 255.0)))).cast("bigint")


def jet(at: Column) -> list[Column]:
    """Red, green and blue (0 to 1) of a place from 0 to 1 on the scale from dark blue over green to dark red: each is a
    ramp that rises, stays and falls."""
    ramp = lambda middle: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.5 - F.abs(4.0 * at - middle)))
    return [ramp(3.0), ramp(2.0), ramp(1.0)]


def label_colours(labels: DataFrame, background: tuple[int, int, int] = (0, 0, 0), shuffle: bool = False) -> DataFrame:
    """labels with red, green, blue: each image's labels spread over the colour scale in their order, or, with
    ``shuffle``, in the order of their hash; label 0 has the background's colour."""
    most = labels.groupBy("image_id").agg(F.max("label").alias("_most"))
    place = F.pmod(F.xxhash64("label"), F.col("_most")) if shuffle else F.col("label") - 1
    at = F.coalesce(F.try_divide(place, F.col("_most") - 1), F.lit(0.0))
    colour = [F.when(F.col("label") > 0, display_byte(x)).otherwise(b).cast("bigint").alias(n) for x, b, n in zip(jet(at), background, ("red", "green", "blue"))]
    return labels.join(most, "image_id").select(*labels.columns, *colour)


def resample_categories(px: DataFrame, grid: DataFrame, fill: float = 0.0, value: str = "v") -> DataFrame:
    """The rows of ``grid`` (image_id, u, v_at: a row and a column to look at) with the category of the nearest pixel,
    halves away from nought; outside the image, and where a coordinate is null or NaN, ``fill``."""
    ends = px.groupBy("image_id").agg(F.max("r").alias("_h"), F.max("c").alias("_w"))
    at = grid.join(ends, "image_id", "left")
    inside = F.col("u").between(0, F.col("_h")) & F.col("v_at").between(0, F.col("_w"))
    at = at.withColumns({"_r": F.when(inside, round_half_away(F.col("u"))).cast("bigint"), "_c": F.when(inside, round_half_away(F.col("v_at"))).cast("bigint")})
    known = px.select("image_id", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("category"))
    return at.join(known, ["image_id", "_r", "_c"], "left").select(*grid.columns, F.coalesce("category", F.lit(fill)).alias("category"))
