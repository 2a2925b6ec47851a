"""Deterministic images, frames, boxes and sizes on the star-schema tables.

events give gray images of 25 rows and 40 columns: a thousand events each, in the order of their dense id, with
min(255, floor(value)) as the gray level. Incomplete images at the end are left out by ``gray_images``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLUMNS = 25, 40
PIXELS = ROWS * COLUMNS
#: A level that about a tenth of the pixels exceed.
MASK_LEVEL = 110


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell() -> dict[str, Column]:
    e = F.col("event_id")
    return {"image_id": F.expr(f"event_id div {PIXELS}"), "r": F.expr(f"(event_id % {PIXELS}) div {COLUMNS}"), "c": e % COLUMNS}


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c, v (0 to 255)."""
    v = F.least(F.lit(255.0), F.floor("value")).cast("bigint")
    cells = _cell()
    return table(spark, sf_dir, "events").select(*[x.alias(k) for k, x in cells.items()], v.alias("v"))


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c, red, green, blue."""
    e = F.col("event_id")
    cells = _cell()
    red = F.least(F.lit(255.0), F.floor("value")).cast("bigint")
    return table(spark, sf_dir, "events").select(*[x.alias(k) for k, x in cells.items()], red.alias("red"), (e * 7 % 256).alias("green"), (e * 13 % 256).alias("blue"))


def masks(spark: SparkSession, sf_dir: str, level: int = MASK_LEVEL) -> DataFrame:
    """image_id, r, c, v as a boolean."""
    return gray_images(spark, sf_dir).withColumn("v", F.col("v") > level)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray images as frames of one video: frame_idx, ts (first event time), r, c, v."""
    events = table(spark, sf_dir, "events")
    cells = _cell()
    v = F.least(F.lit(255.0), F.floor("value")).cast("bigint")
    return events.select(cells["image_id"].alias("frame_idx"), F.col("ts"), cells["r"].alias("r"), cells["c"].alias("c"), v.alias("v"))


def float_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one image: image_id 0, r by vector, c by place, v as a double."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("image_id"), F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v")).select("image_id", "r", F.col("c").cast("bigint").alias("c"), F.col("v").cast("double").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as boxes: box_id, x0, y0, x1, y1."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("box_id"),
        (p % 100).alias("x0"),
        F.expr("p_partkey div 100").alias("y0"),
        (p % 100 + F.col("p_size") % 5 + 1).alias("x1"),
        (F.expr("p_partkey div 100") + F.col("p_size") % 7 + 1).alias("y1"),
    )


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes 1 to 50 from line quantities."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("area"))


def blob_disks(n_images: int = 4, height: int = 60, width: int = 90) -> list[tuple[int, int, int, int]]:
    """(image, row, column, radius) of the disks of ``blob_images``, by an integer formula."""
    return [(i, (13 + 17 * k + 5 * i) % height, (11 + 23 * k + 7 * i * k) % width, 5 + (3 * k + i) % 6) for i in range(n_images) for k in range(9)]


def blob_images(spark: SparkSession, n_images: int = 4, height: int = 60, width: int = 90) -> DataFrame:
    """Generated masks of overlapping disks on a grid that isn't square."""
    disks = blob_disks(n_images, height, width)
    grid = spark.range(n_images * height * width).select(
        F.expr(f"id div {height * width}").alias("image_id"), F.expr(f"(id % {height * width}) div {width}").alias("r"), (F.col("id") % width).alias("c")
    )
    inside = F.lit(False)
    for i, y, x, radius in disks:
        inside = inside | ((F.col("image_id") == i) & ((F.col("r") - y) * (F.col("r") - y) + (F.col("c") - x) * (F.col("c") - x) <= radius * radius))
    return grid.withColumn("v", inside)
