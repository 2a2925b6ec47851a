"""Per-frame series of videos as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.clustering import brightest_share, gray_kmeans
from gridloom.operators.histograms import gray_histogram
from gridloom.operators.regions import label_images
from gridloom.operators.thresholds import otsu


def as_images(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("frame_idx").alias("image_id"), "r", "c", "v")


def prepared(frames: DataFrame, rows: tuple[int, int], cols: tuple[int, int], box: tuple[int, int, int, int]) -> DataFrame:
    """Blank a box (r0, r1, c0, c1, inclusive) and crop to rows and columns (inclusive): both are plain predicates."""
    blank = F.col("r").between(box[0], box[1]) & F.col("c").between(box[2], box[3])
    inside = F.col("r").between(*rows) & F.col("c").between(*cols)
    return frames.where(inside).withColumn("v", F.when(blank, 0).otherwise(F.col("v")).cast("bigint"))


#: Frames of a block of a running value; the carries between blocks are one row a block.
BLOCK = 4096


def running(series: DataFrame, at: str, column: str, name: str, aggregate=F.sum, later: bool = False, block: int = BLOCK) -> DataFrame:
    """series with ``name``: the aggregate (sum, max or min) of ``column`` from the first row to each (``later``: from
    each row to the last) by rising ``at``.

    Blocks of neighbouring rows run by themselves; what comes before (after) a block is a running value of one row a
    block, joined back, so no task sees all rows.
    """
    blocked = series.withColumn("_block", F.floor(F.col(at) / block))
    own = Window.partitionBy("_block").orderBy(at)
    own = own.rowsBetween(0, Window.unboundedFollowing) if later else own.rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.orderBy("_block").rowsBetween(*((1, Window.unboundedFollowing) if later else (Window.unboundedPreceding, -1)))
    carry = blocked.groupBy("_block").agg(aggregate(column).alias("_of")).select(F.col("_block").alias("_of_block"), aggregate("_of").over(blocks).alias("_carry"))
    both = F.array(F.col("_own"), F.col("_carry"))
    joined = blocked.withColumn("_own", aggregate(column).over(own)).join(carry, F.col("_block").eqNullSafe(F.col("_of_block")), "left")
    total = {F.sum: F.when(F.col("_own").isNull(), F.col("_carry")).otherwise(F.col("_own") + F.coalesce("_carry", F.lit(0))), F.max: F.array_max(both), F.min: F.array_min(both)}
    return joined.withColumn(name, total[aggregate]).drop("_own", "_carry", "_block", "_of_block")


def concentration_series(frames: DataFrame, highest: bool = True, pixels: int | None = None) -> DataFrame:
    """frame_idx, threshold, level_used, n_object, concentration: each frame's Otsu level (or the highest so far),
    the pixels at or above it, over a fixed number of pixels or the frame's own.

    Frames are counted to 256 rows first; the running maximum then sees one row a frame, in blocks.
    """
    hist = gray_histogram(as_images(frames))
    found = otsu(hist).select("image_id", "threshold")
    levels = running(found, "image_id", "threshold", "level_used", F.max) if highest else found.withColumn("level_used", F.col("threshold"))
    counted = hist.join(levels, "image_id").groupBy(F.col("image_id").alias("frame_idx"), "threshold", "level_used")
    total = F.lit(float(pixels)) if pixels else F.sum("n").cast("double")
    return counted.agg(F.sum(F.when(F.col("bin") >= F.col("level_used"), F.col("n")).otherwise(0)).alias("n_object"), total.alias("total")).select("frame_idx", "threshold", "level_used", "n_object", (F.col("n_object") / F.col("total")).alias("concentration"))


def reverse_running(series: DataFrame, column: str = "n_object") -> DataFrame:
    """Adds ``later``: the sum from each frame to the last; one row a frame, in blocks."""
    return running(series, "frame_idx", column, "later", F.sum, later=True)


def cluster_series(frames: DataFrame, k: int = 2, top: int = 1) -> DataFrame:
    """frame_idx, concentration: share of the brightest clusters of each frame."""
    return brightest_share(gray_kmeans(as_images(frames), k), top).withColumnRenamed("image_id", "frame_idx")


def largest_piece(frames: DataFrame, least_area: int = 2, level: int = 127, conn: int = 4) -> DataFrame:
    """frame_idx, largest: the largest component of at least ``least_area`` pixels above the level; null for a frame
    without one."""
    mask = as_images(frames).withColumn("v", F.col("v") > level)
    sizes = label_images(mask, conn).where("label > 0").groupBy("image_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least_area)
    every = frames.select("frame_idx").distinct()
    found = sizes.groupBy(F.col("image_id").alias("frame_idx")).agg(F.max("n").alias("largest"))
    return every.join(found, "frame_idx", "left")


def video_info(frames: DataFrame) -> DataFrame:
    return frames.agg(F.countDistinct("frame_idx").alias("n_frames"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
