"""Overlapping tiles of large images, and three ways to stitch them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tile_starts(length: int, tile: int, overlap: int) -> list[int]:
    """Every tile less overlap; the last one is pulled back to the end."""
    if not 0 <= overlap < tile:
        raise ValueError("the overlap must be less than the tile")
    if length <= tile:
        return [0]
    starts = list(range(0, length - tile, tile - overlap))
    return [*starts, length - tile]


def _spans(length: int, tile: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(from, to, core from, core to): cores part the length at the middle of each overlap."""
    starts = tile_starts(length, tile, overlap)
    ends = [min(length, s + tile) for s in starts]
    cuts = [0, *[(e + s) // 2 for e, s in zip(ends, starts[1:])], length]
    return [(s, e, a, b) for s, e, a, b in zip(starts, ends, cuts, cuts[1:])]


def tile_grid(height: int, width: int, tile: int = 256, overlap: int = 64) -> list[tuple[int, ...]]:
    """(tile, r0, r1, c0, c1, core r0, core r1, core c0, core c1), half-open, by rows of tiles."""
    rows, cols = _spans(height, tile, overlap), _spans(width, tile, overlap)
    return [(i * len(cols) + j, r[0], r[1], c[0], c[1], r[2], r[3], c[2], c[3]) for i, r in enumerate(rows) for j, c in enumerate(cols)]


SCHEMA = "tile bigint, r0 bigint, r1 bigint, c0 bigint, c1 bigint, cr0 bigint, cr1 bigint, cc0 bigint, cc1 bigint"


def tile_table(spark, height: int, width: int, tile: int = 256, overlap: int = 64) -> DataFrame:
    return spark.createDataFrame(tile_grid(height, width, tile, overlap), SCHEMA)


def to_tiles(px: DataFrame, height: int, width: int, tile: int = 256, overlap: int = 64) -> DataFrame:
    """Pixels with each tile that holds them (at most four by the overlap) and whether they are in its core.

    The tiles of a row or column come from arithmetic on r and c alone: no join with a table of tiles.
    """
    rows, cols = _spans(height, tile, overlap), _spans(width, tile, overlap)

    def holding(axis: str, spans: list[tuple[int, int, int, int]]):
        table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(n) for n, x in zip(("a", "b", "x", "y"), s)]) for i, s in enumerate(spans)])
        near = F.greatest(F.lit(0), F.floor((F.col(axis) - tile) / (tile - overlap)).cast("int"))
        some = F.slice(table, near + 1, 2 + -(-tile // (tile - overlap)))  # the few tiles that can reach this far
        tail = F.slice(table, -1, 1)  # the last is pulled back
        return F.filter(F.array_distinct(F.concat(some, tail)), lambda s: (F.col(axis) >= s["a"]) & (F.col(axis) < s["b"]))

    spread = px.withColumn("_i", F.explode(holding("r", rows))).withColumn("_j", F.explode(holding("c", cols)))
    core = (F.col("r") >= F.col("_i.x")) & (F.col("r") < F.col("_i.y")) & (F.col("c") >= F.col("_j.x")) & (F.col("c") < F.col("_j.y"))
    return spread.withColumns({"tile": (F.col("_i.i") * len(cols) + F.col("_j.i")).cast("bigint"), "in_core": core}).drop("_i", "_j")


def stitch(tiled: DataFrame, value: str = "v", how: str = "crop") -> DataFrame:
    """image_id, r, c, value: from the core's tile, the greatest, or the first tile's."""
    if how == "crop":
        return tiled.where("in_core").select("image_id", "r", "c", value)
    if how == "max":
        return tiled.groupBy("image_id", "r", "c").agg(F.max(value).alias(value))
    first = F.row_number().over(Window.partitionBy("image_id", "r", "c").orderBy("tile"))
    return tiled.withColumn("_n", first).where("_n = 1").select("image_id", "r", "c", value)
