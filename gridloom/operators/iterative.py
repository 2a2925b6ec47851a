"""Fixed points as loops of DataFrame jobs: each round is written to the shared folder, so plans stay short and a lost
executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.morphology import Offsets, dilate, square
from gridloom.sources.shared import stored

KEY = ["image_id", "r", "c"]


def reconstruct_by_steps(marker: DataFrame, mask: DataFrame, se: Offsets | None = None, most: int = 10_000) -> tuple[DataFrame, int]:
    """Reconstruction by dilation as its definition reads: dilate, stay below the mask, until nothing changes.

    The result (image_id, r, c, v) and the rounds taken. For whole images the kernel is faster; this form has no
    limit on an image's size.
    """
    limit = stored(mask.select(*KEY, F.col("v").alias("_limit")), "mask")
    current = stored(marker.select(*KEY, "v"), "marker")
    for n in range(most):
        grown = dilate(current, se or square(3))
        step = stored(grown.join(limit, KEY).select(*KEY, F.least("out", "_limit").alias("v"), F.col("v").alias("_before")), "step")
        done = step.where("v <> _before").isEmpty()
        current = step.select(*KEY, "v")
        if done:
            return current, n
    raise RuntimeError("reconstruction did not settle")


def grow_from_seeds(mask: DataFrame, seeds: DataFrame, se: Offsets | None = None, most: int = 10_000) -> DataFrame:
    """image_id, r, c, step: object pixels reached from seed pixels by constrained dilation, with the round of each.

    Only the last round's front takes part in the next.
    """
    se = se or square(3)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in se]))
    inside = stored(mask.where("v").select(*KEY), "inside")
    reached = stored(seeds.select(*KEY).join(inside, KEY, "left_semi").distinct().withColumn("step", F.lit(0).cast("bigint")), "reached")
    front = reached
    for n in range(1, most):
        moved = front.select(*KEY, offsets.alias("o")).select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
        fresh = stored(moved.join(inside, KEY, "left_semi").join(reached, KEY, "left_anti").withColumn("step", F.lit(n).cast("bigint")), "front")
        if fresh.isEmpty():
            return reached
        reached = stored(reached.unionByName(fresh), "reached")
        front = fresh
    raise RuntimeError("growth did not settle")


def fill_from_seeds(mask: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """image_id, r, c: the object and the holes that seed pixels lie in, filled by constrained dilation with a cross."""
    from gridloom.operators.morphology import diamond

    outside = mask.select(*KEY, (~F.col("v")).alias("v"))
    filled = grow_from_seeds(outside, seeds, diamond(1), most).select(*KEY)
    return mask.where("v").select(*KEY).union(filled).distinct()
