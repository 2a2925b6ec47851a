"""Display scaling, label colours, categories on another grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.objects import NEAR8, components
from gridloom.catalog.registry import PX, query, r6
from gridloom.operators import display as D
from gridloom.operators import regions as G
from gridloom.sources import virtual as V

KEY = ["image_id", "r", "c"]


@query("display_bytes", f"WITH {PX}, e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT px.image_id, r, c, round(v / 255.0::DOUBLE, 6) AS plain, CASE WHEN hi > lo THEN CAST(floor(CAST(v - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * 255 + 0.5) AS BIGINT) ELSE 0 END AS stretched FROM px JOIN e ON e.image_id = px.image_id")
def display_bytes(spark, d):
    plain = D.display_scale(V.gray_images(spark, d)).withColumnRenamed("shown", "plain")
    both = D.display_scale(plain, stretch=True)
    return both.select(*KEY, r6(F.col("plain")).alias("plain"), D.display_byte(F.col("shown")).alias("stretched"))


def _ramp(middle: int) -> str:
    return f"CAST(CASE WHEN label = 0 THEN 0 ELSE floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.5::DOUBLE - abs(4.0::DOUBLE * x - {middle}))) + 0.5) END AS BIGINT)"


@query("label_colours", f"{components(NEAR8)}, a AS (SELECT mask.image_id, mask.r, mask.c, coalesce(num.label, 0) AS label FROM mask LEFT JOIN num ON num.image_id = mask.image_id AND num.r = mask.r AND num.c = mask.c), b AS (SELECT a.*, coalesce((label - 1) / nullif(CAST(max(label) OVER (PARTITION BY image_id) - 1 AS DOUBLE), 0), 0) AS x FROM a) SELECT image_id, r, c, label, {_ramp(3)} AS red, {_ramp(2)} AS green, {_ramp(1)} AS blue FROM b")
def label_colours(spark, d):
    return D.label_colours(G.label_images(V.masks(spark, d), 8))


@query("resampled_categories", f"WITH {PX}, g AS (SELECT image_id, r, c, r * 0.75::DOUBLE + c * 0.25::DOUBLE AS u, c * 1.25::DOUBLE - 2 AS w FROM px) SELECT g.image_id, g.r, g.c, coalesce(CAST(q.v // 100 AS DOUBLE), -1.0::DOUBLE) AS category FROM g LEFT JOIN px q ON q.image_id = g.image_id AND g.u BETWEEN 0 AND 24 AND g.w BETWEEN 0 AND 39 AND q.r = floor(g.u + 0.5) AND q.c = floor(g.w + 0.5)")
def resampled_categories(spark, d):
    px = V.gray_images(spark, d)
    kinds = px.select(*KEY, F.expr("v div 100").cast("double").alias("v"))
    grid = px.select(*KEY, (F.col("r") * 0.75 + F.col("c") * 0.25).alias("u"), (F.col("c") * 1.25 - 2).alias("v_at"))
    return D.resample_categories(kinds, grid, -1.0).select(*KEY, "category")
