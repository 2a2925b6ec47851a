"""Colours, histograms, thresholds, classes, clusters, distances, sizes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.catalog.registry import HIST, OTSU, PX, RGB, RUN, query, r6, rounded
from gridloom.functions import expr as E
from gridloom.operators import clustering as C
from gridloom.operators import distributions as D
from gridloom.operators import histograms as H
from gridloom.operators import thresholds as T
from gridloom.sources import virtual as V

KEY = ["image_id", "r", "c"]
GRAY = "CAST(least(255, greatest(0, floor(red * 0.298936021293775 + green * 0.587043074451121 + blue * 0.114020904255103 + 0.5))) AS BIGINT)"
GRAY = GRAY.replace("0.298936021293775", "CAST('0.298936021293775' AS DOUBLE)").replace("0.587043074451121", "CAST('0.587043074451121' AS DOUBLE)").replace("0.114020904255103", "CAST('0.114020904255103' AS DOUBLE)")


@query("rgb_to_gray", f"WITH {RGB} SELECT image_id, r, c, {GRAY} AS gray FROM rgb")
def rgb_to_gray(spark, d):
    return V.colour_images(spark, d).select(*KEY, E.gray("red", "green", "blue").alias("gray"))


@query("rgb_to_cmy", f"WITH {RGB} SELECT image_id, r, c, round(1 - red / 255.0::DOUBLE, 6) AS cyan, round(1 - green / 255.0::DOUBLE, 6) AS magenta, round(1 - blue / 255.0::DOUBLE, 6) AS yellow FROM rgb")
def rgb_to_cmy(spark, d):
    return V.colour_images(spark, d).select(*KEY, *[r6(E.cmy(E.to_unit(b))).alias(n) for b, n in (("red", "cyan"), ("green", "magenta"), ("blue", "yellow"))])


@query("rgb_to_cmyk", f"WITH {RGB}, u AS (SELECT image_id, r, c, 1 - red / 255.0::DOUBLE AS x, 1 - green / 255.0::DOUBLE AS y, 1 - blue / 255.0::DOUBLE AS z FROM rgb) SELECT image_id, r, c, round(x - least(x, y, z), 6) AS cyan, round(y - least(x, y, z), 6) AS magenta, round(z - least(x, y, z), 6) AS yellow, round(least(x, y, z), 6) AS black FROM u")
def rgb_to_cmyk(spark, d):
    parts = E.cmyk(E.to_unit("red"), E.to_unit("green"), E.to_unit("blue"))
    return V.colour_images(spark, d).select(*KEY, *[r6(x).alias(n) for n, x in parts.items()])


@query("rgb_to_hsi", f"WITH {RGB}, u AS (SELECT image_id, r, c, red / 255.0::DOUBLE AS x, green / 255.0::DOUBLE AS y, blue / 255.0::DOUBLE AS z FROM rgb), w AS (SELECT *, (-x - y + 2 * z) / sqrt(6.0::DOUBLE) AS a, (x - y) / sqrt(2.0::DOUBLE) AS b FROM u) SELECT image_id, r, c, round(atan2(b, a), 6) + 0.0 AS hue, round(sqrt(a * a + b * b), 6) AS saturation, round((x + y + z) / 3.0::DOUBLE, 6) AS intensity FROM w")
def rgb_to_hsi(spark, d):
    parts = E.hsi(E.to_unit("red"), E.to_unit("green"), E.to_unit("blue"), full_circle=True)
    return V.colour_images(spark, d).select(*KEY, *[r6(x).alias(n) for n, x in parts.items()])


@query("indexed_to_rgb", f"WITH {PX} SELECT image_id, r, c, least(v // 16, 15) * 17 AS red, 255 - least(v // 16, 15) * 17 AS green, (least(v // 16, 15) * 5) % 256 AS blue FROM px")
def indexed_to_rgb(spark, d):
    palette = F.array(*[F.struct(F.lit(i * 17).cast("bigint").alias("red"), F.lit(255 - i * 17).cast("bigint").alias("green"), F.lit(i * 5 % 256).cast("bigint").alias("blue")) for i in range(16)])
    index = F.least(F.expr("v div 16"), F.lit(15)).cast("int")
    return V.gray_images(spark, d).withColumn("p", F.get(palette, index)).select(*KEY, "p.red", "p.green", "p.blue")


@query("class_conversions", f"WITH {PX} SELECT image_id, r, c, round(v / 255.0::DOUBLE, 6) AS unit, 255 - v AS complement, CAST(least(255, floor(v * 1.7::DOUBLE + 0.5)) AS BIGINT) AS brighter, CAST(greatest(0, v - 100) AS BIGINT) AS darker, 255 - v AS bit_not, v & 15 AS low_bits, v | 128 AS with_top FROM px")
def class_conversions(spark, d):
    from gridloom.operators.sets import bit_not

    v = F.col("v")
    return V.gray_images(spark, d).select(*KEY, r6(E.to_unit("v")).alias("unit"), E.complement("v").alias("complement"), E.saturate(v * 1.7).alias("brighter"), E.saturate((v - 100).cast("double")).alias("darker"), bit_not(v).alias("bit_not"), v.bitwiseAND(15).alias("low_bits"), v.bitwiseOR(128).alias("with_top"))


@query("round_half_away", "SELECT p_partkey AS id, CAST(sign((p_size - 25) / 2.0::DOUBLE) * floor(abs((p_size - 25) / 2.0::DOUBLE) + 0.5) AS BIGINT) AS rounded FROM part")
def round_half_away(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), E.round_half_away((F.col("p_size") - 25) / 2.0).cast("bigint").alias("rounded"))


@query("number_text", "SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS text FROM part")
def number_text(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), E.number_text("p_size").alias("text"))


@query("uneven_illumination", f"WITH {PX} SELECT image_id, r, c, CAST(least(255, greatest(0, floor(v * (0.5 + c / 78.0::DOUBLE) + 20 + 0.5))) AS BIGINT) AS lit FROM px")
def uneven_illumination(spark, d):
    ramp = F.lit(0.5) + F.col("c") / (2 * (V.COLUMNS - 1.0))
    return V.gray_images(spark, d).select(*KEY, E.saturate(F.col("v") * ramp + 20).alias("lit"))


# --- histograms -----------------------------------------------------------------------------------------------------


@query("gray_histogram", f"WITH {HIST} SELECT image_id, bin, n FROM hist")
def gray_histogram(spark, d):
    return H.gray_histogram(V.gray_images(spark, d))


@query("normalized_histogram", f"WITH {HIST} SELECT image_id, bin, n, round(n / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE), 6) AS p FROM hist")
def normalized_histogram(spark, d):
    return rounded(H.normalized_histogram(V.gray_images(spark, d)), "p")


@query("channel_histograms", f"WITH {RGB}, l AS (SELECT image_id, 'red' AS band, red AS v FROM rgb UNION ALL SELECT image_id, 'green', green FROM rgb UNION ALL SELECT image_id, 'blue', blue FROM rgb), k AS (SELECT DISTINCT image_id, band FROM l) SELECT k.image_id, k.band, b.bin, CAST(count(l.v) AS BIGINT) AS n FROM k CROSS JOIN (SELECT range AS bin FROM range(0, 256)) b LEFT JOIN l ON l.image_id = k.image_id AND l.band = k.band AND l.v = b.bin GROUP BY 1, 2, 3")
def channel_histograms(spark, d):
    return H.channel_histograms(V.colour_images(spark, d))


@query("centre_histogram", "SELECT b.range AS bin, CAST(1 + 5 * b.range AS DOUBLE) AS centre, CAST(count(l.l_quantity) AS BIGINT) AS n FROM range(0, 10) b LEFT JOIN lineitem l ON l.l_quantity > CASE WHEN b.range = 0 THEN -1 ELSE 5 * b.range - 1.5 END AND l.l_quantity <= CASE WHEN b.range = 9 THEN 1000 ELSE 5 * b.range + 3.5 END GROUP BY 1")
def centre_histogram(spark, d):
    return H.centre_histogram(V.sizes(spark, d), "area", [1.0 + 5 * i for i in range(10)])


@query("equal_histogram", "WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT k.range AS bin, round(max(e.a) + (k.range + 0.5) * (max(e.b) - max(e.a)) / 10, 4) AS centre, CAST(count(o.o_totalprice) AS BIGINT) AS n FROM range(0, 10) k CROSS JOIN e LEFT JOIN orders o ON (o.o_totalprice > e.a + k.range * (e.b - e.a) / 10 OR k.range = 0) AND (o.o_totalprice <= e.a + (k.range + 1) * (e.b - e.a) / 10 OR k.range = 9) GROUP BY 1")
def equal_histogram(spark, d):
    return rounded(H.equal_histogram(V.table(spark, d, "orders"), "o_totalprice", 10), "centre", digits=4)


# --- thresholds -----------------------------------------------------------------------------------------------------


@query("otsu_threshold", f"WITH {OTSU} SELECT image_id, threshold, round(threshold / 255.0::DOUBLE, 6) AS level, round(effectiveness, 6) AS effectiveness FROM otsu")
def otsu_threshold(spark, d):
    return rounded(T.otsu(H.gray_histogram(V.gray_images(spark, d))), "level", "effectiveness")


@query("otsu_curves", f"WITH {RUN} SELECT image_id, t, round(w / total, 6) AS p0, round((total - w) / total, 6) AS p1, CASE WHEN w > 0 THEN round(m / w - 1, 6) + 0.0 END AS mean0, CASE WHEN w < total THEN round((mass - m) / (total - w) - 1, 6) + 0.0 END AS mean1, CASE WHEN w > 0 AND w < total THEN round((mass * w - total * m) * (mass * w - total * m) / (w * (total - w)) / (total * total), 4) END AS sigma_b2 FROM run")
def otsu_curves(spark, d):
    found = T.otsu_curves(H.gray_histogram(V.gray_images(spark, d))).drop("eta")
    return rounded(rounded(found, "p0", "p1", "mean0", "mean1"), "sigma_b2", digits=4)


@query("separability", f"WITH {RUN} SELECT image_id, round((mass * w - total * m) * (mass * w - total * m) / (w * (total - w)) / (square * total - mass * mass), 6) AS eta FROM run WHERE t = 108")
def separability(spark, d):
    return rounded(T.separability(H.gray_histogram(V.gray_images(spark, d)), 108), "eta")


@query("otsu_mask", f"WITH {OTSU} SELECT px.image_id, r, c, v > threshold AS v FROM px JOIN otsu USING (image_id)")
def otsu_mask(spark, d):
    return T.otsu_mask(V.gray_images(spark, d))


@query("object_concentration", f"WITH {OTSU} SELECT px.image_id, threshold, round(max(effectiveness), 6) AS effectiveness, round(avg(CASE WHEN v > threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS concentration FROM px JOIN otsu USING (image_id) GROUP BY 1, 2")
def object_concentration(spark, d):
    return rounded(T.otsu_concentration(V.gray_images(spark, d)), "effectiveness", "concentration")


@query("fixed_threshold", f"WITH {PX} SELECT image_id, round(avg(CASE WHEN v > 76 THEN 1.0::DOUBLE ELSE 0 END), 6) AS concentration FROM px GROUP BY 1")
def fixed_threshold(spark, d):
    return rounded(T.concentration(V.masks(spark, d, 76)), "concentration")


_BLOCKS = "(SELECT image_id, r // 5 AS block_r, c // 10 AS block_c, v FROM px)"
_BLOCK_OTSU = f"""WITH {PX}, bp AS {_BLOCKS}, h AS (SELECT image_id, block_r, block_c, v AS t, count(*) AS n FROM bp GROUP BY 1, 2, 3, 4),
g AS (SELECT k.*, b.range AS t, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT image_id, block_r, block_c FROM bp) k CROSS JOIN range(0, 256) b LEFT JOIN h ON h.image_id = k.image_id AND h.block_r = k.block_r AND h.block_c = k.block_c AND h.t = b.range),
run AS (SELECT image_id, block_r, block_c, t, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum((t + 1) * n) OVER a AS DOUBLE) AS m, CAST(sum(n) OVER p AS DOUBLE) AS total, CAST(sum((t + 1) * n) OVER p AS DOUBLE) AS mass FROM g WINDOW a AS (PARTITION BY image_id, block_r, block_c ORDER BY t ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY image_id, block_r, block_c)),
s AS (SELECT *, CASE WHEN w > 0 AND w < total THEN (mass * w - total * m) * (mass * w - total * m) / (w * (total - w)) END AS score FROM run),
o AS (SELECT s.image_id, s.block_r, s.block_c, avg(s.t) AS threshold FROM s JOIN (SELECT image_id, block_r, block_c, max(score) AS best FROM s GROUP BY 1, 2, 3) b ON b.image_id = s.image_id AND b.block_r = s.block_r AND b.block_c = s.block_c AND b.best = s.score GROUP BY 1, 2, 3)
SELECT bp.image_id, bp.block_r, bp.block_c, max(threshold) AS threshold, CAST(count(*) FILTER (v OP threshold) AS BIGINT) AS n_object, CAST(count(*) AS BIGINT) AS n_pixels, round(count(*) FILTER (v OP threshold) / CAST(count(*) AS DOUBLE), 6) AS concentration FROM bp JOIN o ON o.image_id = bp.image_id AND o.block_r = bp.block_r AND o.block_c = bp.block_c GROUP BY 1, 2, 3"""


@query("block_otsu_gt", _BLOCK_OTSU.replace("OP", ">"))
def block_otsu_gt(spark, d):
    return rounded(T.block_otsu(V.gray_images(spark, d), V.ROWS, V.COLUMNS), "concentration")


@query("block_otsu_ge", _BLOCK_OTSU.replace("OP", ">="))
def block_otsu_ge(spark, d):
    return rounded(T.block_otsu(V.gray_images(spark, d), V.ROWS, V.COLUMNS, compare="ge"), "concentration")


@query("block_otsu_summary", f"SELECT image_id, round(sum(n_object) / CAST(sum(n_pixels) AS DOUBLE), 6) AS pooled, round(avg(n_object / CAST(n_pixels AS DOUBLE)), 6) AS unweighted, round(avg(threshold), 6) AS mean_threshold FROM ({_BLOCK_OTSU.replace('OP', '>')}) GROUP BY 1")
def block_otsu_summary(spark, d):
    return rounded(T.block_summary(T.block_otsu(V.gray_images(spark, d), V.ROWS, V.COLUMNS)), "pooled", "unweighted", "mean_threshold")


_TWO = f"""WITH {PX}, e AS (SELECT image_id, min(v) AS low, max(v) AS high FROM px GROUP BY 1),
b AS (SELECT px.image_id, CAST(floor(CAST(v - low AS FLOAT) / CAST(high - low AS FLOAT) * CAST(255 AS FLOAT) + CAST(0.5 AS FLOAT)) AS BIGINT) AS bin, count(*) AS n FROM px JOIN e USING (image_id) GROUP BY 1, 2),
h AS (SELECT e.image_id, k.range AS t, coalesce(b.n, 0) AS n FROM e CROSS JOIN range(0, 256) k LEFT JOIN b ON b.image_id = e.image_id AND b.bin = k.range),
run AS (SELECT image_id, t, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum((t + 1) * n) OVER a AS DOUBLE) AS m, CAST(sum(n) OVER p AS DOUBLE) AS total, CAST(sum((t + 1) * n) OVER p AS DOUBLE) AS mass FROM h WINDOW a AS (PARTITION BY image_id ORDER BY t ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY image_id)),
s AS (SELECT x.image_id, x.t AS t1, y.t AS t2, x.m * x.m / x.w + (y.m - x.m) * (y.m - x.m) / (y.w - x.w) + (x.mass - y.m) * (x.mass - y.m) / (x.total - y.w) AS score FROM run x JOIN run y ON x.image_id = y.image_id AND x.t < y.t WHERE x.w > 0 AND y.w > x.w AND y.w < x.total),
best AS (SELECT image_id, max(score) AS best FROM s GROUP BY 1),
th AS (SELECT s.image_id, avg(t1) AS t1, avg(t2) AS t2 FROM s JOIN best USING (image_id) WHERE score >= best * (1 - CAST('1e-13' AS DOUBLE)) GROUP BY 1),
two AS (SELECT image_id, CAST(floor(low + t1 / 255.0::DOUBLE * (high - low) + 0.5) AS BIGINT) AS low_threshold, CAST(floor(low + t2 / 255.0::DOUBLE * (high - low) + 0.5) AS BIGINT) AS high_threshold FROM th JOIN e USING (image_id))"""


@query("two_thresholds", f"{_TWO} SELECT image_id, low_threshold, high_threshold FROM two")
def two_thresholds(spark, d):
    return T.two_thresholds(V.gray_images(spark, d))


def _classes(spark, d, levels=False):
    px = V.gray_images(spark, d)
    rows = px.groupBy("image_id", "v").agg(F.count("*").alias("pixels")) if levels else px
    return rows.join(T.two_thresholds(px), "image_id").withColumn("class", T.quantize(F.col("v"), [F.col("low_threshold"), F.col("high_threshold")]))


@query("quantize_classes", f"{_TWO} SELECT px.image_id, r, c, CAST(1 + CAST(v > low_threshold AS INT) + CAST(v > high_threshold AS INT) AS BIGINT) AS class FROM px JOIN two USING (image_id)")
def quantize_classes(spark, d):
    return _classes(spark, d).select(*KEY, "class")


@query("class_coverage", f"{_TWO}, q AS (SELECT px.image_id, v, CAST(1 + CAST(v > low_threshold AS INT) + CAST(v > high_threshold AS INT) AS BIGINT) AS class FROM px JOIN two USING (image_id)) SELECT i.image_id, k.range AS class, round(count(q.v) / 1000.0::DOUBLE, 6) AS coverage, round(avg(q.v), 6) AS mean_gray FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(1, 4) k LEFT JOIN q ON q.image_id = i.image_id AND q.class = k.range GROUP BY 1, 2")
def class_coverage(spark, d):
    return rounded(T.class_table(_classes(spark, d, levels=True), F.col("class"), 3, F.col("pixels")), "coverage", "mean_gray")


# --- clusters and distances -----------------------------------------------------------------------------------------


def kmeans_sql(k: int) -> str:
    """Centres on each image's histogram: the recursion stops by itself where a round changes nothing."""
    names = [f"c{i}" for i in range(k)]
    near = lambda i: " AND ".join(f"abs(s - c{i}) {'<' if j < i else '<='} abs(s - c{j})" for j in range(k) if j != i)
    step = ", ".join(f"CAST(sum(CASE WHEN {near(i)} THEN n * s ELSE 0 END) AS DOUBLE) / sum(CASE WHEN {near(i)} THEN n ELSE 0 END) AS c{i}" for i in range(k))
    start = ", ".join(f"{i + 1} * (max(s) + 1) / CAST({k + 1} AS DOUBLE) AS c{i}" for i in range(k))
    mass = ", ".join(f"CAST(sum(CASE WHEN {near(i)} THEN n ELSE 0 END) AS BIGINT) AS n{i}" for i in range(k))
    rows = " UNION ALL ".join(f"SELECT image_id, CAST({i} AS BIGINT) AS k, c{i} + low - 1 AS centre, n{i} AS n, n{i} / 1000.0::DOUBLE AS coverage FROM fin" for i in range(k))
    return f"""WITH RECURSIVE {PX}, h AS (SELECT image_id, v, v - min(v) OVER (PARTITION BY image_id) + 1 AS s, min(v) OVER (PARTITION BY image_id) AS low, n FROM (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2)),
rec AS (SELECT image_id, {start} FROM h GROUP BY 1 UNION SELECT rec.image_id, {step} FROM rec JOIN h ON h.image_id = rec.image_id GROUP BY rec.image_id, {", ".join(names)}),
nxt AS (SELECT rec.image_id, {", ".join(f"rec.c{i} AS o{i}" for i in range(k))}, {step}, max(low) AS low, {mass} FROM rec JOIN h ON h.image_id = rec.image_id GROUP BY rec.image_id, {", ".join(names)}),
fin AS (SELECT * FROM nxt WHERE {" AND ".join(f"o{i} = c{i}" for i in range(k))}), km AS ({rows})"""


_KM = "SELECT image_id, k, round(centre, 6) AS centre, n, round(coverage, 6) AS coverage FROM km"


@query("gray_kmeans_k2", f"{kmeans_sql(2)} {_KM}")
def gray_kmeans_k2(spark, d):
    return rounded(C.gray_kmeans(V.gray_images(spark, d), 2), "centre", "coverage").drop("iterations")


@query("gray_kmeans_k3", f"{kmeans_sql(3)} {_KM}")
def gray_kmeans_k3(spark, d):
    return rounded(C.gray_kmeans(V.gray_images(spark, d), 3), "centre", "coverage").drop("iterations")


@query("kmeans_concentration", f"{kmeans_sql(3)} SELECT image_id, round(sum(CASE WHEN k > 0 THEN coverage ELSE 0 END), 6) AS concentration FROM km GROUP BY 1")
def kmeans_concentration(spark, d):
    return rounded(C.brightest_share(C.gray_kmeans(V.gray_images(spark, d), 3), 2), "concentration")


@query("kmeans_labels", f"{kmeans_sql(3)} SELECT px.image_id, r, c, CAST(arg_min(k, abs(v - centre) + k * CAST('1e-12' AS DOUBLE)) AS BIGINT) AS k FROM px JOIN km ON km.image_id = px.image_id GROUP BY 1, 2, 3")
def kmeans_labels(spark, d):
    px = V.gray_images(spark, d)
    return C.gray_labels(px, C.gray_kmeans(px, 3)).select(*KEY, "k")


def _points(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("f"))


_START = [[13.0, 950.0], [38.0, 950.0]]


@query("lloyd_centres")
def lloyd_centres(spark, d):
    centres, history, n = C.lloyd(_points(spark, d), _START, max_iter=20)
    rows = [(i, *map(float, c), history[-1], n) for i, c in enumerate(centres)]
    return rounded(spark.createDataFrame(rows, "k bigint, x double, y double, objective double, iterations bigint"), "x", "y", "objective", digits=4)


@query("lloyd_first_step", "WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), a AS (SELECT x, y, CASE WHEN (x - 13) * (x - 13) + (y - 950) * (y - 950) <= (x - 38) * (x - 38) + (y - 950) * (y - 950) THEN 0 ELSE 1 END AS k FROM p) SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM a GROUP BY 1")
def lloyd_first_step(spark, d):
    p = _points(spark, d).select("f", C.nearest(F.col("f"), _START)["k"].alias("k"))
    return p.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg(F.col("f")[0]), 4).alias("x"), r6(F.avg(F.col("f")[1]), 4).alias("y"))


_CENTRES = "(VALUES (0, 10.0::DOUBLE, 910.0::DOUBLE), (1, 40.0::DOUBLE, 990.0::DOUBLE)) k(k, x, y)"
for _name, _sql in {
    "euclidean": "sqrt((p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y))",
    "sqeuclidean": "(p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y)",
    "cityblock": "abs(p_size - x) + abs(p_retailprice - y)",
    "chebyshev": "greatest(abs(p_size - x), abs(p_retailprice - y))",
    "cosine": "1 - (p_size * x + p_retailprice * y) / (sqrt(p_size * p_size + p_retailprice * p_retailprice) * sqrt(x * x + y * y))",
    "mahalanobis": "sqrt(0.5 * (p_size - x) * (p_size - x) + 2 * 0.1 * (p_size - x) * (p_retailprice - y) + 0.25 * (p_retailprice - y) * (p_retailprice - y))",
}.items():

    def _distance(spark, d, metric=_name):
        found = C.pairwise(_points(spark, d), [[10.0, 910.0], [40.0, 990.0]], metric=metric, inverse=[[0.5, 0.1], [0.1, 0.25]])
        return found.select("id", "k", r6(F.col("distance")).alias("distance"))

    query(f"pairwise_distance_{_name}", f"SELECT p_partkey AS id, CAST(k AS BIGINT) AS k, round({_sql}, 6) + 0.0 AS distance FROM part CROSS JOIN {_CENTRES}")(_distance)


@query("point_distance_maps", "SELECT x.range AS r, y.range AS c, round(-sqrt(CAST((x.range - 10) * (x.range - 10) + (y.range - 12) * (y.range - 12) AS DOUBLE)), 6) + 0.0 AS euclidean, -(abs(x.range - 10) + abs(y.range - 12)) AS cityblock, -greatest(abs(x.range - 10), abs(y.range - 12)) AS chessboard FROM range(0, 21) x CROSS JOIN range(0, 25) y")
def point_distance_maps(spark, d):
    grid = spark.range(21 * 25).select(F.expr("id div 25").alias("r"), (F.col("id") % 25).alias("c"))
    dr, dc = F.col("r") - 10, F.col("c") - 12
    return grid.select("r", "c", r6(-E.pixel_distance(dr, dc)).alias("euclidean"), (-E.pixel_distance(dr, dc, "cityblock")).alias("cityblock"), (-E.pixel_distance(dr, dc, "chessboard")).alias("chessboard"))


# --- sizes ----------------------------------------------------------------------------------------------------------


@query("equivalent_diameter", f"SELECT p_partkey AS id, round(sqrt(4 * p_size * 1.1794::DOUBLE * 1.1794::DOUBLE / {math.pi!r}::DOUBLE), 6) AS diameter FROM part")
def equivalent_diameter(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(E.caliper_diameter("p_size", E.PIXEL_LENGTH)).alias("diameter"))


@query("size_colour", "SELECT p_partkey AS id, CAST(floor(10000.0::DOUBLE * (1 - exp(-p_size / 1000.0::DOUBLE))) AS BIGINT) AS colour, CAST(-sign(ln(1 - floor(10000.0::DOUBLE * (1 - exp(-p_size / 1000.0::DOUBLE))) / 10000.0::DOUBLE)) * floor(abs(1000 * ln(1 - floor(10000.0::DOUBLE * (1 - exp(-p_size / 1000.0::DOUBLE))) / 10000.0::DOUBLE)) + 0.5) AS BIGINT) AS area FROM part")
def size_colour(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), E.size_colour(F.col("p_size").cast("double")).alias("colour"))
    return p.withColumn("area", E.colour_size("colour"))


@query("cumulative_size", "SELECT CAST(l_quantity AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(count(*)) OVER (ORDER BY l_quantity DESC) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM lineitem GROUP BY l_quantity")
def cumulative_size(spark, d):
    return rounded(D.cumulative_sizes(V.sizes(spark, d)), "share")


@query("size_histogram", "SELECT b.range AS bin, CAST(5 + 7 * b.range AS DOUBLE) AS centre, CAST(count(l.l_quantity) AS BIGINT) AS n, CAST(floor(10000.0::DOUBLE * (1 - exp(-(5 + 7 * b.range) / 1000.0::DOUBLE))) AS BIGINT) AS colour FROM range(0, 7) b LEFT JOIN lineitem l ON l.l_quantity > CASE WHEN b.range = 0 THEN -1 ELSE 7 * b.range + 1.5 END AND l.l_quantity <= CASE WHEN b.range = 6 THEN 1000 ELSE 7 * b.range + 8.5 END GROUP BY 1")
def size_histogram(spark, d):
    return D.size_histogram(V.sizes(spark, d), low=5, step=7, high=50)


_H = "SELECT b.range AS bin, CAST(count(l.x) AS BIGINT) AS n FROM range(0, 50) b LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) - 1 AS x FROM lineitem WHERE l_returnflag = '{f}') l ON l.x = b.range GROUP BY 1"


def _flagged(spark, d, flag):
    rows = V.table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return H.centre_histogram(rows, "l_quantity", [float(i + 1) for i in range(50)])


@query("size_histogram_error", f"SELECT a.bin, a.n AS n_a, b.n AS n_b, a.n - b.n AS difference FROM ({_H.format(f='A')}) a JOIN ({_H.format(f='R')}) b USING (bin)")
def size_histogram_error(spark, d):
    return D.histogram_difference(_flagged(spark, d, "A"), _flagged(spark, d, "R"))


@query("shifted_difference", f"SELECT a.bin, a.n - coalesce(b.n, 0) AS difference FROM ({_H.format(f='A')}) a LEFT JOIN ({_H.format(f='R')}) b ON b.bin = a.bin + 1")
def shifted_difference(spark, d):
    return D.shifted_difference(_flagged(spark, d, "A"), _flagged(spark, d, "R"))


@query("size_triplets", "WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q AS low, CASE WHEN q = 50 THEN 50 ELSE q END AS high, CAST(n AS BIGINT) AS n FROM c")
def size_triplets(spark, d):
    return D.triplets(V.sizes(spark, d), "area", 49)


def _fit_points(spark, d):
    x = F.col("size").cast("double")
    return D.cumulative_sizes(V.sizes(spark, d)).select(F.lit(0).cast("bigint").alias("id"), x.alias("x"), F.col("share").alias("y"))


@query("power_law_fit")
def power_law_fit(spark, d):
    return rounded(D.fit_curves(_fit_points(spark, d)), "p1", "p2", "residual", digits=4).select("id", "model", "p1", "p2", "residual")


@query("three_fits")
def three_fits(spark, d):
    return rounded(D.fit_curves(_fit_points(spark, d), ("power", "truncated", "weibull")), "p1", "p2", "p3", "residual", digits=3).select("id", "model", "p1", "p2", "p3", "residual")


@query("power_law_values", "SELECT p_partkey AS id, round(3 * power(p_size, -1.37::DOUBLE), 6) AS power, round(2 * (power(p_size, -1.2::DOUBLE) - power(60.0::DOUBLE, -1.2::DOUBLE)), 6) AS truncated, round(exp(-power(p_size / 20.0::DOUBLE, 1.5::DOUBLE)), 6) AS weibull FROM part")
def power_law_values(spark, d):
    x = F.col("p_size").cast("double")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(E.power_law(x, 3.0, 1.37)).alias("power"), r6(E.truncated_power_law(x, 2.0, 1.2, 60.0)).alias("truncated"), r6(E.weibull_survival(x, 1.5, 20.0)).alias("weibull"))


@query("nearest_centre", "SELECT p_partkey AS id, CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 3 END AS BIGINT) AS k FROM part")
def nearest_centre(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.nearest_centre(F.col("p_size").cast("double"), [5.0, 15.0, 25.0, 35.0]).alias("k"))


_THREE = _TWO[: _TWO.index("s AS (")] + """s AS NOT MATERIALIZED (SELECT x.image_id, x.t AS t1, y.t AS t2, z.t AS t3, x.m * x.m / x.w + (y.m - x.m) * (y.m - x.m) / (y.w - x.w) + (z.m - y.m) * (z.m - y.m) / (z.w - y.w) + (z.mass - z.m) * (z.mass - z.m) / (z.total - z.w) AS score FROM run x JOIN run y ON x.image_id = y.image_id AND x.t < y.t JOIN run z ON z.image_id = y.image_id AND y.t < z.t WHERE x.w > 0 AND y.w > x.w AND z.w > y.w AND z.w < z.total),
best AS (SELECT image_id, max(score) AS best FROM s GROUP BY 1),
th AS (SELECT s.image_id, avg(t1) AS t1, avg(t2) AS t2, avg(t3) AS t3 FROM s JOIN best USING (image_id) WHERE score >= best * (1 - CAST('1e-13' AS DOUBLE)) GROUP BY 1)
SELECT th.image_id, """ + ", ".join(f"CAST(floor(low + t{k} / 255.0::DOUBLE * (high - low) + 0.5) AS BIGINT) AS t{k}" for k in (1, 2, 3)) + " FROM th JOIN e USING (image_id)"


@query("three_thresholds", _THREE)
def three_thresholds(spark, d):
    return T.three_thresholds(V.gray_images(spark, d))


@query("diameter_analysis", "WITH p AS (SELECT p_size * 20.0::DOUBLE AS a, p_size * 17.0::DOUBLE AS b FROM part), k AS (SELECT ceil(sqrt(4 * a / 3.141592653589793::DOUBLE) - 0.5) AS x, ceil(sqrt(4 * b / 3.141592653589793::DOUBLE) - 0.5) AS y FROM p), g AS (SELECT k.range AS bin FROM range(0, 100) k), x AS (SELECT bin, CAST(count(k.x) AS BIGINT) AS n FROM g LEFT JOIN k ON least(100, greatest(1, k.x)) = bin + 1 GROUP BY 1), y AS (SELECT bin, CAST(count(k.y) AS BIGINT) AS n FROM g LEFT JOIN k ON least(100, greatest(1, k.y)) = bin + 1 GROUP BY 1) SELECT x.bin, x.n AS n_polygon, y.n AS n_pixel, x.n - coalesce(z.n, 0) AS difference FROM x JOIN y USING (bin) LEFT JOIN y z ON z.bin = x.bin + 1")
def diameter_analysis(spark, d):
    size = F.col("p_size")
    return D.diameter_analysis(V.table(spark, d, "part").select((size * 20.0).alias("polygon_area"), (size * 17.0).alias("pixel_area")), 1.0)


@query("lloyd_plus_plus")
def lloyd_plus_plus(spark, d):
    p = _points(spark, d)
    centres, history, n = C.lloyd(p, C.plus_plus_start(p, 3), max_iter=15)
    rows = [(i, *map(float, c)) for i, c in enumerate(sorted(centres))]
    return rounded(spark.createDataFrame(rows, "k bigint, x double, y double"), "x", "y", digits=3)


@query("generated_clusters")
def generated_clusters(spark, d):
    from gridloom.sources.generated import clusters

    p = clusters(spark, outlier=(20.0, 20.0))
    centres, history, _ = C.lloyd(p, C.equal_start(p, 2))
    return spark.createDataFrame([(i, h) for i, h in enumerate(history)], "iteration bigint, objective double")


@query("generated_bimodal_otsu")
def generated_bimodal_otsu(spark, d):
    from gridloom.sources.generated import bimodal

    return rounded(T.otsu_concentration(bimodal(spark)), "effectiveness", "concentration")
