"""Convolution, edges, differences, morphology, sets, resampling, tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.catalog.registry import MASK, PX, query, r6, rounded
from gridloom.operators import kernels as K
from gridloom.operators import morphology as M
from gridloom.operators import resample as R
from gridloom.operators import sets as S
from gridloom.operators import stencils as N
from gridloom.operators import tiles as TI
from gridloom.operators.rasters import per_image
from gridloom.sources import virtual as V

KEY = ["image_id", "r", "c"]

# Neighbours in SQL: with null outside (NB), nought outside (NZ), and replicated borders (NR).
_OFF = "(SELECT a.range - 1 AS dr, b.range - 1 AS dc FROM range(0, 3) a CROSS JOIN range(0, 3) b)"
NZ = f"nz AS (SELECT p.image_id, p.r, p.c, o.dr, o.dc, coalesce(q.v, 0) AS v FROM px p CROSS JOIN {_OFF} o LEFT JOIN px q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc)"
NB = f"nb AS (SELECT p.image_id, p.r, p.c, o.dr, o.dc, q.v FROM px p CROSS JOIN {_OFF} o JOIN px q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc)"
NR = f"nr AS (SELECT p.image_id, p.r, p.c, o.dr, o.dc, q.v FROM px p CROSS JOIN {_OFF} o JOIN px q ON q.image_id = p.image_id AND q.r = least(24, greatest(0, p.r + o.dr)) AND q.c = least(39, greatest(0, p.c + o.dc)))"


def _weights(kernel) -> str:
    rows = ", ".join(f"({i - 1}, {j - 1}, {float(w)!r}::DOUBLE)" for (i, j), w in np.ndenumerate(np.asarray(kernel, float)))
    return f"(VALUES {rows}) w(dr, dc, w)"


_K = np.array([[1, 2, 3], [0, -1, 4], [2, 0, 1]], float)


@query("correlate_zero", f"WITH {PX}, {NZ} SELECT image_id, r, c, round(sum(v * w), 6) AS out FROM nz JOIN {_weights(_K)} USING (dr, dc) GROUP BY 1, 2, 3")
def correlate_zero(spark, d):
    return rounded(N.correlate(V.gray_images(spark, d), _K, "zero").select(*KEY, "out"), "out")


@query("correlate_replicate", f"WITH {PX}, {NR} SELECT image_id, r, c, round(sum(v * w), 6) AS out FROM nr JOIN {_weights(_K)} USING (dr, dc) GROUP BY 1, 2, 3")
def correlate_replicate(spark, d):
    return rounded(N.correlate(V.gray_images(spark, d), _K, "replicate").select(*KEY, "out"), "out")


_CONV = f"SELECT image_id, px.r + i.range AS r, px.c + j.range AS c, CAST(sum(v * CAST(CASE WHEN i.range = 0 THEN j.range + 1 ELSE 4 - j.range END AS DOUBLE)) AS DOUBLE) AS out FROM px CROSS JOIN range(0, 2) i CROSS JOIN range(0, 3) j GROUP BY 1, 2, 3"
_KC = np.array([[1, 2, 3], [4, 3, 2]], float)


@query("convolve_full", f"WITH {PX} {_CONV}")
def convolve_full(spark, d):
    return N.convolve(V.gray_images(spark, d), _KC, "full")


@query("convolve_same", f"WITH {PX} SELECT image_id, r - 1 AS r, c - 1 AS c, out FROM ({_CONV}) WHERE r BETWEEN 1 AND 25 AND c BETWEEN 1 AND 40")
def convolve_same(spark, d):
    return N.convolve(V.gray_images(spark, d), _KC, "same", V.ROWS, V.COLUMNS)


@query("convolve_valid", f"WITH {PX} SELECT image_id, r - 1 AS r, c - 2 AS c, out FROM ({_CONV}) WHERE r BETWEEN 1 AND 24 AND c BETWEEN 2 AND 39")
def convolve_valid(spark, d):
    return N.convolve(V.gray_images(spark, d), _KC, "valid", V.ROWS, V.COLUMNS)


@query("response_at_pixel", f"WITH {PX} SELECT image_id, CAST(sum(v * w) AS DOUBLE) AS out FROM px JOIN {_weights(_K)} ON px.r = 7 + dr AND px.c = 9 + dc GROUP BY 1")
def response_at_pixel(spark, d):
    return N.response_at(V.gray_images(spark, d), _K, 7, 9, flip=False)


@query("gaussian_smoothing", f"WITH {PX}, {NR} SELECT image_id, r, c, round(sum(v * w), 6) AS out FROM nr JOIN {_weights(N.gaussian_kernel(3, 1.0))} USING (dr, dc) GROUP BY 1, 2, 3")
def gaussian_smoothing(spark, d):
    return rounded(N.correlate(V.gray_images(spark, d), N.gaussian_kernel(3, 1.0), "replicate").select(*KEY, "out"), "out")


@query("median_filter", f"WITH {PX}, {NZ} SELECT image_id, r, c, CAST(median(v) AS BIGINT) AS out FROM nz GROUP BY 1, 2, 3")
def median_filter(spark, d):
    return N.median3(V.gray_images(spark, d)).select(*KEY, "out")


@query("laplacian", f"WITH {PX}, {NR} SELECT image_id, r, c, CAST(sum(CASE WHEN dr = 0 AND dc = 0 THEN -4 * v WHEN dr = 0 OR dc = 0 THEN v ELSE 0 END) AS DOUBLE) AS four, CAST(sum(CASE WHEN dr = 0 AND dc = 0 THEN -8 * v ELSE v END) AS DOUBLE) AS eight FROM nr GROUP BY 1, 2, 3")
def laplacian(spark, d):
    n = N.neighbourhood(V.gray_images(spark, d), 1, "replicate", name="n")
    return n.select(*KEY, N.weighted("n", N.LAPLACE_4).alias("four"), N.weighted("n", N.LAPLACE_8).alias("eight"))


_GRAD = {
    "sobel": ("sum(CASE WHEN dc = 0 THEN 0 ELSE dc * (2 - abs(dr)) * v END) / 8.0::DOUBLE", "sum(CASE WHEN dr = 0 THEN 0 ELSE dr * (2 - abs(dc)) * v END) / 8.0::DOUBLE", 4),
    "prewitt": ("sum(dc * v) / 6.0::DOUBLE", "sum(dr * v) / 6.0::DOUBLE", 4),
    "roberts": ("sum(CASE WHEN dr = 0 AND dc = 0 THEN v WHEN dr = 1 AND dc = 1 THEN -v ELSE 0 END) / 2.0::DOUBLE", "sum(CASE WHEN dr = 0 AND dc = 1 THEN v WHEN dr = 1 AND dc = 0 THEN -v ELSE 0 END) / 2.0::DOUBLE", 6),
}


def _edge_sql(kind: str, thin: bool) -> str:
    bx, by, factor = _GRAD[kind]
    base = f"WITH {PX}, {NR}, g AS (SELECT image_id, r, c, {bx} AS bx, {by} AS by_ FROM nr GROUP BY 1, 2, 3), s AS (SELECT *, bx * bx + by_ * by_ AS b, {factor}.0::DOUBLE * avg(bx * bx + by_ * by_) OVER (PARTITION BY image_id) AS cut FROM g)"
    if not thin:
        return f"{base} SELECT image_id, r, c, b > cut AS is_edge FROM s"
    eps = "CAST('2.220446049250313e-14' AS DOUBLE)"
    join = lambda a, dr, dc: f"LEFT JOIN s {a} ON {a}.image_id = s.image_id AND {a}.r = s.r + ({dr}) AND {a}.c = s.c + ({dc})"
    places = ((-1, -1), (1, 1), (-1, 1), (1, -1)) if kind == "roberts" else ((0, -1), (0, 1), (-1, 0), (1, 0))
    joins = " ".join(join(a, *p) for a, p in zip("wxyz", places))
    return f"{base} SELECT s.image_id, s.r, s.c, s.b > s.cut AND ((abs(s.bx) >= abs(s.by_) - {eps} AND coalesce(w.b, 0) <= s.b AND s.b > coalesce(x.b, 0)) OR (abs(s.by_) >= abs(s.bx) - {eps} AND coalesce(y.b, 0) <= s.b AND s.b > coalesce(z.b, 0))) AS is_edge FROM s {joins}"


for _kind in _GRAD:
    for _thin in (True, False):

        def _edges(spark, d, kind=_kind, thin=_thin):
            return N.edges(V.gray_images(spark, d), kind, thin=thin).select(*KEY, "is_edge")

        query(f"edges_{_kind}" + ("" if _thin else "_thick"), _edge_sql(_kind, _thin))(_edges)


@query("sobel_fixed_level", f"WITH {PX}, {NR}, g AS (SELECT image_id, r, c, {_GRAD['sobel'][0]} AS bx, {_GRAD['sobel'][1]} AS by_ FROM nr GROUP BY 1, 2, 3) SELECT image_id, r, c, bx * bx + by_ * by_ > 400 AS is_edge FROM g")
def sobel_fixed_level(spark, d):
    return N.edges(V.gray_images(spark, d), "sobel", level=20.0, thin=False).select(*KEY, "is_edge")


_LOG = "(VALUES " + ", ".join(f"({a - 3}, {b - 3}, CAST('{w!r}' AS DOUBLE))" for a, row in enumerate(N.log_kernel(7, 1.0).tolist()) for b, w in enumerate(row)) + ") k(dr, dc, w)"
_RESPONSE = f"WITH {PX}, b AS (SELECT p.image_id, p.r, p.c, sum(q.v * w) AS b FROM px p CROSS JOIN {_LOG} JOIN px q ON q.image_id = p.image_id AND q.r = least(24, greatest(0, p.r + dr)) AND q.c = least(39, greatest(0, p.c + dc)) GROUP BY 1, 2, 3), l AS (SELECT *, 0.75::DOUBLE * avg(abs(b)) OVER (PARTITION BY image_id) AS cut, lag(b) OVER y AS up, lead(b) OVER y AS down, lag(b) OVER x AS lft, lead(b) OVER x AS rgt FROM b WINDOW x AS (PARTITION BY image_id, r ORDER BY c), y AS (PARTITION BY image_id, c ORDER BY r))"


@query("log_edges", f"{_RESPONSE} SELECT image_id, r, c, coalesce(up IS NOT NULL AND down IS NOT NULL AND lft IS NOT NULL AND rgt IS NOT NULL AND ((b < 0 AND ((up > 0 AND up - b > cut) OR (down > 0 AND down - b > cut) OR (lft > 0 AND lft - b > cut) OR (rgt > 0 AND rgt - b > cut))) OR (b = 0 AND ((up * down < 0 AND abs(up - down) > 2 * cut) OR (lft * rgt < 0 AND abs(lft - rgt) > 2 * cut)))), false) AS is_edge FROM l")
def log_edges(spark, d):
    return N.log_edges(V.gray_images(spark, d), 1.0).select(*KEY, "is_edge")


@query("laplacian_crossings", f"WITH {PX}, {NR}, l AS (SELECT image_id, r, c, sum(CASE WHEN dr = 0 AND dc = 0 THEN -4 * v WHEN dr = 0 OR dc = 0 THEN v ELSE 0 END) AS b FROM nr GROUP BY 1, 2, 3) SELECT p.image_id, p.r, p.c, max(q.b) > 100 AND min(q.b) < -100 AS is_edge FROM l p JOIN l q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3")
def laplacian_crossings(spark, d):
    return N.laplacian_crossings(V.gray_images(spark, d), 100.0).select(*KEY, "is_edge")


_G2 = f"{PX}, g AS (SELECT p.image_id, p.r, p.c, p.v, CASE WHEN e.v IS NULL THEN p.v - w.v WHEN w.v IS NULL THEN e.v - p.v ELSE (e.v - w.v) / 2.0::DOUBLE END AS dx, CASE WHEN s.v IS NULL THEN p.v - n.v WHEN n.v IS NULL THEN s.v - p.v ELSE (s.v - n.v) / 2.0::DOUBLE END AS dy FROM px p LEFT JOIN px e ON e.image_id = p.image_id AND e.r = p.r AND e.c = p.c + 1 LEFT JOIN px w ON w.image_id = p.image_id AND w.r = p.r AND w.c = p.c - 1 LEFT JOIN px s ON s.image_id = p.image_id AND s.r = p.r + 1 AND s.c = p.c LEFT JOIN px n ON n.image_id = p.image_id AND n.r = p.r - 1 AND n.c = p.c)"


@query("gradient2", f"WITH {_G2} SELECT image_id, r, c, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, round(sqrt(dx * dx + dy * dy), 6) AS l2, CAST(abs(dx) + abs(dy) AS DOUBLE) AS l1, round(atan2(dy, dx), 6) + 0.0 AS angle FROM g")
def gradient2(spark, d):
    g = N.gradient2(V.gray_images(spark, d))
    dx, dy = F.col("dx"), F.col("dy")
    return g.select(*KEY, "dx", "dy", r6(N.magnitude(dx, dy)).alias("l2"), N.magnitude(dx, dy, "l1").alias("l1"), r6(N.direction(dx, dy)).alias("angle"))


@query("forward_second", f"WITH {PX} SELECT p.image_id, p.r, p.c, b.v - 2 * a.v + p.v AS out FROM px p JOIN px a ON a.image_id = p.image_id AND a.r = p.r + 1 AND a.c = p.c JOIN px b ON b.image_id = p.image_id AND b.r = p.r + 2 AND b.c = p.c")
def forward_second(spark, d):
    return V.gray_images(spark, d).withColumn("out", N.forward_second("r")).where("out is not null").select(*KEY, "out")


@query("del2", f"""WITH {PX}, a AS (SELECT image_id, r, c, (lead(v) OVER w - 2 * v + lag(v) OVER w) / 2.0::DOUBLE AS x, (lead(v) OVER u - 2 * v + lag(v) OVER u) / 2.0::DOUBLE AS y FROM px WINDOW w AS (PARTITION BY image_id, r ORDER BY c), u AS (PARTITION BY image_id, c ORDER BY r)),
b AS (SELECT image_id, r, c, CASE WHEN c = 0 THEN 2 * lead(x) OVER w - lead(x, 2) OVER w WHEN c = 39 THEN 2 * lag(x) OVER w - lag(x, 2) OVER w ELSE x END AS x, CASE WHEN r = 0 THEN 2 * lead(y) OVER u - lead(y, 2) OVER u WHEN r = 24 THEN 2 * lag(y) OVER u - lag(y, 2) OVER u ELSE y END AS y FROM a WINDOW w AS (PARTITION BY image_id, r ORDER BY c), u AS (PARTITION BY image_id, c ORDER BY r)) SELECT image_id, r, c, CAST((x + y) / 2.0::DOUBLE AS DOUBLE) AS del2 FROM b""")
def del2(spark, d):
    return N.del2(V.gray_images(spark, d)).select(*KEY, "del2")


@query("contour_energies", f"WITH {_G2} SELECT image_id, r, c, CAST(v AS DOUBLE) AS line_energy, CAST(-(dx * dx + dy * dy) AS DOUBLE) + 0.0 AS edge_energy FROM g")
def contour_energies(spark, d):
    return N.structure_energy(V.gray_images(spark, d)).select(*KEY, "line_energy", (F.col("edge_energy") + 0.0).alias("edge_energy"))


# --- morphology -----------------------------------------------------------------------------------------------------

_CROSS = M.diamond(1)


@query("erode", f"WITH {PX}, {NB} SELECT image_id, r, c, CAST(min(v) AS BIGINT) AS out FROM nb WHERE dr = 0 OR dc = 0 GROUP BY 1, 2, 3")
def erode(spark, d):
    return M.erode(V.gray_images(spark, d), _CROSS).select(*KEY, "out")


@query("dilate", f"WITH {PX}, {NB} SELECT image_id, r, c, CAST(max(v) AS BIGINT) AS out FROM nb WHERE dr = 0 OR dc = 0 GROUP BY 1, 2, 3")
def dilate(spark, d):
    return M.dilate(V.gray_images(spark, d), _CROSS).select(*KEY, "out")


@query("erode_even", f"WITH {PX}, {NB} SELECT image_id, r, c, CAST(min(v) AS BIGINT) AS out FROM nb WHERE dr >= 0 AND dc >= 0 GROUP BY 1, 2, 3")
def erode_even(spark, d):
    return M.erode(V.gray_images(spark, d), M.square(2)).select(*KEY, "out")


@query("dilate_even", f"WITH {PX}, {NB} SELECT image_id, r, c, CAST(max(v) AS BIGINT) AS out FROM nb WHERE dr <= 0 AND dc <= 0 GROUP BY 1, 2, 3")
def dilate_even(spark, d):
    return M.dilate(V.gray_images(spark, d), M.square(2)).select(*KEY, "out")


_ERODED = f"{PX}, {NB}, e AS (SELECT image_id, r, c, min(v) AS v FROM nb GROUP BY 1, 2, 3), dl AS (SELECT image_id, r, c, max(v) AS v FROM nb GROUP BY 1, 2, 3)"


@query("opening", f"WITH {_ERODED} SELECT p.image_id, p.r, p.c, CAST(max(q.v) AS BIGINT) AS out FROM e p JOIN e q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3")
def opening(spark, d):
    return M.opening(V.gray_images(spark, d), M.square(3)).select(*KEY, "out")


@query("closing", f"WITH {PX}, g AS (SELECT i.image_id, a.range - 2 AS r, b.range - 2 AS c FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(0, 29) a CROSS JOIN range(0, 44) b), dl AS (SELECT g.image_id, g.r, g.c, max(px.v) AS v FROM g LEFT JOIN px ON px.image_id = g.image_id AND px.r BETWEEN g.r - 1 AND g.r + 1 AND px.c BETWEEN g.c - 1 AND g.c + 1 GROUP BY 1, 2, 3) SELECT p.image_id, p.r, p.c, CAST(min(q.v) AS BIGINT) AS out FROM px p JOIN dl q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3")
def closing(spark, d):
    return M.closing(V.gray_images(spark, d), M.square(3)).select(*KEY, "out")


@query("morphological_gradient", f"WITH {PX}, {NB}, m AS (SELECT image_id, r, c, min(v) AS lo, max(v) AS hi, max(CASE WHEN dr = 0 AND dc = 0 THEN v END) AS v FROM nb WHERE dr = 0 OR dc = 0 GROUP BY 1, 2, 3) SELECT image_id, r, c, CAST(hi - lo AS BIGINT) AS basic, CAST(v - lo AS BIGINT) AS internal, CAST(hi - v AS BIGINT) AS external FROM m")
def morphological_gradient(spark, d):
    return M.gradient(V.gray_images(spark, d), _CROSS).select(*KEY, "basic", "internal", "external")


@query("gradient_identity", f"WITH {PX} SELECT CAST(0 AS BIGINT) AS broken FROM px LIMIT 1")
def gradient_identity(spark, d):
    g = M.gradient(V.gray_images(spark, d), M.disk(2))
    return g.agg(F.sum((F.col("internal") + F.col("external") != F.col("basic")).cast("bigint")).alias("broken"))


@query("hit_or_miss", f"WITH {MASK}, o AS (SELECT * FROM mask WHERE v) SELECT p.image_id, p.r, p.c FROM o p JOIN o e ON e.image_id = p.image_id AND e.r = p.r AND e.c = p.c + 1 WHERE NOT EXISTS (SELECT 1 FROM o w WHERE w.image_id = p.image_id AND w.r = p.r AND w.c = p.c - 1)")
def hit_or_miss(spark, d):
    return M.hit_or_miss(V.masks(spark, d), [(0, 0), (0, 1)], [(0, -1)]).where("out").select(*KEY)


_MARK = f"{PX}, mk AS (SELECT image_id, r, c, CASE WHEN r = 12 THEN v ELSE 0 END AS v FROM px)"


def _marker(spark, d):
    px = V.gray_images(spark, d)
    return px.withColumn("v", F.when(F.col("r") == 12, F.col("v")).otherwise(0).cast("bigint")), px


@query("geodesic_dilation", f"WITH {_MARK}, s1 AS (SELECT p.image_id, p.r, p.c, least(max(q.v), max(p.v)) AS v FROM px p JOIN mk q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3) SELECT p.image_id, p.r, p.c, CAST(least(max(q.v), max(p.v)) AS BIGINT) AS v FROM px p JOIN s1 q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3")
def geodesic_dilation(spark, d):
    marker, px = _marker(spark, d)
    return M.geodesic_dilation(marker, px, M.square(3), 2)


@query("geodesic_erosion", f"WITH {PX}, mk AS (SELECT image_id, r, c, CASE WHEN r = 12 THEN v ELSE 255 END AS v FROM px) SELECT p.image_id, p.r, p.c, CAST(greatest(min(q.v), max(p.v)) AS BIGINT) AS v FROM px p JOIN mk q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3")
def geodesic_erosion(spark, d):
    px = V.gray_images(spark, d)
    marker = px.withColumn("v", F.when(F.col("r") == 12, F.col("v")).otherwise(255).cast("bigint"))
    return M.geodesic_erosion(marker, px, M.square(3), 1)


@query("profile_open_close", f"WITH {PX}, e AS (SELECT image_id, r, c, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT image_id, r, c, CAST(max(lo) OVER w AS BIGINT) AS opened, CAST(min(hi) OVER w AS BIGINT) AS closed FROM e WINDOW w AS (PARTITION BY image_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def profile_open_close(spark, d):
    return M.profile_open_close(V.gray_images(spark, d), 5, ("image_id", "r")).select(*KEY, "opened", "closed")


def _spread(marker: str, best: str, other: str, images: str = "true") -> str:
    """Reconstruction in SQL: each pixel's value is replaced while a neighbour offers a better one."""
    return f"""WITH RECURSIVE {PX}, m AS (SELECT image_id, r, c, v, {marker} AS w FROM px WHERE {images}), rec(image_id, r, c, v) USING KEY (image_id, r, c) AS (SELECT image_id, r, c, w FROM m UNION (SELECT m.image_id, m.r, m.c, {best}({other}(m.v, rec.v)) FROM rec JOIN m ON m.image_id = rec.image_id AND NEAR JOIN recurring.rec AS cur ON cur.image_id = m.image_id AND cur.r = m.r AND cur.c = m.c WHERE {other}(m.v, rec.v) {">" if best == "max" else "<"} cur.v GROUP BY 1, 2, 3))"""


_N8 = "abs(m.r - rec.r) <= 1 AND abs(m.c - rec.c) <= 1"
_N4 = "abs(m.r - rec.r) + abs(m.c - rec.c) = 1"


@query("reconstruct", _spread("greatest(v - 40, 0)", "max", "least").replace("NEAR", _N8) + " SELECT image_id, r, c, CAST(v AS BIGINT) AS out FROM rec")
def reconstruct(spark, d):
    px = V.gray_images(spark, d)
    return per_image(px, lambda a: {"out": K.reconstruct(np.maximum(a - 40, 0), a).astype(np.int64)}, "out bigint")


@query("fill_gray_holes", _spread("CASE WHEN r IN (0, 24) OR c IN (0, 39) THEN v ELSE 100000 END", "min", "greatest").replace("NEAR", _N4) + " SELECT image_id, r, c, CAST(v AS BIGINT) AS out FROM rec")
def fill_gray_holes(spark, d):
    return per_image(V.gray_images(spark, d), lambda a: {"out": K.fill_gray(a).astype(np.int64)}, "out bigint")


_IMPOSED = f"""WITH RECURSIVE {PX}, m AS (SELECT image_id, r, c, CASE WHEN v = lo THEN -1 ELSE v + 1 END AS v, CASE WHEN v = lo THEN -1 ELSE 1000 END AS w FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo FROM px)),
rec(image_id, r, c, v) USING KEY (image_id, r, c) AS (SELECT image_id, r, c, w FROM m UNION (SELECT m.image_id, m.r, m.c, min(greatest(m.v, rec.v)) FROM rec JOIN m ON m.image_id = rec.image_id AND abs(m.r - rec.r) <= 1 AND abs(m.c - rec.c) <= 1 JOIN recurring.rec AS cur ON cur.image_id = m.image_id AND cur.r = m.r AND cur.c = m.c WHERE greatest(m.v, rec.v) < cur.v GROUP BY 1, 2, 3))"""


@query("impose_minima", f"{_IMPOSED} SELECT image_id, r, c, CAST(v AS BIGINT) AS out FROM rec")
def impose_minima(spark, d):
    def run(a):
        imposed = K.impose_minima(a, a == a.min(), whole=True)
        return {"out": np.nan_to_num(imposed, neginf=-1).astype(np.int64)}

    return per_image(V.gray_images(spark, d), run, "out bigint")


_PLATEAU = f"""WITH RECURSIVE {PX}, lab AS (SELECT image_id, r, c, v, c * 25 + r AS k FROM px UNION SELECT p.image_id, p.r, p.c, p.v, l.k FROM lab l JOIN px p ON p.image_id = l.image_id AND p.v = l.v AND abs(p.r - l.r) <= 1 AND abs(p.c - l.c) <= 1 AND l.k < p.c * 25 + p.r),
fin AS (SELECT image_id, r, c, v, min(k) AS k FROM lab GROUP BY 1, 2, 3, 4),
bad AS (SELECT DISTINCT a.image_id, a.k FROM fin a JOIN px b ON b.image_id = a.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.v OP a.v)
SELECT fin.image_id, r, c, bad.k IS NULL AS out FROM fin LEFT JOIN bad ON bad.image_id = fin.image_id AND bad.k = fin.k"""


@query("regional_minima", _PLATEAU.replace("OP", "<"))
def regional_minima(spark, d):
    return per_image(V.gray_images(spark, d), lambda a: {"out": K.regional_minima(a)}, "out boolean")


@query("regional_maxima", _PLATEAU.replace("OP", ">"))
def regional_maxima(spark, d):
    return per_image(V.gray_images(spark, d), lambda a: {"out": K.regional_maxima(a)}, "out boolean")


# --- sets -----------------------------------------------------------------------------------------------------------

_AB = f"{PX}, a AS (SELECT image_id, r, c FROM px WHERE v > 110), b AS (SELECT image_id, r, c FROM px WHERE v % 2 = 0)"


def _ab(spark, d):
    px = V.gray_images(spark, d)
    return px.withColumn("v", F.col("v") > 110), px.withColumn("v", F.col("v") % 2 == 0)


@query("set_union", f"WITH {_AB} SELECT * FROM a UNION SELECT * FROM b")
def set_union(spark, d):
    return S.union(*_ab(spark, d))


@query("set_intersection", f"WITH {_AB} SELECT * FROM a INTERSECT SELECT * FROM b")
def set_intersection(spark, d):
    return S.intersection(*_ab(spark, d))


@query("set_difference", f"WITH {_AB} SELECT * FROM a EXCEPT SELECT * FROM b")
def set_difference(spark, d):
    return S.difference(*_ab(spark, d))


@query("set_complement", f"WITH {_AB} SELECT image_id, r, c FROM px EXCEPT SELECT * FROM a")
def set_complement(spark, d):
    return S.complement(_ab(spark, d)[0])


@query("translate", f"WITH {_AB} SELECT image_id, r + 3 AS r, c - 5 AS c FROM a WHERE r + 3 < 25 AND c >= 5")
def translate(spark, d):
    return S.translate(_ab(spark, d)[0], 3, -5, V.ROWS, V.COLUMNS)


@query("reflect", f"WITH {_AB} SELECT image_id, 24 - r AS r, 39 - c AS c FROM a")
def reflect(spark, d):
    return S.reflect(_ab(spark, d)[0], V.ROWS, V.COLUMNS)


@query("gray_union_intersection", f"WITH {PX} SELECT a.image_id, a.r, a.c, greatest(a.v, b.v) AS joined, least(a.v, b.v) AS shared, a.v & b.v AS bits_and, a.v | b.v AS bits_or FROM px a JOIN px b ON b.image_id = a.image_id AND b.r = 24 - a.r AND b.c = 39 - a.c")
def gray_union_intersection(spark, d):
    px = V.gray_images(spark, d)
    turned = px.select("image_id", (V.ROWS - 1 - F.col("r")).alias("r"), (V.COLUMNS - 1 - F.col("c")).alias("c"), "v")
    a, b = F.col("a"), F.col("b")
    return S.paired(px, turned).select(*KEY, S.gray_union(a, b).alias("joined"), S.gray_intersection(a, b).alias("shared"), a.bitwiseAND(b).alias("bits_and"), a.bitwiseOR(b).alias("bits_or"))


@query("truth_tables", "SELECT a, b, NOT a AS not_a, a OR b AS a_or_b, a AND b AS a_and_b FROM (VALUES (false, false), (false, true), (true, false), (true, true)) t(a, b)")
def truth_tables(spark, d):
    return S.truth_tables(spark)


# --- resampling and tiles -------------------------------------------------------------------------------------------

_GRID = "g AS (SELECT i.image_id, a.range AS r, b.range AS c, least(24.0::DOUBLE, greatest(0.0::DOUBLE, (a.range + 0.5) / 1.5::DOUBLE - 0.5)) AS y, least(39.0::DOUBLE, greatest(0.0::DOUBLE, (b.range + 0.5) / 1.5::DOUBLE - 0.5)) AS x FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(0, 38) a CROSS JOIN range(0, 60) b)"


@query("resize_nearest", f"WITH {PX}, {_GRID} SELECT g.image_id, g.r, g.c, CAST(px.v AS DOUBLE) AS out FROM g JOIN px ON px.image_id = g.image_id AND px.r = floor(g.y + 0.5) AND px.c = floor(g.x + 0.5)")
def resize_nearest(spark, d):
    return R.resize(V.gray_images(spark, d), 1.5, V.ROWS, V.COLUMNS, "nearest")


@query("resize_bilinear", f"WITH {PX}, {_GRID} SELECT g.image_id, g.r, g.c, round(sum(greatest(0, 1 - abs(g.y - px.r)) * greatest(0, 1 - abs(g.x - px.c)) * px.v), 4) AS out FROM g JOIN px ON px.image_id = g.image_id AND px.r BETWEEN floor(g.y) AND floor(g.y) + 1 AND px.c BETWEEN floor(g.x) AND floor(g.x) + 1 GROUP BY 1, 2, 3")
def resize_bilinear(spark, d):
    return rounded(R.resize(V.gray_images(spark, d), 1.5, V.ROWS, V.COLUMNS, "bilinear"), "out", digits=4)


def _keys(x: str) -> str:
    return f"(CASE WHEN abs({x}) <= 1 THEN 1.5::DOUBLE * abs({x}) * abs({x}) * abs({x}) - 2.5::DOUBLE * abs({x}) * abs({x}) + 1 WHEN abs({x}) < 2 THEN -0.5::DOUBLE * abs({x}) * abs({x}) * abs({x}) + 2.5::DOUBLE * abs({x}) * abs({x}) - 4 * abs({x}) + 2 ELSE 0 END)"


@query("resize_bicubic", f"WITH {PX}, {_GRID}, t AS (SELECT g.*, floor(g.y) + a.range - 1 AS tr, floor(g.x) + b.range - 1 AS tc FROM g CROSS JOIN range(0, 4) a CROSS JOIN range(0, 4) b) SELECT t.image_id, t.r, t.c, round(sum({_keys('(t.y - tr)')} * {_keys('(t.x - tc)')} * px.v) + CAST('0.000003' AS DOUBLE), 4) + 0.0 AS out FROM t JOIN px ON px.image_id = t.image_id AND px.r = least(24, greatest(0, tr)) AND px.c = least(39, greatest(0, tc)) GROUP BY 1, 2, 3")
def resize_bicubic(spark, d):
    found = R.resize(V.gray_images(spark, d), 1.5, V.ROWS, V.COLUMNS, "bicubic")
    return rounded(found.withColumn("out", F.col("out") + 0.000003), "out", digits=4)  # off the ties of rounding


@query("warp_shear", f"WITH {PX}, g AS (SELECT i.image_id, a.range AS r, b.range AS c, CAST(a.range AS DOUBLE) AS y, b.range + 0.25::DOUBLE * a.range AS x FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(0, 25) a CROSS JOIN range(0, 40) b) SELECT g.image_id, g.r, g.c, CASE WHEN max(g.x) <= 39 THEN round(sum(greatest(0, 1 - abs(least(39, g.x) - px.c)) * px.v), 4) END AS out FROM g JOIN px ON px.image_id = g.image_id AND px.r = g.r AND px.c BETWEEN floor(least(39, g.x)) AND floor(least(39, g.x)) + 1 GROUP BY 1, 2, 3")
def warp_shear(spark, d):
    return rounded(R.warp(V.gray_images(spark, d), lambda r, c: (r.cast("double"), c + 0.25 * r), V.ROWS, V.COLUMNS), "out", digits=4)




def _tile_values() -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, t)) + ")" for t in TI.tile_grid(25, 40, 16, 4)) + ") t(tile, r0, r1, c0, c1, cr0, cr1, cc0, cc1)"


@query("tile_grid", f"SELECT CAST(tile AS BIGINT) AS tile, CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(cr0 AS BIGINT) AS cr0, CAST(cr1 AS BIGINT) AS cr1, CAST(cc0 AS BIGINT) AS cc0, CAST(cc1 AS BIGINT) AS cc1 FROM {_tile_values()}")
def tile_grid(spark, d):
    return TI.tile_table(spark, 25, 40, 16, 4)


@query("tile_pixels", f"WITH {PX} SELECT image_id, CAST(tile AS BIGINT) AS tile, r, c, v, r >= cr0 AND r < cr1 AND c >= cc0 AND c < cc1 AS in_core FROM px JOIN {_tile_values()} ON r >= r0 AND r < r1 AND c >= c0 AND c < c1")
def tile_pixels(spark, d):
    return TI.to_tiles(V.gray_images(spark, d), 25, 40, 16, 4).select("image_id", "tile", "r", "c", "v", "in_core")


@query("tile_stitch_crop", f"WITH {PX} SELECT image_id, r, c, v FROM px")
def tile_stitch_crop(spark, d):
    return TI.stitch(TI.to_tiles(V.gray_images(spark, d), 25, 40, 16, 4))


@query("tile_stitch_max", f"WITH {PX} SELECT image_id, r, c, CAST(max(v + tile) AS BIGINT) AS v FROM px JOIN {_tile_values()} ON r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY 1, 2, 3")
def tile_stitch_max(spark, d):
    tiled = TI.to_tiles(V.gray_images(spark, d), 25, 40, 16, 4)
    return TI.stitch(tiled.withColumn("v", F.col("v") + F.col("tile")), how="max")


@query("tile_stitch_first", f"WITH {PX} SELECT image_id, r, c, CAST(min(tile) * 1000 + max(v) AS BIGINT) AS v FROM px JOIN {_tile_values()} ON r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY 1, 2, 3")
def tile_stitch_first(spark, d):
    tiled = TI.to_tiles(V.gray_images(spark, d), 25, 40, 16, 4)
    return TI.stitch(tiled.withColumn("v", F.col("v") + F.col("tile") * 1000), how="first")


@query("homomorphic_filter")
def homomorphic_filter(spark, d):
    found = per_image(V.gray_images(spark, d), lambda a: {"out": K.homomorphic(a)}, "out double")
    return rounded(found, "out", digits=4)


def _mapped(r: str, c: str) -> str:
    return f"WITH {PX} SELECT p.image_id, p.r, p.c, round(sum(q.v * w), 6) AS out FROM px p CROSS JOIN {_weights(_K)} JOIN px q ON q.image_id = p.image_id AND q.r = {r} AND q.c = {c} GROUP BY 1, 2, 3"


@query("correlate_symmetric", _mapped("least(24, greatest(0, p.r + dr))", "least(39, greatest(0, p.c + dc))"))
def correlate_symmetric(spark, d):
    return rounded(N.correlate_padded(V.gray_images(spark, d), _K, V.ROWS, V.COLUMNS).select(*KEY, "out"), "out")


@query("correlate_circular", _mapped("(p.r + dr + 25) % 25", "(p.c + dc + 40) % 40"))
def correlate_circular(spark, d):
    return rounded(N.correlate_padded(V.gray_images(spark, d), _K, V.ROWS, V.COLUMNS, "circular").select(*KEY, "out"), "out")


@query("correlate_constant", f"WITH {PX}, n7 AS (SELECT p.image_id, p.r, p.c, o.dr, o.dc, coalesce(q.v, 7) AS v FROM px p CROSS JOIN {_OFF} o LEFT JOIN px q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc) SELECT image_id, r, c, round(sum(v * w), 6) AS out FROM n7 JOIN {_weights(_K)} USING (dr, dc) GROUP BY 1, 2, 3")
def correlate_constant(spark, d):
    return rounded(N.correlate_padded(V.gray_images(spark, d), _K, V.ROWS, V.COLUMNS, "constant", 7.0).select(*KEY, "out"), "out")


@query("internal_gradient_radii", f"WITH {PX} SELECT p.image_id, CAST(k.range AS BIGINT) AS radius, p.r, p.c, CAST(max(p.v) - min(q.v) AS BIGINT) AS internal FROM px p CROSS JOIN range(1, 3) k JOIN px q ON q.image_id = p.image_id AND (q.r - p.r) * (q.r - p.r) + (q.c - p.c) * (q.c - p.c) <= k.range * k.range GROUP BY 1, 2, 3, 4")
def internal_gradient_radii(spark, d):
    px = V.gray_images(spark, d)
    each = [M.gradient(px, M.disk(k)).select("image_id", F.lit(k).cast("bigint").alias("radius"), "r", "c", "internal") for k in (1, 2)]
    return each[0].unionByName(each[1])


_OCTAGON = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in M.disk_by_lines(3)) + ") se(dr, dc)"


@query("octagon_opening", f"WITH {PX}, e AS (SELECT p.image_id, p.r, p.c, min(q.v) AS v FROM px p CROSS JOIN {_OCTAGON} JOIN px q ON q.image_id = p.image_id AND q.r = p.r + dr AND q.c = p.c + dc GROUP BY 1, 2, 3) SELECT p.image_id, p.r, p.c, CAST(max(q.v) AS BIGINT) AS out FROM e p CROSS JOIN {_OCTAGON} JOIN e q ON q.image_id = p.image_id AND q.r = p.r - dr AND q.c = p.c - dc GROUP BY 1, 2, 3")
def octagon_opening(spark, d):
    return M.opening(V.gray_images(spark, d), M.disk_by_lines(3)).select(*KEY, "out")


@query("reconstruct_iterative", _spread("greatest(v - 40, 0)", "max", "least").replace("NEAR", _N8) + " SELECT image_id, r, c, CAST(v AS BIGINT) AS v FROM rec")
def reconstruct_iterative(spark, d):
    from gridloom.operators.iterative import reconstruct_by_steps

    px = V.gray_images(spark, d)
    marker = px.withColumn("v", F.greatest(F.col("v") - 40, F.lit(0)))
    return reconstruct_by_steps(marker, px)[0]


_GROW = "WITH RECURSIVE {px}, o AS (SELECT image_id, r, c FROM px WHERE {on}), g(image_id, r, c) AS (SELECT image_id, r, c FROM o WHERE r BETWEEN 10 AND 14 AND c = 20 UNION SELECT o.image_id, o.r, o.c FROM g JOIN o ON o.image_id = g.image_id AND {near})"


@query("grow_from_seeds", _GROW.format(px=PX, on="v > 30", near="abs(o.r - g.r) <= 1 AND abs(o.c - g.c) <= 1") + " SELECT image_id, r, c FROM g")
def grow_from_seeds(spark, d):
    from gridloom.operators.iterative import grow_from_seeds as grow

    mask = V.masks(spark, d, 30)
    return grow(mask, mask.where("r between 10 and 14 and c = 20")).select(*KEY)


@query("fill_from_seeds", _GROW.format(px=PX, on="v <= 30", near="abs(o.r - g.r) + abs(o.c - g.c) = 1") + " SELECT image_id, r, c FROM g UNION SELECT image_id, r, c FROM px WHERE v > 30")
def fill_from_seeds(spark, d):
    from gridloom.operators.iterative import fill_from_seeds as fill

    mask = V.masks(spark, d, 30)
    return fill(mask, mask.where("r between 10 and 14 and c = 20"))
