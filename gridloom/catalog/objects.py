"""Components, regions, contours, distances, watersheds, pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.registry import MASK, least_rectangle_sql, query, r6, rounded
from gridloom.operators import kernels as K
from gridloom.operators import regions as G
from gridloom.operators.rasters import per_image, rows_per_image
from gridloom.plans import pieces as P
from gridloom.plans import watersheds as W
from gridloom.sources import virtual as V

KEY = ["image_id", "r", "c"]


def components(near: str, mask: str = MASK) -> str:
    """SQL for components: least column-order index of each pixel's component, then numbered from 1."""
    return f"""WITH RECURSIVE {mask}, o AS (SELECT image_id, r, c FROM mask WHERE v), lab AS (SELECT image_id, r, c, c * 25 + r AS k FROM o UNION SELECT o.image_id, o.r, o.c, lab.k FROM lab JOIN o ON o.image_id = lab.image_id AND {near} AND lab.k < o.c * 25 + o.r),
comp AS (SELECT image_id, r, c, min(k) AS k FROM lab GROUP BY 1, 2, 3), num AS (SELECT image_id, r, c, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY k) AS BIGINT) AS label FROM comp)"""


NEAR4 = "abs(o.r - lab.r) + abs(o.c - lab.c) = 1"
NEAR8 = "abs(o.r - lab.r) <= 1 AND abs(o.c - lab.c) <= 1"


def _labels(spark, d, conn=4):
    return G.label_images(V.masks(spark, d), conn)


@query("components_4", f"{components(NEAR4)} SELECT mask.image_id, mask.r, mask.c, coalesce(num.label, 0) AS label FROM mask LEFT JOIN num ON num.image_id = mask.image_id AND num.r = mask.r AND num.c = mask.c")
def components_4(spark, d):
    return _labels(spark, d, 4)


@query("components_8", f"{components(NEAR8)} SELECT mask.image_id, mask.r, mask.c, coalesce(num.label, 0) AS label FROM mask LEFT JOIN num ON num.image_id = mask.image_id AND num.r = mask.r AND num.c = mask.c")
def components_8(spark, d):
    return _labels(spark, d, 8)


@query("components_tiled", f"{components(NEAR8)} SELECT image_id, r, c, label FROM num")
def components_tiled(spark, d):
    return G.label_tiled(V.masks(spark, d), 10, 8)


@query("component_count", f"{components(NEAR8)} SELECT image_id, max(label) AS n FROM num GROUP BY 1")
def component_count(spark, d):
    return G.component_count(_labels(spark, d, 8))


@query("area_open", f"{components(NEAR8)}, s AS (SELECT image_id, label FROM num GROUP BY 1, 2 HAVING count(*) >= 3) SELECT num.image_id, r, c, num.label FROM num JOIN s ON s.image_id = num.image_id AND s.label = num.label")
def area_open(spark, d):
    return G.area_open(_labels(spark, d, 8), 3)


@query("region_boundary", f"WITH {MASK}, o AS (SELECT * FROM mask WHERE v), k AS (SELECT p.image_id, p.r, p.c, count(*) FILTER (abs(p.r - q.r) + abs(p.c - q.c) = 1) AS n4, count(*) AS n9 FROM o p JOIN o q ON q.image_id = p.image_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 GROUP BY 1, 2, 3) SELECT image_id, r, c, n4 < 4 AS by_4, n9 < 9 AS by_8 FROM k")
def region_boundary(spark, d):
    mask = V.masks(spark, d)
    four = G.boundary_mask(mask, 4).where("v").select(*KEY, F.col("on_boundary").alias("by_4"))
    eight = G.boundary_mask(mask, 8).where("v").select(*KEY, F.col("on_boundary").alias("by_8"))
    return four.join(eight, KEY)


@query("neighbour_degree", f"WITH {MASK}, o AS (SELECT * FROM mask WHERE v) SELECT p.image_id, p.r, p.c, CAST(count(*) FILTER (abs(p.r - q.r) + abs(p.c - q.c) = 1) AS BIGINT) AS n4, CAST(count(*) FILTER (abs(p.r - q.r) = 1 AND abs(p.c - q.c) = 1) AS BIGINT) AS nd, CAST(count(*) - 1 AS BIGINT) AS n8 FROM o p JOIN o q ON q.image_id = p.image_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 GROUP BY 1, 2, 3")
def neighbour_degree(spark, d):
    return G.neighbour_degree(V.masks(spark, d))


@query("mixed_adjacency", f"WITH {MASK}, o AS (SELECT * FROM mask WHERE v) SELECT p.image_id, p.r, p.c, q.r AS r2, q.c AS c2 FROM o p JOIN o q ON q.image_id = p.image_id AND ((q.r = p.r AND q.c = p.c + 1) OR (q.r = p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1)) WHERE q.r = p.r OR q.c = p.c OR NOT EXISTS (SELECT 1 FROM o s WHERE s.image_id = p.image_id AND ((s.r = p.r AND s.c = q.c) OR (s.r = q.r AND s.c = p.c)))")
def mixed_adjacency(spark, d):
    return G.mixed_adjacency(V.masks(spark, d))


@query("simple_paths")
def simple_paths(spark, d):
    def run(a):
        import pandas as pd

        end = (a.shape[0] - 1, a.shape[1] - 1)
        return pd.DataFrame({"n_paths": [len(K.simple_paths(a, (0, 0), end, 4, 200))]})

    return rows_per_image(V.masks(spark, d, 5), run, "n_paths bigint")


_STATS = "SELECT image_id, label, CAST(count(*) AS BIGINT) AS area, round(avg(c), 6) AS cx, round(avg(r), 6) AS cy, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c FROM num GROUP BY 1, 2"


@query("region_basic", f"{components(NEAR4)} {_STATS}")
def region_basic(spark, d):
    return rounded(G.measures(_labels(spark, d)).select("image_id", "label", "area", "cx", "cy", "min_r", "max_r", "min_c", "max_c"), "cx", "cy")


@query("region_ellipse", f"""{components(NEAR4)}, s AS (SELECT image_id, label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(c) AS DOUBLE) AS sx, CAST(sum(r) AS DOUBLE) AS sy, CAST(sum(c * c) AS DOUBLE) AS sxx, CAST(sum(r * r) AS DOUBLE) AS syy, CAST(sum(c * r) AS DOUBLE) AS sxy FROM num GROUP BY 1, 2),
u AS (SELECT image_id, label, (sxx * n - sx * sx) / (n * n) + 1 / 12.0::DOUBLE AS xx, (syy * n - sy * sy) / (n * n) + 1 / 12.0::DOUBLE AS yy, -(sxy * n - sx * sy) / (n * n) AS xy FROM s),
a AS (SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS q FROM u) SELECT image_id, label, round(2 * sqrt(2.0::DOUBLE) * sqrt(xx + yy + q), 5) AS major, round(2 * sqrt(2.0::DOUBLE) * sqrt(greatest(xx + yy - q, 0)), 5) AS minor FROM a""")
def region_ellipse(spark, d):
    return rounded(G.measures(_labels(spark, d)).select("image_id", "label", "major", "minor"), "major", "minor", digits=5)


@query("region_orientation", f"""{components(NEAR4)}, s AS (SELECT image_id, label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(c) AS DOUBLE) AS sx, CAST(sum(r) AS DOUBLE) AS sy, CAST(sum(c * c) AS DOUBLE) AS sxx, CAST(sum(r * r) AS DOUBLE) AS syy, CAST(sum(c * r) AS DOUBLE) AS sxy FROM num GROUP BY 1, 2),
u AS (SELECT image_id, label, (sxx * n - sx * sx) / (n * n) + 1 / 12.0::DOUBLE AS xx, (syy * n - sy * sy) / (n * n) + 1 / 12.0::DOUBLE AS yy, -(sxy * n - sx * sy) / (n * n) AS xy FROM s),
a AS (SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS q FROM u), t AS (SELECT image_id, label, CASE WHEN yy > xx THEN yy - xx + q ELSE 2 * xy END AS top, CASE WHEN yy > xx THEN 2 * xy ELSE xx - yy + q END AS bottom, sqrt(greatest(0, 1 - (xx + yy - q) / (xx + yy + q))) AS ecc FROM a)
SELECT image_id, label, round(ecc, 4) + 0.0 AS eccentricity, round(CASE WHEN top = 0 AND bottom = 0 THEN 0.0::DOUBLE WHEN bottom = 0 THEN sign(top) * 90.0::DOUBLE ELSE atan(top / bottom) * 180.0::DOUBLE / 3.141592653589793::DOUBLE END, 4) + 0.0 AS orientation FROM t""")
def region_orientation(spark, d):
    return rounded(G.measures(_labels(spark, d)).select("image_id", "label", "eccentricity", "orientation"), "eccentricity", "orientation", digits=4)


@query("region_shapes")
def region_shapes(spark, d):
    return rounded(G.shape_measures(_labels(spark, d, 8)), "solidity", "perimeter", "long_side", "short_side", digits=4)


@query("split_criteria")
def split_criteria(spark, d):
    labels = _labels(spark, d, 8)
    return rounded(G.to_split(G.shape_measures(labels), G.measures(labels), 6, 0.9, 2.0), "solidity", "ratio", digits=4)


_OPEN = components(NEAR4, MASK.replace("v > 110 AS v", "NOT v > 30 AS v"))


@query("fill_holes", f"{_OPEN}, op AS (SELECT DISTINCT image_id, label FROM num WHERE r IN (0, 24) OR c IN (0, 39)) SELECT mask.image_id, mask.r, mask.c, op.label IS NULL AS v FROM mask LEFT JOIN num ON num.image_id = mask.image_id AND num.r = mask.r AND num.c = mask.c LEFT JOIN op ON op.image_id = num.image_id AND op.label = num.label")
def fill_holes(spark, d):
    return G.fill_holes(V.masks(spark, d, 30))


for _metric, _expr in {"cityblock": "abs(p.r - q.r) + abs(p.c - q.c)", "chessboard": "greatest(abs(p.r - q.r), abs(p.c - q.c))", "euclidean": "sqrt(CAST((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) AS DOUBLE))", "quasi": "greatest(abs(p.r - q.r), abs(p.c - q.c)) + (sqrt(2.0::DOUBLE) - 1) * least(abs(p.r - q.r), abs(p.c - q.c))"}.items():

    def _distance(spark, d, metric=_metric):
        return rounded(per_image(V.masks(spark, d, 20), lambda a: {"distance": K.distance(a, metric)}, "distance double"), "distance")

    query(f"distance_{_metric}", f"WITH {MASK.replace('> 110', '> 20')} SELECT p.image_id, p.r, p.c, CASE WHEN max(CAST(p.v AS INT)) = 0 THEN 0.0::DOUBLE ELSE round(CAST(min({_expr}) AS DOUBLE), 6) END AS distance FROM mask p JOIN mask q ON q.image_id = p.image_id AND NOT q.v GROUP BY 1, 2, 3")(_distance)


# --- contours -------------------------------------------------------------------------------------------------------


def _blobs(spark):
    return G.label_images(V.blob_images(spark), 8)


#: The generated masks in SQL, their components by least first pixel, and each contour's walk: from a point, the first
#: object pixel clockwise after where it came from; d is the step taken, 0 east and clockwise.
_WALK = f"""WITH RECURSIVE disk(i, y, x, q) AS (VALUES {", ".join(map(str, V.blob_disks()))}), mask AS (SELECT i.range AS image_id, r.range AS r, c.range AS c FROM range(0, 4) i, range(0, 60) r, range(0, 90) c),
obj AS (SELECT DISTINCT m.image_id, m.r, m.c FROM mask m JOIN disk d ON d.i = m.image_id AND (m.r - d.y) * (m.r - d.y) + (m.c - d.x) * (m.c - d.x) <= d.q * d.q),
lab(image_id, r, c, k) USING KEY (image_id, r, c) AS (SELECT image_id, r, c, c * 60 + r FROM obj UNION (SELECT o.image_id, o.r, o.c, min(l.k) FROM lab l JOIN obj o ON o.image_id = l.image_id AND abs(o.r - l.r) <= 1 AND abs(o.c - l.c) <= 1 JOIN recurring.lab cur ON cur.image_id = o.image_id AND cur.r = o.r AND cur.c = o.c WHERE l.k < cur.k GROUP BY 1, 2, 3)),
o AS (SELECT image_id, r, c, k, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY k) AS BIGINT) AS label FROM lab),
s AS (SELECT image_id, label, min(k) % 60 AS r0, min(k) // 60 AS c0 FROM o GROUP BY 1, 2),
way(w, dr, dc) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)),
turn AS (SELECT o.image_id, o.label, o.r, o.c, (w - i.range + 8) % 8 AS came, i.range AS nth, w FROM o JOIN way ON TRUE JOIN range(1, 9) i ON TRUE JOIN o p ON p.image_id = o.image_id AND p.label = o.label AND p.r = o.r + dr AND p.c = o.c + dc),
nxt AS (SELECT image_id, label, r, c, came, arg_min(w, nth) AS d FROM turn GROUP BY 1, 2, 3, 4, 5),
walk(image_id, label, seq, r, c, d, r0, c0, d0) AS (SELECT n.image_id, n.label, CAST(0 AS BIGINT), n.r, n.c, n.d, s.r0, s.c0, n.d FROM s JOIN nxt n ON n.image_id = s.image_id AND n.label = s.label AND n.r = s.r0 AND n.c = s.c0 AND n.came = 4
UNION ALL SELECT n.image_id, n.label, t.seq + 1, n.r, n.c, n.d, t.r0, t.c0, t.d0 FROM walk t JOIN way ON way.w = t.d JOIN nxt n ON n.image_id = t.image_id AND n.label = t.label AND n.r = t.r + way.dr AND n.c = t.c + way.dc AND n.came = (t.d + 4 + t.d % 2) % 8 WHERE NOT (t.seq > 0 AND t.r = t.r0 AND t.c = t.c0 AND t.d = t.d0))"""
_CHAIN = f"""{_WALK}, code AS (SELECT image_id, label, seq, r, c, CAST((8 - d) % 8 AS BIGINT) AS code FROM walk WHERE NOT (seq > 0 AND r = r0 AND c = c0 AND d = d0)),
chain AS (SELECT *, (coalesce(lead(code) OVER w, first_value(code) OVER w) - code + 8) % 8 AS diff, (code - coalesce(lag(code) OVER w, last_value(code) OVER (PARTITION BY image_id, label ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) + 8) % 8 AS raw FROM code WINDOW w AS (PARTITION BY image_id, label ORDER BY seq))"""


@query("contours", f"{_WALK} SELECT image_id, label, seq, r, c FROM walk")
def contours(spark, d):
    return G.contours(_blobs(spark))


@query("chain_codes", f"{_CHAIN} SELECT image_id, label, seq, r, c, code, diff FROM chain")
def chain_codes(spark, d):
    return G.chain_codes(G.contours(_blobs(spark))).select("image_id", "label", "seq", "r", "c", "code", "diff")


_LEAST = "list_min(list_transform(range(0, len({0})), lambda k: {0}[k + 1:] || {0}[:k]))"


@query("chain_strings", f"{_CHAIN}, f AS (SELECT image_id, label, string_agg(CAST(code AS VARCHAR), '' ORDER BY seq) AS code, string_agg(CAST(diff AS VARCHAR), '' ORDER BY seq) AS diff, string_agg(CAST((code + 4) % 8 AS VARCHAR), '' ORDER BY seq DESC) AS reversed FROM chain GROUP BY 1, 2) SELECT image_id, label, code, {_LEAST.format('code')} AS min_code, {_LEAST.format('diff')} AS min_diff, reversed FROM f")
def chain_strings(spark, d):
    s = G.code_strings(G.chain_codes(G.contours(_blobs(spark))))
    return s.select("image_id", "label", *[F.array_join(k, "").alias(k) for k in ("code", "min_code", "min_diff", "reversed")])


@query("chain_decoded", f"{_CHAIN} SELECT image_id, label, seq, r, c FROM chain")
def chain_decoded(spark, d):
    return G.decoded(G.chain_codes(G.contours(_blobs(spark))))


@query("concave_points", f"""{_CHAIN}, u AS (SELECT *, sum(CASE WHEN raw > 4 THEN raw - 8 ELSE raw END) OVER (PARTITION BY image_id, label ORDER BY seq) AS a FROM chain), l AS (SELECT image_id, label, list(a ORDER BY seq) AS a, count(*) AS n, arg_max(a, seq) AS whole FROM u GROUP BY 1, 2 HAVING count(*) >= 6),
v AS (SELECT u.image_id, u.label, u.seq, u.r, u.c, l.n, l.whole, u.a + CASE WHEN u.seq >= 1 THEN l.a[u.seq] ELSE l.a[n] - whole END + CASE WHEN u.seq >= 2 THEN l.a[u.seq - 1] ELSE l.a[n + u.seq - 1] - whole END AS s FROM u JOIN l ON l.image_id = u.image_id AND l.label = u.label)
SELECT p.image_id, p.label, p.seq, p.r, p.c, CAST(q.s + CASE WHEN p.seq + 3 >= p.n THEN 3 * p.whole ELSE 0 END - p.s AS BIGINT) AS change FROM v p JOIN v q ON q.image_id = p.image_id AND q.label = p.label AND q.seq = (p.seq + 3) % p.n WHERE q.s + CASE WHEN p.seq + 3 >= p.n THEN 3 * p.whole ELSE 0 END - p.s BETWEEN 3 AND 10""")
def concave_points(spark, d):
    return G.concave_points(G.chain_codes(G.contours(_blobs(spark))))


# --- watersheds -----------------------------------------------------------------------------------------------------


@query("direct_watershed")
def direct_watershed(spark, d):
    return W.direct_watershed(V.gray_images(spark, d))


@query("immersion_watershed")
def immersion_watershed(spark, d):
    return W.immersion_watershed(V.gray_images(spark, d).withColumn("v", F.expr("v div 16")))


@query("gradient_watershed")
def gradient_watershed(spark, d):
    return W.gradient_watershed(V.gray_images(spark, d))


@query("distance_watershed")
def distance_watershed(spark, d):
    return W.distance_watershed(V.blob_images(spark))


@query("marker_watershed")
def marker_watershed(spark, d):
    return W.marker_watershed(V.blob_images(spark))


@query("merge_regions")
def merge_regions(spark, d):
    return W.merge_regions(V.blob_images(spark))


@query("line_junctions", f"WITH {MASK}, o AS (SELECT * FROM mask WHERE v) SELECT p.image_id, p.r, p.c, CAST(count(*) - 1 AS BIGINT) AS links, count(*) <= 2 AS is_end FROM o p JOIN o q ON q.image_id = p.image_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 GROUP BY 1, 2, 3")
def line_junctions(spark, d):
    return W.junctions(V.masks(spark, d))


# --- pieces ---------------------------------------------------------------------------------------------------------

def _levels(spark, d):
    """Light, dark and other from the blobs: dark where a second mask overlaps none of the first."""
    blobs = V.blob_images(spark)
    dark = (F.col("r") * 7 + F.col("c") * 5 + F.col("image_id")) % 23 < 2
    return blobs.select(*KEY, F.when(F.col("v"), 1.0).when(dark, 0.5).otherwise(0.0).alias("level"), (F.col("v") | dark | ((F.col("c") > 70) & (F.col("r") < 9))).alias("ice"))


@query("force_field")
def force_field(spark, d):
    return rounded(P.force_field(V.gray_images(spark, d), steps=20), "u", "v", digits=4)


@query("split_contours")
def split_contours(spark, d):
    blobs = V.blob_images(spark)
    images = blobs.select(*KEY, F.when(F.col("v"), 200).otherwise(40).cast("bigint").alias("v"), F.col("v").alias("mask"))
    return P.split_contours(images, most_area=150, iterations=15)


@query("two_layers")
def two_layers(spark, d):
    return P.two_layers(V.gray_images(spark, d), most_area=60, iterations=10, rounds=1)


@query("shape_enhancement")
def shape_enhancement(spark, d):
    return P.enhance_shapes(_levels(spark, d))


@query("classify_pieces")
def classify_pieces(spark, d):
    levels = _levels(spark, d)
    return P.classify(levels, P.enhance_shapes(levels))


@query("coverage_fractions")
def coverage_fractions(spark, d):
    levels = _levels(spark, d)
    return rounded(P.coverages(P.classify(levels, P.enhance_shapes(levels))), "floe", "brash", "slush", "water")


@query("classify_sizes", f"{components(NEAR8)} SELECT image_id, label, CAST(count(*) AS BIGINT) AS area, CASE WHEN count(*) >= 4 THEN 'floe' WHEN count(*) >= 2 THEN 'brash' ELSE 'residue' END AS kind, CAST(floor(10000.0::DOUBLE * (1 - exp(-count(*) / 1000.0::DOUBLE))) AS BIGINT) AS colour FROM num GROUP BY 1, 2")
def classify_sizes(spark, d):
    return P.classify_sizes(_labels(spark, d, 8), 4, 2)


@query("field_document")
def field_document(spark, d):
    levels = _levels(spark, d)
    doc = P.field_document(P.classify(levels, P.enhance_shapes(levels)))
    return doc.select("image_id", r6(F.col("floe")).alias("floe"), r6(F.col("water")).alias("water"), F.size("floes").alias("n_floes"), F.size("disks").alias("n_brash"), r6(F.aggregate("floes", F.lit(0.0), lambda s, f: s + f["polygon_area"]), 3).alias("polygon_area"))


@query("document_pieces")
def document_pieces(spark, d):
    levels = _levels(spark, d)
    return rounded(P.pieces_of(P.field_document(P.classify(levels, P.enhance_shapes(levels)))), "cx", "cy", digits=4)


#: Mid-edge points of the contours' pixels: their hull is that of all pixels.
_RECTS = f"""{_WALK}, pts AS (SELECT image_id, label, c + CAST(dx AS DOUBLE) AS x, r + CAST(dy AS DOUBLE) AS y FROM walk CROSS JOIN (VALUES (0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)) m(dx, dy)), {least_rectangle_sql('pts', 'image_id, label')},
rect AS (SELECT image_id, label, (h0 - l0) * (h1 - l1) AS area, 2 * (h0 - l0 + h1 - l1) AS perimeter, (h0 - l0) / (h1 - l1) AS ratio, (l0 + h0) / 2 * co - (l1 + h1) / 2 * si AS cx, (l0 + h0) / 2 * si + (l1 + h1) / 2 * co AS cy FROM box)"""


@query("rectangles", f"{_RECTS} SELECT image_id, label, round(area, 3) AS area, round(perimeter, 3) AS perimeter, round(ratio, 3) AS ratio, round(cx, 3) AS cx, round(cy, 3) AS cy FROM rect")
def rectangles(spark, d):
    return rounded(P.rectangles(_blobs(spark)), "area", "perimeter", "ratio", "cx", "cy", digits=3).drop("ring")


@query("rectangle_overlaps")
def rectangle_overlaps(spark, d):
    return rounded(P.rectangle_model(P.rectangles(_blobs(spark)))[1], "shared", digits=3)


@query("rectangle_concentration", f"{_RECTS} SELECT image_id, round(sum(area) / 5400.0::DOUBLE, 4) AS concentration FROM rect WHERE ratio > 0.4 AND ratio < 2.5 GROUP BY 1")
def rectangle_concentration(spark, d):
    kept, _ = P.rectangle_model(P.rectangles(_blobs(spark)))
    return kept.groupBy("image_id").agg(r6(F.sum("area") / (60.0 * 90.0), 4).alias("concentration"))


@query("tiled_segmentation")
def tiled_segmentation(spark, d):
    from gridloom.operators import tiles as TI

    tiled = P.tiled_layers(TI.to_tiles(V.gray_images(spark, d), 25, 40, 16, 4))
    return TI.stitch(tiled)


@query("painted_contours", f"{_WALK} SELECT DISTINCT image_id, label, r - min(r) OVER (PARTITION BY image_id, label) AS r, c - min(c) OVER (PARTITION BY image_id, label) AS c FROM walk")
def painted_contours(spark, d):
    return G.painted(G.contours(_blobs(spark)))


@query("border_marker", f"WITH {MASK} SELECT image_id, r, c, NOT v AND (r IN (0, 24) OR c IN (0, 39)) AS v FROM mask")
def border_marker(spark, d):
    return G.border_marker(V.masks(spark, d))


@query("classic_snake")
def classic_snake(spark, d):
    from gridloom.sources.generated import u_shape

    px = u_shape(spark).select(*KEY, F.when(F.col("v"), 200).otherwise(30).cast("bigint").alias("v"))
    return rounded(P.classic_snake(px, 32.0, 32.0, 28.0), "x", "y", digits=3)


@query("tank_rectangles")
def tank_rectangles(spark, d):
    from gridloom.operators.thresholds import otsu_mask
    from gridloom.sources.generated import tank

    labels = G.label_images(otsu_mask(tank(spark)), 4)
    kept, shared = P.rectangle_model(P.rectangles(G.area_open(labels, 8)))
    return kept.groupBy("image_id").agg(F.count("*").alias("n"), r6(F.sum("area"), 3).alias("area"))


_SHAPES = "box AS (SELECT p_partkey AS id, p_partkey % 2 AS image_id, CAST(p_partkey % 100 AS DOUBLE) AS x0, CAST(p_partkey // 100 AS DOUBLE) AS y0, CAST(p_partkey % 100 + p_size % 5 + 1 AS DOUBLE) AS x1, CAST(p_partkey // 100 + p_size % 7 + 1 AS DOUBLE) AS y1, (p_size % 5 + 1) / 4.0::DOUBLE AS radius FROM part)"


@query("piece_overlaps", f"WITH {_SHAPES} SELECT CAST(0 AS BIGINT) AS image_id, a.id AS a_id, 'floe' AS a_kind, b.id AS b_id, 'floe' AS b_kind FROM box a JOIN box b ON a.image_id = 0 AND b.image_id = 0 AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND NOT (a.x0 > b.x0 AND a.x1 < b.x1 AND a.y0 > b.y0 AND a.y1 < b.y1) AND NOT (b.x0 > a.x0 AND b.x1 < a.x1 AND b.y0 > a.y0 AND b.y1 < a.y1) UNION ALL SELECT CAST(1 AS BIGINT), a.id, 'brash', b.id, 'brash' FROM box a JOIN box b ON a.image_id = 1 AND b.image_id = 1 AND a.id < b.id AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) < (a.radius + b.radius) * (a.radius + b.radius)")
def piece_overlaps(spark, d):
    """Even parts as square floes, odd ones as brash disks at their corner."""
    from gridloom.operators import geometry as GE

    b = V.boxes(spark, d).join(V.table(spark, d, "part").select(F.col("p_partkey").alias("box_id"), ((F.col("p_size") % 5 + 1) / 4.0).alias("radius")), "box_id")
    x, y = F.col("x0").cast("double"), F.col("y0").cast("double")
    corners = GE.ring_of_box(*[F.col(k) for k in ("x0", "y0", "x1", "y1")])
    ring = F.when(F.col("box_id") % 2 == 0, corners).otherwise(GE.ring_of_box(x - F.col("radius"), y - F.col("radius"), x + F.col("radius"), y + F.col("radius")))
    kind = F.when(F.col("box_id") % 2 == 0, "floe").otherwise("brash")
    shapes = b.select((F.col("box_id") % 2).alias("image_id"), F.col("box_id").alias("id"), kind.alias("kind"), x.alias("x"), y.alias("y"), "radius", ring.alias("ring"))
    return P.overlaps(shapes, 8.0)


@query("field_overlaps")
def field_overlaps(spark, d):
    levels = _levels(spark, d)
    return P.overlaps(P.outlines(P.classify(levels, P.enhance_shapes(levels))), nested=True)
