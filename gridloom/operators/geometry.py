"""Polygons, boxes and disks; overlap pairs by a grid join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators.rasters import dealt_by


def ring_of_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Open ring of a box, counter-clockwise."""
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e))


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: e["x"] * e["v"] - e["u"] * e["y"]) / 2.0


def polygon_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_moments(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """area, centroid, perimeter, second moments about the centroid and principal axes by boundary integrals."""
    e = _edges(F.col(ring))
    cross = lambda q: q["x"] * q["v"] - q["u"] * q["y"]
    base = polygons.withColumns({"_a": _sum(e, cross) / 2.0, "_e": e})
    sums = base.withColumns(
        {
            "_cx": _sum(F.col("_e"), lambda q: (q["x"] + q["u"]) * cross(q)) / (6.0 * F.col("_a")),
            "_cy": _sum(F.col("_e"), lambda q: (q["y"] + q["v"]) * cross(q)) / (6.0 * F.col("_a")),
            "perimeter": _sum(F.col("_e"), lambda q: F.sqrt((q["u"] - q["x"]) * (q["u"] - q["x"]) + (q["v"] - q["y"]) * (q["v"] - q["y"]))),
            "_xx": _sum(F.col("_e"), lambda q: (q["x"] * q["x"] + q["x"] * q["u"] + q["u"] * q["u"]) * cross(q)) / 12.0,
            "_yy": _sum(F.col("_e"), lambda q: (q["y"] * q["y"] + q["y"] * q["v"] + q["v"] * q["v"]) * cross(q)) / 12.0,
            "_xy": _sum(F.col("_e"), lambda q: (q["x"] * q["v"] + 2 * q["x"] * q["y"] + 2 * q["u"] * q["v"] + q["u"] * q["y"]) * cross(q)) / 24.0,
        }
    )
    sign, a = F.signum("_a"), F.abs("_a")
    ixx, iyy, ixy = sign * F.col("_yy") - a * F.col("_cy") * F.col("_cy"), sign * F.col("_xx") - a * F.col("_cx") * F.col("_cx"), sign * F.col("_xy") - a * F.col("_cx") * F.col("_cy")
    out = sums.withColumns({"area": a, "cx": F.col("_cx"), "cy": F.col("_cy"), "ixx": ixx, "iyy": iyy, "ixy": ixy})
    half, off = (F.col("ixx") + F.col("iyy")) / 2, F.sqrt(F.pow((F.col("ixx") - F.col("iyy")) / 2, F.lit(2)) + F.col("ixy") * F.col("ixy"))
    return out.withColumns({"principal_low": half - off, "principal_high": half + off}).drop("_a", "_e", "_cx", "_cy", "_xx", "_yy", "_xy")


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within a ring, by the parity of crossings of a ray to the right."""
    crossing = lambda e: ((e["y"] > y) != (e["v"] > y)) & (x < (e["u"] - e["x"]) * F.try_divide(y - e["y"], e["v"] - e["y"]) + e["x"])
    hits = F.aggregate(_edges(ring), F.lit(0), lambda s, e: s + F.when(crossing(e), 1).otherwise(0))
    return hits % 2 == 1


def rectangle_ratio(ring: Column) -> Column:
    """First side over second side, as drawn."""
    p = lambda i: ring[i]
    side = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.try_divide(side(p(0), p(1)), side(p(1), p(2)))


def in_band(ring: Column, low: float = 0.4, high: float = 2.5) -> Column:
    k = rectangle_ratio(ring)
    return F.coalesce((k > low) & (k < high), F.lit(True))


def grid_pairs(left: DataFrame, right: DataFrame, size: float, condition: Column) -> DataFrame:
    """Pairs of left (a_id, ax0, ay0, ax1, ay1) and right (b_id, bx0, ...) boxes that meet, by the cells of a square
    grid that both cover; each pair is kept in one cell only: that of its overlap's lower left corner.

    The four inequalities alone would compare every box with every other. The work in a cell grows with the square of
    its boxes, so ``size`` should follow the boxes' own.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("bigint"), F.floor(F.col(hi) / size).cast("bigint"))
        return df.withColumn("gx", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("gy", F.explode(span(f"{p}y0", f"{p}y1")))

    own = (F.floor(F.greatest("ax0", "bx0") / size) == F.col("gx")) & (F.floor(F.greatest("ay0", "by0") / size) == F.col("gy"))
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    # the cells come by exploding, which Spark's size estimate doesn't see: dealt by number and merged, never broadcast
    a, b = dealt_by(cells(left, "a"), "gx", "gy"), dealt_by(cells(right, "b"), "gx", "gy")
    return a.hint("merge").join(b, (a["gx"] == b["gx"]) & (a["gy"] == b["gy"]) & meet & condition).select(a["*"], *[b[c] for c in b.columns if c not in ("gx", "gy")]).where(own).drop("gx", "gy")


def box_overlaps(boxes: DataFrame, size: float = 8.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """a_id < b_id of boxes whose interiors meet; shared edges don't count. Columns in ``carry`` come along as ``c_a``
    and ``c_b``: they travel with the boxes, which are fewer than the pairs."""
    side = lambda p: boxes.select(F.col("box_id").alias(p + "_id"), *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c).alias(f"{c}_{p}") for c in carry])
    left, right = side("a"), side("b")
    inside = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    return grid_pairs(left, right, size, (F.col("a_id") < F.col("b_id")) & inside).select("a_id", "b_id", *[f"{c}_{p}" for p in "ab" for c in carry])


def disk_overlaps(disks: DataFrame, size: float = 8.0) -> DataFrame:
    """a_id < b_id of disks (id, x, y, radius) nearer than the sum of their radii."""

    def side(p: str) -> DataFrame:
        x, y, q = F.col("x"), F.col("y"), F.col("radius")
        return disks.select(F.col("id").alias(p + "_id"), x.alias(p + "x"), y.alias(p + "y"), q.alias(p + "q"), (x - q).alias(p + "x0"), (y - q).alias(p + "y0"), (x + q).alias(p + "x1"), (y + q).alias(p + "y1"))

    dx, dy, reach = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"), F.col("aq") + F.col("bq")
    return grid_pairs(side("a"), side("b"), size, (F.col("a_id") < F.col("b_id")) & (dx * dx + dy * dy < reach * reach)).select("a_id", "b_id")


def overlap_lists(pairs: DataFrame) -> DataFrame:
    """id and the sorted ids it overlaps, both ways."""
    both = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other")).union(pairs.select("b_id", "a_id"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("others"))


def asymmetric(edges: DataFrame) -> DataFrame:
    """Directed edges (a_id, b_id) whose reverse is missing: none in a sound overlap graph."""
    return edges.join(edges.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id")), ["a_id", "b_id"], "left_anti")


#: Ids of equal segments in one row, at most: a pair of such rows makes a million pairs of ids.
BLOCK = 1024


def segment_crossings(a: DataFrame, b: DataFrame, size: float = 8.0, distinct: bool = True) -> DataFrame:
    """a_id, b_id, x, y: proper crossings of segments (id, x1, y1, x2, y2) of two polylines, to 1e-9.

    Equal segments are crossed once, in blocks of ids, and the ids are paired last, without an exchange of the pairs.
    ``distinct`` drops what a polyline crosses again in the very same point; where every id has one segment, nothing is. Ids aren't null.
    """
    ends = ("x1", "y1", "x2", "y2")

    def side(df: DataFrame, p: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*ends).orderBy("id")) - 1
        blocks = df.select("id", *ends).withColumn("_n", F.floor(number / BLOCK)).groupBy(*ends, "_n").agg(F.collect_list("id").alias("ids"))
        lo, hi = lambda u, v: F.least(u, v), lambda u, v: F.greatest(u, v)
        return blocks.select(F.col("ids").alias(p + "_ids"), F.col("_n").alias(p + "_n"), *[F.col(c).alias(f"{p}_{c}") for c in ends], lo("x1", "x2").alias(p + "x0"), lo("y1", "y2").alias(p + "y0"), hi("x1", "x2").alias(p + "x1"), hi("y1", "y2").alias(p + "y1"))

    pairs = grid_pairs(side(a, "a"), side(b, "b"), size, F.lit(True))
    ux, uy, vx, vy = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"), F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    wx, wy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    det = ux * vy - uy * vx
    t, s = F.try_divide(wx * vy - wy * vx, det), F.try_divide(wx * uy - wy * ux, det)
    on = lambda z: z.between(-1e-12, 1 + 1e-12)
    found = pairs.withColumns({"t": t, "s": s}).where(on(F.col("t")) & on(F.col("s")))
    found = found.select("a_ids", "b_ids", "a_n", "b_n", F.round(F.col("a_x1") + F.col("t") * ux, 9).alias("x"), F.round(F.col("a_y1") + F.col("t") * uy, 9).alias("y"), F.xxhash64(*[f"{p}_{c}" for p in "ab" for c in ends]).alias("_k"))
    dealt = dealt_by(found, "_k", "a_n", "b_n")
    out = dealt.select(F.explode("a_ids").alias("a_id"), "b_ids", "x", "y").select("a_id", F.explode("b_ids").alias("b_id"), "x", "y")
    return out.distinct() if distinct else out


def _ring_rows(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.sort_values("seq")[["x", "y"]].to_numpy(float)


def hulls(points: DataFrame, key: str = "id") -> DataFrame:
    """key, seq, x, y: convex hulls of point groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = K.hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: pdf[key].iloc[0], "seq": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return points.select(key, "x", "y").groupBy(key).applyInPandas(run, f"{key} bigint, seq bigint, x double, y double")


def least_rectangles(points: DataFrame, key: str = "id", by: str = "area") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = K.least_rectangle(pdf[["x", "y"]].to_numpy(float), by)
        return pd.DataFrame({key: pdf[key].iloc[0], "seq": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return points.select(key, "x", "y").groupBy(key).applyInPandas(run, f"{key} bigint, seq bigint, x double, y double")


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rings of equal or unequal lengths as one array (rings, longest, 2), and their lengths."""
    n = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    out = np.zeros((len(n), int(n.max(initial=0)), 2))
    out[np.arange(out.shape[1]) < n[:, None]] = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], axis=1)
    return out, n


def clipped_areas(pairs: DataFrame, tolerance: float = 0.0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The pairs, or their columns ``keep``, with ``shared``: the area of ring a within the convex ring b.

    A batch of pairs is clipped at once, a few thousand at a time: see ``clipped_area_of``.
    """
    names = list(keep or pairs.columns)

    def run(batches):
        for batch in batches:
            rings = [batch.column(batch.schema.get_field_index(k)) for k in ("ring_a", "ring_b")]
            areas = [K.clipped_area_of(*_points(rings[0].slice(at, 4096)), *_points(rings[1].slice(at, 4096)), tolerance) for at in range(0, batch.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in names], pa.array(np.concatenate([np.zeros(0), *areas]))], names=[*names, "shared"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInArrow(run, StructType([*[pairs.schema[k] for k in names], StructField("shared", DoubleType())]))


def ring_masks(rings: DataFrame, height: int, width: int) -> DataFrame:
    """id, r, c: pixels of an image of ``height`` rows and ``width`` columns that each ring (id, seq, x, y) covers, by
    the rule of ``ring_mask``; each ring is drawn in its own box."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _ring_rows(pdf)
        x0, y0 = (int(np.clip(np.floor(ring[:, k].min()) - 1, 0, most)) for k, most in ((0, width), (1, height)))
        x1, y1 = (int(np.clip(np.ceil(ring[:, k].max()) + 2, 0, most)) for k, most in ((0, width), (1, height)))
        r, c = np.nonzero(K.ring_mask(ring - [x0, y0], max(0, y1 - y0), max(0, x1 - x0)))
        return pd.DataFrame({"id": pdf["id"].iloc[0], "r": r + y0, "c": c + x0})

    return rings.select("id", "seq", "x", "y").groupBy("id").applyInPandas(run, "id bigint, r bigint, c bigint")


def parity_fill(toggles: DataFrame) -> DataFrame:
    """Pixels from toggles (image_id, r, c, n) down each column: those after an odd number of them."""
    down = Window.partitionBy("image_id", "c").orderBy("r")
    return toggles.withColumn("v", F.sum("n").over(down) % 2 == 1)


def circle_ring(x: Column, y: Column, area: Column, points: int = 126) -> Column:
    """Ring of the disk of a given area."""
    radius = F.sqrt(area / math.pi)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct((x + radius * F.cos(k * 0.05)).alias("x"), (y + radius * F.sin(k * 0.05)).alias("y")))
