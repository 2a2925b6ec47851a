"""From gray images to pieces: two-layer segmentation, contour splitting, shape cleaning, types and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import size_colour
from gridloom.operators import geometry as G
from gridloom.operators import kernels as K
from gridloom.operators.clustering import gray_kmeans, gray_labels
from gridloom.operators.morphology import disk
from gridloom.operators.rasters import Region, filled, per_image, per_region, raster
from gridloom.operators.regions import label_images
from gridloom.operators.thresholds import otsu_mask
from gridloom.sources.shared import stored
from gridloom.plans.watersheds import dilate_array, erode_array

MIN_FLOE, MIN_BRASH, SMALL_PIECE = 40, 1, 50


def force_field(px: DataFrame, mu: float = 0.1, steps: int = 500) -> DataFrame:
    """image_id, r, c, u, v: unit forces towards edges by gradient vector flow of the gradient's magnitude."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        gy, gx = np.gradient(a.astype(float))
        u, v = K.unit_force(*K.vector_flow(np.hypot(gx, gy), mu, steps))
        return {"u": u, "v": v}

    return per_image(px, run, "u double, v double")


def seeds_of(mask: np.ndarray, metric: str = "cityblock", radius: int = 3) -> list[tuple[float, float, float]]:
    """(x, y, radius) of a start circle for each group of near distance maxima: distance over the root of two, and 2
    where that is nought."""
    d = K.distance(mask, metric)
    d = np.where(np.isinf(d), 0, d)
    labels, n = K.label(dilate_array(K.regional_maxima(d) & mask, disk(radius)), 8)
    out = []
    for k in range(1, n + 1):
        r, c = np.nonzero(labels == k)
        y, x = r.mean(), c.mean()
        size = d[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))] / np.sqrt(2)
        out.append((x, y, size if size > 0 else 2.0))
    return out


def _split_array(mask: np.ndarray, px: np.ndarray, py: np.ndarray, rounds: int, least_area: int, most_area: int, least_solidity: float, most_ratio: float, iterations: int, kappa: float) -> np.ndarray:
    out = mask.copy()
    h, w = mask.shape
    for _ in range(rounds):
        labels, n = K.label(out, 4)
        chosen = np.zeros(out.shape, bool)
        for k in range(1, n + 1):
            r, c = np.nonzero(labels == k)
            if len(r) < least_area:
                continue
            hull = K.pixel_hull(r, c)
            solidity = len(r) / max(1, int(K.ring_mask(hull, h, w).sum()))
            uxx, uyy, uxy = c.var() + 1 / 12, r.var() + 1 / 12, np.mean((c - c.mean()) * (r - r.mean()))
            off = np.sqrt((uxx - uyy) ** 2 + 4 * uxy**2)
            ratio = np.sqrt((uxx + uyy + off) / max(uxx + uyy - off, 1e-12))
            if len(r) > most_area or solidity < least_solidity or ratio > most_ratio:
                chosen[r, c] = True
        if not chosen.any():
            break
        burnt = np.zeros(out.shape, bool)  # contours of one round don't see each other's marks
        for x0, y0, radius in seeds_of(chosen):
            t = np.arange(126) * 0.05
            x, y = x0 + radius * np.cos(t), y0 + radius * np.sin(t)
            for _ in range(max(1, iterations // 5)):
                x, y = K.respace(x, y)
                if len(x) < 4:
                    break
                x, y = K.deform(x, y, px, py, kappa=kappa, steps=5)
                x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
            if len(x) >= 4:
                x, y = K.respace(x, y)
                burnt[np.ceil(y).astype(int).clip(0, h - 1), np.ceil(x).astype(int).clip(0, w - 1)] = True
        before = out.copy()
        out &= ~burnt
        if np.array_equal(before, out):
            break
    return out


def split_contours(images: DataFrame, rounds: int = 2, least_area: int = 10, most_area: int = 2500, least_solidity: float = 0.9, most_ratio: float = 2.0, iterations: int = 30, kappa: float = 0.5, mu: float = 0.1, steps: int = 500) -> DataFrame:
    """image_id, r, c, v: a mask with touching pieces parted by active contours.

    images has v (gray) and mask. Pieces that are too large, ragged or long get start circles; every contour moves in
    the gradient vector flow of the image and is burnt into the mask where it comes to rest.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gray, r0, c0 = raster(pdf, "v")
        mask, _, _ = raster(pdf, "mask", False)
        gy, gx = np.gradient(gray.astype(float))
        px, py = K.unit_force(*K.vector_flow(np.hypot(gx, gy), mu, steps))
        out = _split_array(mask, px, py, rounds, least_area, most_area, least_solidity, most_ratio, iterations, kappa)
        r, c = np.indices(out.shape)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "r": r.ravel() + r0, "c": c.ravel() + c0, "v": out.ravel()})

    return images.select("image_id", "r", "c", "v", "mask").groupBy("image_id").applyInPandas(run, "image_id bigint, r bigint, c bigint, v boolean")


def classic_snake(px: DataFrame, x0: float, y0: float, radius: float, steps: int = 40, alpha: float = 0.05, beta: float = 0.0, kappa: float = 0.5) -> DataFrame:
    """image_id, seq, x, y: one closed contour from a circle, driven by the gradient of the edge energy alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, _, _ = raster(pdf, "v")
        gy, gx = np.gradient(a.astype(float))
        fy, fx = np.gradient(gx * gx + gy * gy)
        px_, py_ = K.unit_force(fx, fy)
        t = np.arange(126) * 0.05
        x, y = x0 + radius * np.cos(t), y0 + radius * np.sin(t)
        for _ in range(max(1, steps // 5)):
            x, y = K.respace(x, y)
            x, y = K.deform(x, y, px_, py_, alpha, beta, kappa=kappa, steps=5)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "seq": np.arange(len(x)), "x": x, "y": y})

    return px.select("image_id", "r", "c", "v").groupBy("image_id").applyInPandas(run, "image_id bigint, seq bigint, x double, y double")


def two_layers(px: DataFrame, k: int = 3, least_dark: int = 2, **split) -> DataFrame:
    """image_id, r, c, level: 1 for light pieces (above Otsu, parted), 0.5 for dark ones (not the darkest of k clusters,
    outside the light mask, small specks dropped, parted), else 0."""
    light = otsu_mask(px).withColumnRenamed("v", "light")
    clusters = gray_labels(px, gray_kmeans(px, k)).select("image_id", "r", "c", "v", (F.col("k") > 0).alias("ice"))
    both = clusters.join(light, ["image_id", "r", "c"])
    dark = both.select("image_id", "r", "c", (F.col("ice") & ~F.col("light")).alias("v"))
    labelled = label_images(dark, 4)
    size = F.count("*").over(Window.partitionBy("image_id", "label"))
    dark = labelled.withColumn("dark", (F.col("label") > 0) & (size >= least_dark)).select("image_id", "r", "c", "dark")
    joined = both.join(dark, ["image_id", "r", "c"])
    light_parts = split_contours(joined.select("image_id", "r", "c", "v", F.col("light").alias("mask")), **split).withColumnRenamed("v", "a")
    dark_parts = split_contours(joined.select("image_id", "r", "c", "v", F.col("dark").alias("mask")), **split).withColumnRenamed("v", "b")
    parts = light_parts.join(dark_parts, ["image_id", "r", "c"]).join(joined.select("image_id", "r", "c", "ice"), ["image_id", "r", "c"])
    return parts.select("image_id", "r", "c", F.when(F.col("a"), 1.0).when(F.col("b"), 0.5).otherwise(0.0).alias("level"), (F.col("ice") | F.col("a")).alias("ice"))


def clean_piece(mask: np.ndarray, radius: int) -> np.ndarray:
    """Fill, close, open, fill; the array has room for the element all round."""
    se = disk(radius)
    out = K.fill_holes(mask)
    out = erode_array(dilate_array(out, se), se)
    out = dilate_array(erode_array(out, se), se)
    return K.fill_holes(out)


def enhance_shapes(levels: DataFrame, small: int = SMALL_PIECE) -> DataFrame:
    """image_id, r, c, piece, area: pieces (light before dark, then by size, then by first pixel) cleaned one by one
    in their own box with a margin, the larger painted over the smaller; area is the painted one."""
    light = label_images(levels.select("image_id", "r", "c", (F.col("level") == 1.0).alias("v")), 4).where("label > 0").withColumn("layer", F.lit(0))
    dark = label_images(levels.select("image_id", "r", "c", (F.col("level") == 0.5).alias("v")), 4).where("label > 0").withColumn("layer", F.lit(1))
    every = light.unionByName(dark)
    sized = every.groupBy("image_id", "layer", "label").agg(F.count("*").alias("raw_area"))
    ranked = sized.withColumn("piece", F.row_number().over(Window.partitionBy("image_id").orderBy("raw_area", "layer", "label")).cast("bigint"))
    extent = levels.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    pieces = every.join(ranked, ["image_id", "layer", "label"]).join(extent, "image_id")

    def clean(region: Region) -> dict:
        radius = 1 if len(region["r"]) < small else 2
        a, r0, c0 = filled(region)
        margin = 4 * radius + 6
        r, c = np.nonzero(clean_piece(np.pad(a, margin), radius))
        r, c = r + r0 - margin, c + c0 - margin
        ok = (r >= 0) & (r < region["h"][0]) & (c >= 0) & (c < region["w"][0])
        return {"r": r[ok], "c": c[ok]}

    cleaned = per_region(pieces, clean, "r bigint, c bigint", ("image_id", "piece"), ("r", "c", "h", "w"))
    painted = cleaned.groupBy("image_id", "r", "c").agg(F.max("piece").alias("piece"))  # the last painted is the largest
    return painted.withColumn("area", F.count("*").over(Window.partitionBy("image_id", "piece")))


def classify(levels: DataFrame, pieces: DataFrame, min_floe: int = MIN_FLOE, min_brash: int = MIN_BRASH) -> DataFrame:
    """image_id, r, c, kind: floe (area above min_floe), brash (above min_brash), slush (other ice), water."""
    joined = levels.select("image_id", "r", "c", "ice").join(pieces, ["image_id", "r", "c"], "left")
    kind = F.when(F.col("area") > min_floe, "floe").when(F.col("area") > min_brash, "brash").when(F.col("ice") | F.col("area").isNotNull(), "slush").otherwise("water")
    return joined.select("image_id", "r", "c", "piece", kind.alias("kind"))


def coverages(kinds: DataFrame) -> DataFrame:
    """image_id and the shares of floe, brash, slush and water, which sum to one."""
    share = lambda k: F.avg((F.col("kind") == k).cast("int")).alias(k)
    return kinds.groupBy("image_id").agg(*map(share, ("floe", "brash", "slush", "water")))


def classify_sizes(labels: DataFrame, min_floe: int = MIN_FLOE, min_brash: int = 2) -> DataFrame:
    """image_id, label, area, kind, colour by area alone, at least the limits."""
    sized = labels.where("label > 0").groupBy("image_id", "label").agg(F.count("*").alias("area"))
    kind = F.when(F.col("area") >= min_floe, "floe").when(F.col("area") >= min_brash, "brash").otherwise("residue")
    return sized.select("image_id", "label", "area", kind.alias("kind"), size_colour("area").alias("colour"))


def piece_table(kinds: DataFrame) -> DataFrame:
    """image_id, piece, kind, area, cx, cy."""
    return kinds.where("kind in ('floe', 'brash')").groupBy("image_id", "piece", "kind").agg(F.count("*").alias("area"), F.avg("c").alias("cx"), F.avg("r").alias("cy"))


def hull_rings(kinds: DataFrame) -> DataFrame:
    """image_id, piece, ring (open, through mid-edge points) of floes."""

    def outline(region: Region) -> dict:
        h = K.pixel_hull(region["r"], region["c"])
        return {"ring": [[{"x": float(x), "y": float(y)} for x, y in h]]}

    return per_region(kinds.where("kind = 'floe'"), outline, "ring array<struct<x:double,y:double>>", ("image_id", "piece"))


def field_document(kinds: DataFrame) -> DataFrame:
    """One nested row an image: coverages, floes with polygons, brash with disks."""
    kinds = stored(kinds, "kinds")  # three aggregates read it
    table = piece_table(kinds)
    rings = hull_rings(kinds)
    floes = table.where("kind = 'floe'").join(rings, ["image_id", "piece"]).withColumns({"polygon_area": G.polygon_area(F.col("ring"))})
    floe = F.array_sort(F.collect_list(F.struct("piece", "area", "cx", "cy", "polygon_area", "ring"))).alias("floes")
    brash_rows = table.where("kind = 'brash'").withColumn("radius", F.sqrt(F.col("area") / np.pi))
    brash = F.array_sort(F.collect_list(F.struct("piece", "area", "cx", "cy", "radius"))).alias("disks")
    out = coverages(kinds).join(floes.groupBy("image_id").agg(floe), "image_id", "left").join(brash_rows.groupBy("image_id").agg(brash), "image_id", "left")
    return out


def outlines(kinds: DataFrame) -> DataFrame:
    """image_id, id, kind, x, y, radius, ring: floes by their hulls, brash by the disk of equal area."""
    table = piece_table(kinds)
    floes = table.where("kind = 'floe'").join(hull_rings(kinds), ["image_id", "piece"]).withColumn("radius", F.lit(None).cast("double"))
    brash = table.where("kind = 'brash'").withColumn("radius", F.sqrt(F.col("area") / np.pi)).withColumn("ring", G.circle_ring(F.col("cx"), F.col("cy"), F.col("area")))
    cols = ["image_id", F.col("piece").alias("id"), "kind", F.col("cx").alias("x"), F.col("cy").alias("y"), "radius", "ring"]
    return floes.select(*cols).unionByName(brash.select(*cols))


def overlaps(shapes: DataFrame, cell: float = 16.0, nested: bool = False) -> DataFrame:
    """image_id, a_id, a_kind, b_id, b_kind (a before b) of pieces whose outlines meet; two disks meet where they are
    nearer than their radii together. With ``nested``, one within the other counts as well.

    Boxes meet first, in the cells of a grid; only those pairs are tested exactly.
    """
    ends = lambda f, k: f(F.transform("ring", lambda p: p[k]))

    def side(p: str) -> DataFrame:
        box = {"x0": ends(F.array_min, "x"), "y0": ends(F.array_min, "y"), "x1": ends(F.array_max, "x"), "y1": ends(F.array_max, "y")}
        own = [F.col(c).alias(f"{p}_{c}") for c in ("id", "kind", "x", "y", "radius", "ring")]
        return shapes.select(F.col("image_id").alias(p + "_image"), *own, *[x.alias(p + n) for n, x in box.items()])

    near = G.grid_pairs(side("a"), side("b"), cell, (F.col("a_image") == F.col("b_image")) & (F.col("a_id") < F.col("b_id")))
    near = near.select(F.col("a_image").alias("image_id"), "a_id", "a_kind", "b_id", "b_kind", "a_x", "a_y", "a_radius", "a_ring", "b_x", "b_y", "b_radius", "b_ring")

    def run(batches):
        for pdf in batches:
            keep = []
            for row in pdf.itertuples():
                if row.a_kind == row.b_kind == "brash":
                    keep.append(bool(np.hypot(row.a_x - row.b_x, row.a_y - row.b_y) < row.a_radius + row.b_radius))
                    continue
                a, b = (np.array([[p["x"], p["y"]] for p in ring]) for ring in (row.a_ring, row.b_ring))
                keep.append(K.outlines_meet(a, b) or (nested and (K.ring_contains(a, b[0]) or K.ring_contains(b, a[0]))))
            yield pdf.loc[keep, ["image_id", "a_id", "a_kind", "b_id", "b_kind"]]

    return near.mapInPandas(run, "image_id bigint, a_id bigint, a_kind string, b_id bigint, b_kind string")


def pieces_of(documents: DataFrame) -> DataFrame:
    """The inverse: one row a piece."""
    floes = documents.select("image_id", F.explode("floes").alias("p")).select("image_id", F.lit("floe").alias("kind"), "p.piece", "p.area", "p.cx", "p.cy")
    brash = documents.select("image_id", F.explode("disks").alias("p")).select("image_id", F.lit("brash").alias("kind"), "p.piece", "p.area", "p.cx", "p.cy")
    return floes.unionByName(brash)


def rectangles(labels: DataFrame) -> DataFrame:
    """image_id, label, ring, area, perimeter, ratio, cx, cy of each region's least rectangle through its mid-edge points."""

    def box_of(region: Region) -> dict:
        box = K.least_rectangle(K.pixel_hull(region["r"], region["c"]))
        a, b = np.hypot(*(box[1] - box[0])), np.hypot(*(box[2] - box[1]))
        ring = [{"x": float(x), "y": float(y)} for x, y in box]
        return {"ring": [ring], "area": [a * b], "perimeter": [2 * (a + b)], "ratio": [a / b if b else np.nan], "cx": [box[:, 0].mean()], "cy": [box[:, 1].mean()]}

    schema = "ring array<struct<x:double,y:double>>, area double, perimeter double, ratio double, cx double, cy double"
    return per_region(labels.where("label > 0"), box_of, schema)


def rectangle_model(rects: DataFrame, low: float = 0.4, high: float = 2.5, cell: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """Rectangles within the aspect band, numbered anew, and the pairs that share an area."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("label")).cast("bigint")
    kept = rects.where((F.col("ratio") > low) & (F.col("ratio") < high)).withColumn("number", number)
    ends = lambda f, k: f(F.transform("ring", lambda p: p[k]))

    def side(p: str) -> DataFrame:
        cols = {"x0": ends(F.array_min, "x"), "y0": ends(F.array_min, "y"), "x1": ends(F.array_max, "x"), "y1": ends(F.array_max, "y")}
        return kept.select(F.col("image_id").alias(p + "_image"), F.col("number").alias(p + "_id"), F.col("ring").alias("ring_" + p), *[x.alias(p + n) for n, x in cols.items()])

    near = G.grid_pairs(side("a"), side("b"), cell, (F.col("a_image") == F.col("b_image")) & (F.col("a_id") < F.col("b_id")))
    shared = G.clipped_areas(near.select(F.col("a_image").alias("image_id"), "a_id", "b_id", "ring_a", "ring_b"), 1e-9).where("shared > 0")
    return kept, shared.select("image_id", "a_id", "b_id", "shared")


def tiled_layers(tiled: DataFrame, k: int = 2) -> DataFrame:
    """Per-tile segmentation: image_id, tile, r, c, in_core, v, error. A tile that fails gives nothing but its error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["image_id", "tile", "r", "c", "in_core"]].copy()
        try:
            values = pdf["v"].to_numpy()
            counts = np.bincount(values, minlength=256).astype(float)
            w, m = np.cumsum(counts), np.cumsum(counts * np.arange(1, 257))
            with np.errstate(all="ignore"):
                score = (m[-1] * w - w[-1] * m) ** 2 / (w * (w[-1] - w))
            score[~np.isfinite(score)] = -1
            if score.max() < 0:
                raise ValueError("constant tile")
            level = np.flatnonzero(score == score.max()).mean()
            out["v"], out["error"] = values > level, None
        except ValueError as e:
            out["v"], out["error"] = False, str(e)
        return out

    return tiled.select("image_id", "tile", "r", "c", "in_core", "v").groupBy("image_id", "tile").applyInPandas(run, "image_id bigint, tile bigint, r bigint, c bigint, in_core boolean, v boolean, error string")
