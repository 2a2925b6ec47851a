"""Components and region measures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators.rasters import Region, filled, per_image, per_region
from gridloom.operators.stencils import neighbourhood


def label_images(mask: DataFrame, conn: int = 8) -> DataFrame:
    """image_id, r, c, label (0 outside) with components numbered by their first pixel in column order."""
    return per_image(mask, lambda a: {"label": K.label(a, conn)[0]}, "label bigint")


def label_tiled(mask: DataFrame, tile: int = 512, conn: int = 8, max_rounds: int = 60) -> DataFrame:
    """The same for images of any size: tiles are labelled one by one, then components that touch across a seam are
    joined by passing the least tile label along the seam's links until nothing changes.

    Only object pixels on tile borders take part in the joins.
    """
    from gridloom.sources.shared import stored

    tiles = mask.withColumns({"tr": F.expr(f"r div {tile}"), "tc": F.expr(f"c div {tile}")})
    local = per_image(tiles, lambda a: {"local": K.label(a, conn)[0]}, "local bigint", keys=("image_id", "tr", "tc")).where("local > 0")
    height = mask.groupBy("image_id").agg((F.max("r") + 1).alias("h"))
    first = local.join(height, "image_id").groupBy("image_id", "tr", "tc", "local").agg(F.min(F.col("c") * F.col("h") + F.col("r")).alias("node"))
    named = stored(local.join(first, ["image_id", "tr", "tc", "local"]).select("image_id", "r", "c", "tr", "tc", "node"), "tile-labels")
    rim = named.where(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})")
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in K.neighbours(conn)]))
    moved = rim.select("image_id", "tr", "tc", "node", "r", "c", offsets.alias("o")).select("image_id", F.col("tr").alias("tr2"), F.col("tc").alias("tc2"), F.col("node").alias("other"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    links = stored(rim.join(moved, ["image_id", "r", "c"]).where("tr <> tr2 or tc <> tc2").select("image_id", "node", "other").distinct(), "seams")
    roots = stored(links.select("image_id", "node").distinct().withColumn("root", F.col("node")), "roots")  # on seams only
    for _ in range(max_rounds):
        offered = links.join(roots.select("image_id", F.col("node").alias("other"), F.col("root").alias("theirs")), ["image_id", "other"]).groupBy("image_id", "node").agg(F.min("theirs").alias("theirs"))
        nearer = roots.join(offered, ["image_id", "node"], "left").withColumn("fresh", F.least("root", "theirs"))
        # follow the parent's own root too, so that long chains halve
        up = nearer.select("image_id", F.col("node").alias("fresh"), F.col("root").alias("above"))
        moved_up = stored(nearer.join(up, ["image_id", "fresh"], "left").select("image_id", "node", F.least("fresh", "above").alias("root"), F.col("root").alias("before")), "roots")
        done = moved_up.where("root <> before").isEmpty()
        roots = moved_up.select("image_id", "node", "root")
        if done:
            break
    else:
        raise RuntimeError("tile labels did not settle")
    order = Window.partitionBy("image_id").orderBy("root")
    every = named.select("image_id", "node").distinct().join(roots, ["image_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    numbers = every.select("image_id", "root").distinct().withColumn("label", F.row_number().over(order).cast("bigint"))
    return named.join(every.join(numbers, ["image_id", "root"]).select("image_id", "node", "label"), ["image_id", "node"]).select("image_id", "r", "c", "label")


def component_count(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id").agg(F.max("label").alias("n"))


def area_open(labels: DataFrame, least: int) -> DataFrame:
    """image_id, r, c, v: pixels of components with at least ``least`` pixels."""
    size = F.count("*").over(Window.partitionBy("image_id", "label"))
    return labels.where("label > 0").withColumn("size", size).where(F.col("size") >= least).select("image_id", "r", "c", "label")


def boundary_mask(mask: DataFrame, conn: int = 4) -> DataFrame:
    """Object pixels with a 4- or 8-neighbour outside the object; beyond the image counts as outside."""
    n = neighbourhood(mask, 1, "null", name="_n")
    places = (1, 3, 5, 7) if conn == 4 else (0, 1, 2, 3, 5, 6, 7, 8)
    whole = F.lit(True)
    for i in places:
        whole = whole & F.coalesce(F.col("_n")[i], F.lit(False))
    return n.withColumn("on_boundary", F.col("v") & ~whole).drop("_n")


def neighbour_degree(mask: DataFrame) -> DataFrame:
    """Object pixels with how many object pixels lie in their 4-, diagonal and 8-neighbourhood."""
    n = neighbourhood(mask, 1, "null", name="_n")
    count = lambda places: sum((F.coalesce(F.col("_n")[i], F.lit(False)).cast("bigint") for i in places), F.lit(0).cast("bigint"))
    return n.where("v").select("image_id", "r", "c", count((1, 3, 5, 7)).alias("n4"), count((0, 2, 6, 8)).alias("nd"), count((0, 1, 2, 3, 5, 6, 7, 8)).alias("n8"))


def mixed_adjacency(mask: DataFrame) -> DataFrame:
    """Ordered pairs of object pixels that are m-adjacent: 4-neighbours, or diagonal ones without a shared
    4-neighbour in the object."""
    n = neighbourhood(mask, 1, "null", name="_n").where("v")
    on = lambda i: F.coalesce(F.col("_n")[i], F.lit(False))
    right, down = on(5), on(7)
    falling, rising = on(8) & ~on(5) & ~on(7), on(6) & ~on(3) & ~on(7)
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), ok.alias("ok")) for a, b, ok in ((0, 1, right), (1, 0, down), (1, 1, falling), (1, -1, rising))])
    pairs = n.select("image_id", "r", "c", F.explode(steps).alias("s")).where("s.ok")
    return pairs.select("image_id", "r", "c", (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"))


def measures(labels: DataFrame) -> DataFrame:
    """Area, centroid, bounding box, second moments, axes, eccentricity and orientation of every region, 0-based
    (x is the column): one aggregate over the pixels, sums of whole numbers."""
    x, y = F.col("c"), F.col("r")
    sums = labels.where("label > 0").groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"),
    )
    n = F.col("area").cast("double")
    central = lambda s, a, b: (F.col(s) * F.col("area") - F.col(a) * F.col(b)) / (n * n)
    uxx, uyy, uxy = central("sxx", "sx", "sx") + 1 / 12, central("syy", "sy", "sy") + 1 / 12, -central("sxy", "sx", "sy")
    common = F.sqrt((uxx - uyy) * (uxx - uyy) + 4 * uxy * uxy)
    major, minor = 2 * math.sqrt(2) * F.sqrt(uxx + uyy + common), 2 * math.sqrt(2) * F.sqrt(F.greatest(uxx + uyy - common, F.lit(0.0)))
    top = F.when(uyy > uxx, uyy - uxx + common).otherwise(2 * uxy)
    bottom = F.when(uyy > uxx, 2 * uxy).otherwise(uxx - uyy + common)
    turn = F.when((top == 0) & (bottom == 0), 0.0).otherwise(F.degrees(F.when(bottom == 0, F.signum(top) * (math.pi / 2)).otherwise(F.atan(F.try_divide(top, bottom)))))
    found = sums.withColumns({"cx": F.col("sx") / n, "cy": F.col("sy") / n, "major": major, "minor": minor, "orientation": turn})
    return found.withColumn("eccentricity", F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(F.try_divide(F.col("minor"), F.col("major")), F.lit(2))))).drop("sx", "sy", "sxx", "syy", "sxy")


def shape_measures(labels: DataFrame) -> DataFrame:
    """image_id, label, area, hull_area (pixels the hull covers), solidity, perimeter, and the least rectangle's sides:
    in groups of regions."""

    def measure(region: Region) -> dict:
        a, _, _ = filled(region)
        rows, cols = np.nonzero(a)
        full = max(1, int(K.ring_mask(K.pixel_hull(rows, cols), *a.shape).sum()))
        box = K.least_rectangle(np.stack([cols, rows], 1).astype(float))
        sides = sorted((float(np.hypot(*(box[1] - box[0]))), float(np.hypot(*(box[2] - box[1])))))
        return {"area": [len(rows)], "hull_area": [full], "solidity": [len(rows) / full], "perimeter": [K.perimeter(K.trace(a))], "long_side": [sides[1]], "short_side": [sides[0]]}

    schema = "area bigint, hull_area bigint, solidity double, perimeter double, long_side double, short_side double"
    return per_region(labels.where("label > 0"), measure, schema)


def to_split(shapes: DataFrame, axes: DataFrame, most_area: int = 2500, least_solidity: float = 0.9, most_ratio: float = 2.0) -> DataFrame:
    """Regions that are too large, too ragged or too long to be one piece."""
    ratio = F.try_divide(F.col("major"), F.col("minor"))
    both = shapes.join(axes.select("image_id", "label", "major", "minor"), ["image_id", "label"])
    return both.where((F.col("area") > most_area) | (F.col("solidity") < least_solidity) | (ratio > most_ratio)).select("image_id", "label", "area", "solidity", ratio.alias("ratio"))


def _with_edge(px: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """px with ``edge``: whether a pixel lies on its image's border. The extents are one row an image, joined back;
    ``of``: pixels with the same extents that cost less to read."""
    extent = (px if of is None else of).groupBy("image_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    edge = F.col("r").isin(F.col("r0"), F.col("r1")) | F.col("c").isin(F.col("c0"), F.col("c1"))
    return px.join(extent, "image_id").withColumn("edge", edge).drop("r0", "r1", "c0", "c1")


def fill_holes(mask: DataFrame, conn: int = 4) -> DataFrame:
    """image_id, r, c, v with holes filled: background components that don't reach the border become object."""
    background = label_images(mask.select("image_id", "r", "c", (~F.col("v")).alias("v")), conn)
    marked = _with_edge(background, mask)  # labels once
    open_ = F.max(F.col("edge") & (F.col("label") > 0)).over(Window.partitionBy("image_id", "label"))
    return marked.withColumn("open", open_).select("image_id", "r", "c", ((F.col("label") == 0) | ~F.col("open")).alias("v"))


def contours(labels: DataFrame, conn: int = 8) -> DataFrame:
    """image_id, label, seq, r, c: the closed outer contour of every region."""

    def follow(region: Region) -> dict:
        a, r0, c0 = filled(region)
        t = K.trace(a, conn)
        return {"seq": np.arange(len(t)), "r": t[:, 0] + r0, "c": t[:, 1] + c0}

    return per_region(labels.where("label > 0"), follow, "seq bigint, r bigint, c bigint")


def chain_codes(contour: DataFrame) -> DataFrame:
    """image_id, label, seq, r, c, code, diff: Freeman codes of closed contours and their circular first difference;
    a step of more than one pixel raises."""
    line = Window.partitionBy("image_id", "label").orderBy("seq")
    step = contour.withColumns({"dr": F.lead("r").over(line) - F.col("r"), "dc": F.lead("c").over(line) - F.col("c")}).where("dr is not null")
    code = F.lit(None).cast("bigint")
    for k, (a, b) in enumerate(K.FREEMAN):
        code = F.when((F.col("dr") == a) & (F.col("dc") == b), F.lit(k).cast("bigint")).otherwise(code)
    coded = step.withColumn("code", F.coalesce(code, F.raise_error(F.lit("broken contour")).cast("bigint")))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("code").over(line), F.first("code").over(whole))
    return coded.select("image_id", "label", "seq", "r", "c", "code", F.pmod(after - F.col("code"), F.lit(8)).alias("diff"))


def least_rotation(codes: Column) -> Column:
    """The rotation of a circular code that is least in order."""
    n = F.size(codes)
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(codes, k + 1, n - k), F.slice(codes, F.lit(1), k))))


def reversed_code(codes: Column) -> Column:
    return F.transform(F.reverse(codes), lambda x: F.pmod(x + 4, F.lit(8)))


def code_strings(chain: DataFrame) -> DataFrame:
    """image_id, label, code, min_code, min_diff as arrays; a contour fits a row."""
    entry = F.array_sort(F.collect_list(F.struct("seq", "code", "diff")))
    folded = chain.groupBy("image_id", "label").agg(entry.alias("e"))
    codes, diffs = F.transform("e", lambda x: x["code"]), F.transform("e", lambda x: x["diff"])
    return folded.select("image_id", "label", codes.alias("code"), least_rotation(codes).alias("min_code"), least_rotation(diffs).alias("min_diff"), reversed_code(codes).alias("reversed"))


def decoded(chain: DataFrame) -> DataFrame:
    """Contour points again from start and codes, by running sums of steps."""
    line = Window.partitionBy("image_id", "label").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in K.FREEMAN])
    moved = chain.withColumn("s", F.get(steps, F.col("code").cast("int")))
    first = Window.partitionBy("image_id", "label").orderBy("seq")
    return moved.select("image_id", "label", "seq", (F.first("r").over(first) + F.coalesce(F.sum("s.dr").over(line), F.lit(0))).alias("r"), (F.first("c").over(first) + F.coalesce(F.sum("s.dc").over(line), F.lit(0))).alias("c"))


def painted(contour: DataFrame, place: str = "tight") -> DataFrame:
    """image_id, label, r, c: contour pixels once each, moved so that each contour's box starts at 0 ('tight') or as
    they are ('own')."""
    whole = Window.partitionBy("image_id", "label")
    r, c = (F.col("r") - F.min("r").over(whole), F.col("c") - F.min("c").over(whole)) if place == "tight" else (F.col("r"), F.col("c"))
    return contour.select("image_id", "label", r.alias("r"), c.alias("c")).distinct()


def border_marker(mask: DataFrame) -> DataFrame:
    """image_id, r, c, v: the complement on the image's border, nought within; a marker for filling holes."""
    return _with_edge(mask).select("image_id", "r", "c", (F.col("edge") & ~F.col("v")).alias("v"))


def concave_points(chain: DataFrame, low: int = 3, high: int = 10) -> DataFrame:
    """Contour points where the three-step sum of the running turn rises by ``low`` to ``high`` over three steps.

    Going past either end of the closed contour adds or takes its whole turn.
    """
    line = Window.partitionBy("image_id", "label").orderBy("seq")
    ends = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("code").over(line), F.last("code").over(ends))
    raw = F.pmod(F.col("code") - before + 8, F.lit(8))
    turned = chain.withColumn("turn", F.when(raw > 4, raw - 8).otherwise(raw)).withColumn("a", F.sum("turn").over(line))
    folded = turned.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("seq", "r", "c", "a"))).alias("e"))
    folded = folded.withColumn("n", F.size("e")).where("n >= 6").withColumn("whole", F.element_at("e", -1)["a"])
    sums = F.expr("""transform(sequence(0, n - 1), i -> e[i].a
        + if(i >= 1, e[greatest(i - 1, 0)].a, e[least(i - 1 + n, n - 1)].a - whole)
        + if(i >= 2, e[greatest(i - 2, 0)].a, e[least(i - 2 + n, n - 1)].a - whole))""")
    changes = F.expr("transform(sequence(0, n - 1), i -> struct(e[i].seq as seq, e[i].r as r, e[i].c as c, if(i + 3 < n, s[least(i + 3, n - 1)], s[greatest(i + 3 - n, 0)] + 3 * whole) - s[i] as change))")
    found = folded.withColumn("s", sums).withColumn("d", changes).select("image_id", "label", F.inline("d"))
    return found.where(F.col("change").between(low, high))
