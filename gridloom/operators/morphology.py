"""Structuring elements and gray morphology: erosion ignores what lies outside (class maximum), dilation likewise
(class minimum), both as least and greatest over a neighbourhood made by two windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.stencils import along, neighbourhood

Offsets = list[tuple[int, int]]


def square(size: int) -> Offsets:
    origin = (size - 1) // 2
    return [(i - origin, j - origin) for i in range(size) for j in range(size)]


def rectangle(height: int, width: int) -> Offsets:
    a, b = (height - 1) // 2, (width - 1) // 2
    return [(i - a, j - b) for i in range(height) for j in range(width)]


def diamond(radius: int) -> Offsets:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]


def octagon(radius: int) -> Offsets:
    if radius % 3:
        raise ValueError("an octagon's radius is a multiple of three")
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius + radius // 3]


def disk(radius: int) -> Offsets:
    """All offsets within the radius."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def disk_by_lines(radius: int) -> Offsets:
    """A disk as a sum of four periodic lines and, where that is too small, two straight ones: an octagon for which
    the passes of its parts cost less than the disk's own. Radii under three give the plain disk."""
    import math

    if radius < 3:
        return disk(radius)
    angle = math.pi / 8
    reach = 2 * radius / (1 / math.tan(angle) + 1 / math.sin(angle))
    out: Offsets = [(0, 0)]
    for v in ((1, 0), (1, 1), (0, 1), (-1, 1)):
        out = minkowski_sum(out, periodic_line(math.floor(reach / math.hypot(*v)), *v))
    short = radius - max(i for i, _ in out)
    if short > 0:
        out = minkowski_sum(minkowski_sum(out, line(2 * short + 1, 0)), line(2 * short + 1, 90))
    return out


def line(length: int, angle: float) -> Offsets:
    """A symmetric digital line through the origin."""
    import math

    half = (length - 1) / 2
    dx, dy = half * math.cos(math.radians(angle)), -half * math.sin(math.radians(angle))
    n = max(round(abs(dx)), round(abs(dy)))
    if n == 0:
        return [(0, 0)]
    return sorted({(round(dy * k / n), round(dx * k / n)) for k in range(-n, n + 1)})


def pair(dr: int, dc: int) -> Offsets:
    return [(0, 0), (dr, dc)]


def periodic_line(p: int, dr: int, dc: int) -> Offsets:
    return [(k * dr, k * dc) for k in range(-p, p + 1)]


def minkowski_sum(a: Offsets, b: Offsets) -> Offsets:
    return sorted({(i + k, j + m) for i, j in a for k, m in b})


def reflected(se: Offsets) -> Offsets:
    return [(-i, -j) for i, j in se]


def _radius(se: Offsets) -> int:
    return max(max(abs(i), abs(j)) for i, j in se)


def _over(name: str, se: Offsets, radius: int) -> list[Column]:
    side = 2 * radius + 1
    return [F.col(name)[(i + radius) * side + j + radius] for i, j in se]


def _is_rectangle(se: Offsets) -> bool:
    rows, cols = {i for i, _ in se}, {j for _, j in se}
    return len(se) == len(rows) * len(cols) == (max(rows) - min(rows) + 1) * (max(cols) - min(cols) + 1)


def _extreme(px: DataFrame, se: Offsets, least: bool, name: str) -> DataFrame:
    if _is_rectangle(se):  # rows first, then columns: a running extreme over each
        pick = F.min if least else F.max
        rows, cols = [i for i, _ in se], [j for _, j in se]
        wide = px.withColumn("_w", pick("v").over(along("c").rowsBetween(min(cols), max(cols))))
        return wide.withColumn(name, pick("_w").over(along("r").rowsBetween(min(rows), max(rows)))).drop("_w")
    radius = _radius(se)
    cells = _over("_n", se, radius)
    value = cells[0] if len(cells) == 1 else (F.least if least else F.greatest)(*cells)  # both pass over null
    return neighbourhood(px, radius, "null", name="_n").withColumn(name, value).drop("_n")


def erode(px: DataFrame, se: Offsets, name: str = "out") -> DataFrame:
    return _extreme(px, se, True, name)


def dilate(px: DataFrame, se: Offsets, name: str = "out") -> DataFrame:
    return _extreme(px, reflected(se), False, name)


def _again(px: DataFrame, name: str = "out") -> DataFrame:
    return px.select("image_id", "r", "c", F.col(name).alias("v"))


def opening(px: DataFrame, se: Offsets) -> DataFrame:
    return dilate(_again(erode(px, se)), se)


def closing(px: DataFrame, se: Offsets) -> DataFrame:
    """Dilation then erosion as if the image went on with its least value: the border of the dilated image is kept
    by growing the grid first and cutting it back after."""
    reach = _radius(se)
    ends = px.groupBy("image_id").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    span = lambda top: F.sequence(F.lit(-reach).cast("bigint"), F.col(top) + reach)
    grid = ends.select("image_id", "h", "w", F.explode(span("h")).alias("r")).select("image_id", "h", "w", "r", F.explode(span("w")).alias("c"))
    filled = grid.join(px.select("image_id", "r", "c", "v"), ["image_id", "r", "c"], "left")
    grown = dilate(filled.select("image_id", "r", "c", "v"), se)
    least = _again(grown)
    shut = erode(least, se)
    inside = shut.join(ends, "image_id").where("r between 0 and h and c between 0 and w")
    return inside.select("image_id", "r", "c", "out").join(px.select("image_id", "r", "c", "v"), ["image_id", "r", "c"])


def gradient(px: DataFrame, se: Offsets) -> DataFrame:
    """Basic, internal and external gradients in one pass over the neighbourhood."""
    radius = _radius(se)
    n = neighbourhood(px, radius, "null", name="_n")
    low, high = F.least(*_over("_n", se, radius)), F.greatest(*_over("_n", reflected(se), radius))
    return n.withColumns({"basic": high - low, "internal": F.col("v") - low, "external": high - F.col("v")}).drop("_n")


def hit_or_miss(px: DataFrame, hit: Offsets, miss: Offsets) -> DataFrame:
    """Pixels where all of ``hit`` is set and none of ``miss``."""
    radius = max(_radius(hit), _radius(miss))
    n = neighbourhood(px, radius, "null", name="_n")
    on = F.lit(True)
    for x in _over("_n", hit, radius):
        on = on & F.coalesce(x, F.lit(False))
    for x in _over("_n", miss, radius):
        on = on & ~F.coalesce(x, F.lit(False))
    return n.withColumn("out", on).drop("_n")


def geodesic_dilation(marker: DataFrame, mask: DataFrame, se: Offsets, steps: int = 1) -> DataFrame:
    """``steps`` times: dilate, then stay below the mask."""
    limit = mask.select("image_id", "r", "c", F.col("v").alias("_limit"))
    out = marker.select("image_id", "r", "c", "v").join(limit, ["image_id", "r", "c"])
    for _ in range(steps):
        grown = _extreme(out, reflected(se), False, "out")
        out = grown.select("image_id", "r", "c", F.least("out", "_limit").alias("v"), "_limit")
    return out.select("image_id", "r", "c", "v")


def geodesic_erosion(marker: DataFrame, mask: DataFrame, se: Offsets, steps: int = 1) -> DataFrame:
    limit = mask.select("image_id", "r", "c", F.col("v").alias("_limit"))
    out = marker.select("image_id", "r", "c", "v").join(limit, ["image_id", "r", "c"])
    for _ in range(steps):
        shrunk = _extreme(out, se, True, "out")
        out = shrunk.select("image_id", "r", "c", F.greatest("out", "_limit").alias("v"), "_limit")
    return out.select("image_id", "r", "c", "v")


def profile_open_close(profile: DataFrame, length: int = 9, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Opening and closing of one-dimensional profiles (keys, c, v) by a centred line."""
    half = (length - 1) // 2
    order = Window.partitionBy(*keys).orderBy("c").rowsBetween(-half, length - 1 - half)
    back = Window.partitionBy(*keys).orderBy("c").rowsBetween(-(length - 1 - half), half)
    low = profile.withColumns({"_e": F.min("v").over(order), "_d": F.max("v").over(back)})
    return low.withColumns({"opened": F.max("_e").over(back), "closed": F.min("_d").over(order)}).drop("_e", "_d")
