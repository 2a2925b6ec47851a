"""Neighbourhoods, convolution, edges and gradients on pixel relations.

A (2R + 1) by (2R + 1) neighbourhood costs two exchanges of the pixels whatever R: one window along rows, one along
columns. Joining pixels with offsets would shuffle a copy of the image for every offset.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(axis: str, keys: tuple[str, ...] = ("image_id",)):
    """The window that runs along 'c' (within a row) or along 'r' (within a column)."""
    other = "r" if axis == "c" else "c"
    return Window.partitionBy(*keys, other).orderBy(axis)


def shifted(column: Column | str, by: int, axis: str, border: str = "replicate") -> Column:
    """The value ``by`` places on along an axis; outside the image: the border's value, nought, or null."""
    window = along(axis)
    move = lambda k: F.lead(column, k).over(window) if k > 0 else F.lag(column, -k).over(window)
    if by == 0:
        return F.col(column) if isinstance(column, str) else column
    own = F.col(column) if isinstance(column, str) else column
    if border == "replicate":
        return F.coalesce(*[move(k) for k in range(by, 0, -1 if by > 0 else 1)], own)
    return F.coalesce(move(by), F.lit(0)) if border == "zero" else move(by)


def neighbourhood(px: DataFrame, radius: int = 1, border: str = "null", value: str = "v", name: str = "n") -> DataFrame:
    """The pixels with ``name``: the neighbourhood's values by rising (dr, dc).

    border 'null' leaves places outside null, 'zero' and 'replicate' fill them.
    """
    span = range(-radius, radius + 1)
    rows = px.withColumn("_row", F.struct(*[shifted(value, k, "c", border).alias(f"c{i}") for i, k in enumerate(span)]))
    down = along("r")
    full = []
    for k in span:
        if k == 0:
            row = F.col("_row")
        elif border == "replicate":
            row = F.coalesce(*[(F.lead("_row", j) if k > 0 else F.lag("_row", -j)).over(down) for j in range(k, 0, -1 if k > 0 else 1)], F.col("_row"))
        else:
            row = (F.lead("_row", k) if k > 0 else F.lag("_row", -k)).over(down)
        full.append(row.alias(f"r{k + radius}"))
    wide = rows.withColumn("_all", F.struct(*full))
    fill = (lambda x: F.coalesce(x, F.lit(0))) if border == "zero" else (lambda x: x)
    cells = [fill(F.col(f"_all.r{i}.c{j}")) for i in range(len(span)) for j in range(len(span))]
    return wide.withColumn(name, F.array(*cells)).drop("_row", "_all")


def weighted(name: str, kernel: np.ndarray) -> Column:
    """Sum of the neighbourhood's values by the kernel's weights; noughts cost nothing."""
    terms = [F.col(name)[i] * float(w) for i, w in enumerate(np.asarray(kernel, float).ravel()) if w]
    out = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        out = out + t
    return out


def correlate(px: DataFrame, kernel: np.ndarray, border: str = "zero", name: str = "out") -> DataFrame:
    """Same-size correlation with an odd square kernel."""
    kernel = np.asarray(kernel, float)
    radius = kernel.shape[0] // 2
    return neighbourhood(px, radius, border, name="_n").withColumn(name, weighted("_n", kernel)).drop("_n")


def correlate_padded(px: DataFrame, kernel: np.ndarray, height: int, width: int, border: str = "symmetric", constant: float = 0.0, name: str = "out") -> DataFrame:
    """Correlation with a border that mirrors ('symmetric'), wraps round ('circular') or is a constant.

    The border's rows are made first, as copies of the pixels they repeat; the windows then see a larger image.
    """
    kernel = np.asarray(kernel, float)
    radius = kernel.shape[0] // 2

    def grown(df: DataFrame, axis: str, length: int) -> DataFrame:
        at = F.col(axis)
        if border == "symmetric":
            copies = F.array(at, -1 - at, 2 * length - 1 - at)
        elif border == "circular":
            copies = F.array(at, at - length, at + length)
        else:
            raise ValueError("symmetric or circular")
        spread = df.withColumn("_at", F.explode(F.array_distinct(copies))).where(F.col("_at").between(-radius, length - 1 + radius))
        return spread.withColumn(axis, F.col("_at")).drop("_at")

    inside = F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)
    if border == "constant":
        shifted_ = px.withColumn("v", F.col("v") - constant)
        return correlate(shifted_, kernel, "zero", name).withColumn(name, F.col(name) + constant * float(kernel.sum()))
    large = grown(grown(px.select("image_id", "r", "c", "v"), "r", height), "c", width)
    return correlate(large, kernel, "null", name).where(inside)


def convolve(px: DataFrame, kernel: np.ndarray, mode: str = "same", height: int | None = None, width: int | None = None) -> DataFrame:
    """Convolution with a kernel of any shape: 'full', 'same' (from row and column ceil((k - 1) / 2)) or 'valid'.

    Each pixel meets every weight once, summed before the shuffle where rows of one image share a task.
    """
    kernel = np.asarray(kernel, float)
    weights = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in np.ndenumerate(kernel)])
    spread = px.select("image_id", "r", "c", "v", F.explode(weights).alias("k"))
    full = spread.groupBy("image_id", (F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c")).agg(F.sum(F.col("v") * F.col("k.w")).alias("out"))
    kr, kc = kernel.shape
    if mode == "full":
        return full
    top, left = (math.ceil((kr - 1) / 2), math.ceil((kc - 1) / 2)) if mode == "same" else (kr - 1, kc - 1)
    rows, cols = (height, width) if mode == "same" else (height - kr + 1, width - kc + 1)
    inside = (F.col("r") >= top) & (F.col("r") < top + rows) & (F.col("c") >= left) & (F.col("c") < left + cols)
    return full.where(inside).select("image_id", (F.col("r") - top).alias("r"), (F.col("c") - left).alias("c"), "out")


def response_at(px: DataFrame, kernel: np.ndarray, r: int, c: int, flip: bool = True) -> DataFrame:
    """image_id, out: the response at one pixel, outside nought."""
    kernel = np.asarray(kernel, float)
    kernel = kernel[::-1, ::-1] if flip else kernel
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    weight = F.lit(0.0)
    for (i, j), w in np.ndenumerate(kernel):
        weight = F.when((F.col("r") == r + i - a) & (F.col("c") == c + j - b), float(w)).otherwise(weight)
    near = F.col("r").between(r - a, r + a) & F.col("c").between(c - b, c + b)
    return px.where(near).groupBy("image_id").agg(F.sum(F.col("v") * weight).alias("out"))


# --- kernels --------------------------------------------------------------------------------------------------------

SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
PREWITT = np.array([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], float)
LAPLACE_4 = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
LAPLACE_8 = np.array([[1, 1, 1], [1, -8, 1], [1, 1, 1]], float)


def average_kernel(size: int = 3) -> np.ndarray:
    return np.full((size, size), 1.0 / size**2)


def gaussian_kernel(size: int = 5, sigma: float = 1.0) -> np.ndarray:
    half = size // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    k = np.exp(-(x * x + y * y) / (2 * sigma * sigma))
    return k / k.sum()


def log_kernel(size: int = 5, sigma: float = 1.0) -> np.ndarray:
    """Laplacian of a Gaussian, with its mean removed so that flat areas give nought."""
    half = size // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    s2 = sigma * sigma
    k = gaussian_kernel(size, sigma) * (x * x + y * y - 2 * s2) / (s2 * s2)
    return k - k.mean()


def laplacian_kernel(alpha: float = 0.2) -> np.ndarray:
    a = alpha / (alpha + 1)
    b = (1 - alpha) / (alpha + 1)
    return np.array([[a, b, a], [b, -4 / (alpha + 1), b], [a, b, a]])


def disk_kernel(radius: int = 5) -> np.ndarray:
    """Mean over a disk."""
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    k = (x * x + y * y <= radius * radius).astype(float)
    return k / k.sum()


def unsharp_kernel(alpha: float = 0.2) -> np.ndarray:
    out = -laplacian_kernel(alpha)
    out[1, 1] += 1
    return out


# --- edges ----------------------------------------------------------------------------------------------------------


def gradients(px: DataFrame, kind: str = "sobel", kx: float = 1.0, ky: float = 1.0) -> DataFrame:
    """bx, by and strength kx bx^2 + ky by^2, replicated borders; Sobel over 8, Prewitt over 6, Roberts over 2."""
    n = neighbourhood(px, 1, "replicate", name="_n")
    if kind == "roberts":  # differences along both diagonals of the 2 by 2 square to the right and below
        bx, by = (F.col("_n")[4] - F.col("_n")[8]) / 2.0, (F.col("_n")[5] - F.col("_n")[7]) / 2.0
    else:
        k, scale = (SOBEL, 8.0) if kind == "sobel" else (PREWITT, 6.0)
        bx, by = weighted("_n", k) / scale, weighted("_n", k.T) / scale
    return n.withColumns({"bx": bx, "by": by}).withColumn("strength", kx * F.col("bx") * F.col("bx") + ky * F.col("by") * F.col("by")).drop("_n")


def edges(px: DataFrame, kind: str = "sobel", level: float | None = None, thin: bool = True) -> DataFrame:
    """image_id, r, c, v, strength, cutoff, is_edge.

    Without a level the cutoff is four times the image's mean strength (six for Roberts). Thinning keeps local
    maxima across the stronger direction: strictly above the next, at least the previous; outside counts as nought.
    """
    g = gradients(px, kind)
    whole = Window.partitionBy("image_id")
    cut = F.lit(float(level) ** 2) if level is not None else (6.0 if kind == "roberts" else 4.0) * F.avg("strength").over(whole)
    marked = g.withColumn("cutoff", cut)
    strong = F.col("strength") > F.col("cutoff")
    if not thin:
        return marked.withColumn("is_edge", strong)
    eps = 100 * 2.0**-52
    if kind == "roberts":
        n = neighbourhood(marked, 1, "zero", "strength", "_s")
        first = (F.abs("bx") >= F.abs("by") - eps) & (F.col("_s")[0] <= F.col("strength")) & (F.col("strength") > F.col("_s")[8])
        second = (F.abs("by") >= F.abs("bx") - eps) & (F.col("_s")[2] <= F.col("strength")) & (F.col("strength") > F.col("_s")[6])
        return n.withColumn("is_edge", strong & (first | second)).drop("_s")
    side = {"_l": shifted("strength", -1, "c", "zero"), "_r": shifted("strength", 1, "c", "zero"), "_u": shifted("strength", -1, "r", "zero"), "_d": shifted("strength", 1, "r", "zero")}
    across = (F.abs("bx") >= F.abs("by") - eps) & (F.col("_l") <= F.col("strength")) & (F.col("strength") > F.col("_r"))
    along_ = (F.abs("by") >= F.abs("bx") - eps) & (F.col("_u") <= F.col("strength")) & (F.col("strength") > F.col("_d"))
    return marked.withColumns(side).withColumn("is_edge", strong & (across | along_)).drop(*side)


def log_edges(px: DataFrame, sigma: float = 2.0, level: float | None = None) -> DataFrame:
    """Zero crossings of the Laplacian of a Gaussian: a negative pixel whose neighbour is positive by more than the
    level apart, or an exact nought between opposite signs twice the level apart. Border pixels are never edges."""
    size = 2 * math.ceil(3 * sigma) + 1
    b = correlate(px, log_kernel(size, sigma), "replicate", "b")
    whole = Window.partitionBy("image_id")
    cut = F.lit(float(level)) if level is not None else 0.75 * F.avg(F.abs("b")).over(whole)
    n = neighbourhood(b.withColumn("cutoff", cut), 1, "null", "b", "_n")
    up, left, me, right, down = (F.col("_n")[i] for i in (1, 3, 4, 5, 7))
    inner = up.isNotNull() & left.isNotNull() & right.isNotNull() & down.isNotNull()
    crossing = F.lit(False)
    for x in (up, left, right, down):
        crossing = crossing | ((x > 0) & (x - me > F.col("cutoff")))
    through = lambda x, y: (x * y < 0) & (F.abs(x - y) > 2 * F.col("cutoff"))
    found = inner & (((me < 0) & crossing) | ((me == 0) & (through(up, down) | through(left, right))))
    return n.withColumn("is_edge", F.coalesce(found, F.lit(False))).drop("_n")


def laplacian_crossings(px: DataFrame, level: float, neighbours: int = 4) -> DataFrame:
    """Pixels whose 3 by 3 neighbourhood of the Laplacian holds both more than the level and less than its negative."""
    b = correlate(px, LAPLACE_4 if neighbours == 4 else LAPLACE_8, "replicate", "b")
    n = neighbourhood(b, 1, "null", "b", "_n")
    return n.withColumn("is_edge", (F.array_max("_n") > level) & (F.array_min("_n") < -level)).drop("_n")


# --- differences ----------------------------------------------------------------------------------------------------


def gradient2(px: DataFrame) -> DataFrame:
    """dx along columns, dy along rows: central inside, one-sided at both ends."""
    out = {}
    for name, axis in (("dx", "c"), ("dy", "r")):
        after, before = shifted("v", 1, axis, "null"), shifted("v", -1, axis, "null")
        v = F.col("v")
        out[name] = F.when(after.isNull(), v - before).when(before.isNull(), after - v).otherwise((after - before) / 2.0).cast("double")
    return px.withColumns(out)


def magnitude(dx: Column, dy: Column, kind: str = "l2") -> Column:
    return {"l2": F.sqrt(dx * dx + dy * dy), "squared": dx * dx + dy * dy, "l1": F.abs(dx) + F.abs(dy)}[kind]


def direction(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def forward_second(axis: str = "r") -> Column:
    return shifted("v", 2, axis, "null") - 2 * shifted("v", 1, axis, "null") + F.col("v")


def del2(px: DataFrame) -> DataFrame:
    """A quarter of the Laplacian: half of the centred second difference along each axis, halved again; at the ends
    the difference is extrapolated linearly from the two places next to it."""
    out = px
    for name, axis in (("_dc", "c"), ("_dr", "r")):
        window = along(axis)
        centred = (F.lead("v").over(window) - 2 * F.col("v") + F.lag("v").over(window)) / 2.0
        out = out.withColumn(name, centred.cast("double"))
        after = lambda k: F.lead(name, k).over(window)
        before = lambda k: F.lag(name, k).over(window)
        first, last = F.lag("v").over(window).isNull(), F.lead("v").over(window).isNull()
        out = out.withColumn(name + "x", F.when(first, 2 * after(1) - after(2)).when(last, 2 * before(1) - before(2)).otherwise(F.col(name)))
    return out.withColumn("del2", (F.col("_dcx") + F.col("_drx")) / 2.0).drop("_dc", "_dr", "_dcx", "_drx")


def median3(px: DataFrame) -> DataFrame:
    """3 by 3 median, outside nought."""
    return neighbourhood(px, 1, "zero", name="_n").withColumn("out", F.sort_array("_n")[4]).drop("_n")


def structure_energy(px: DataFrame) -> DataFrame:
    """Line, edge and termination energies of each pixel for active contours."""
    g = gradient2(px.withColumn("v", F.col("v").cast("double")))
    n = neighbourhood(g, 1, "replicate", name="_n")
    cx, cy = (F.col("_n")[5] - F.col("_n")[3]) / 2.0, (F.col("_n")[7] - F.col("_n")[1]) / 2.0
    cxx, cyy = F.col("_n")[5] - 2 * F.col("_n")[4] + F.col("_n")[3], F.col("_n")[7] - 2 * F.col("_n")[4] + F.col("_n")[1]
    cxy = (F.col("_n")[8] - F.col("_n")[6] - F.col("_n")[2] + F.col("_n")[0]) / 4.0
    bend = (cyy * cx * cx - 2 * cxy * cx * cy + cxx * cy * cy) / F.pow(1 + cx * cx + cy * cy, F.lit(1.5))
    return n.withColumns({"line_energy": F.col("v"), "edge_energy": -(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "termination_energy": bend}).drop("_n")
