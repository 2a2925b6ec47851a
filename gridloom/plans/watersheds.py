"""Watershed segmentations, one image a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.operators import kernels as K
from gridloom.operators.morphology import Offsets, disk, square
from gridloom.operators.rasters import per_image, rows_per_image


def _moved(a: np.ndarray, dr: int, dc: int, fill):
    return K._shift(a, dr, dc, fill)


def dilate_array(a: np.ndarray, se: Offsets) -> np.ndarray:
    low = False if a.dtype == bool else -np.inf
    out = np.full(a.shape, low, dtype=a.dtype if a.dtype == bool else float)
    for dr, dc in se:
        out = np.maximum(out, _moved(a if a.dtype == bool else a.astype(float), -dr, -dc, low))
    return out


def erode_array(a: np.ndarray, se: Offsets) -> np.ndarray:
    high = True if a.dtype == bool else np.inf
    out = np.full(a.shape, high, dtype=a.dtype if a.dtype == bool else float)
    for dr, dc in se:
        out = np.minimum(out, _moved(a if a.dtype == bool else a.astype(float), dr, dc, high))
    return out


def inverse_distance(mask: np.ndarray, metric: str = "cityblock") -> np.ndarray:
    """The negated distance to the background, in single precision: basins at the middles of objects."""
    d = K.distance(mask, metric)
    return (-np.where(np.isinf(d), mask.size, d)).astype(np.float32)


def _cut(mask: np.ndarray, flooded: np.ndarray, min_area: int) -> np.ndarray:
    return K.label(K.area_open(mask & (flooded > 0), min_area, 8), 8)[0]


def distance_watershed(mask: DataFrame, metric: str = "chessboard", min_area: int = 5) -> DataFrame:
    """image_id, r, c, label: objects cut along the watershed of their inverse distance, small parts dropped."""
    return per_image(mask, lambda a: {"label": _cut(a, K.watershed(inverse_distance(a, metric)), min_area)}, "label bigint")


def marker_arrays(mask: np.ndarray, metric: str, radius: int, points: bool) -> np.ndarray:
    inverse = inverse_distance(mask, metric)
    marker = dilate_array(K.regional_minima(inverse) & mask, disk(radius))
    if points:
        labels, n = K.label(marker)
        marker = np.zeros_like(marker)
        for k in range(1, n + 1):
            r, c = np.nonzero(labels == k)
            marker[int(np.floor(r.mean() + 0.5)), int(np.floor(c.mean() + 0.5))] = True
    return marker


def marker_watershed(mask: DataFrame, metric: str = "cityblock", radius: int = 2, points: bool = False, min_area: int = 5) -> DataFrame:
    """The same with near minima merged first by growing them, then imposed as the only minima."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        if not a.any():
            return {"label": np.zeros(a.shape, np.int64)}
        imposed = K.impose_minima(inverse_distance(a, metric), marker_arrays(a, metric, radius, points))
        return {"label": _cut(a, K.watershed(np.nan_to_num(imposed, neginf=-1e12)), min_area)}

    return per_image(mask, run, "label bigint")


def direct_watershed(px: DataFrame) -> DataFrame:
    return per_image(px, lambda a: {"label": K.watershed(a)}, "label bigint")


def immersion_watershed(px: DataFrame) -> DataFrame:
    return per_image(px, lambda a: {"label": K.immersion(a)}, "label bigint")


def sobel_magnitude(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy)


def gradient_watershed(px: DataFrame, smooth: int = 3) -> DataFrame:
    """image_id, r, c, raw, smoothed: watersheds of the gradient, before and after closing and opening it."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        g = sobel_magnitude(a)
        se = square(smooth)
        closed = erode_array(dilate_array(g, se), se)
        opened = dilate_array(erode_array(closed, se), se)
        return {"raw": K.watershed(g), "smoothed": K.watershed(opened)}

    return per_image(px, run, "raw bigint, smoothed bigint")


def concave_pixels(region: np.ndarray, low: int = 3, high: int = 10) -> set[tuple[int, int]]:
    """Points of an object's contour where the running turn's three-step sum rises by ``low`` to ``high`` in three steps."""
    outline = K.trace(region)
    code = np.array(K.freeman(outline))
    m = len(code)
    if m < 3:
        return set()
    turn = (code - np.roll(code, 1) + 8) % 8
    turn = np.where(turn > 4, turn - 8, turn)
    whole = int(turn.sum())
    run = np.cumsum(turn)
    last = np.concatenate([run[-2:] - whole, run])
    sums = last[2:] + last[1:-1] + last[:-2]
    change = np.concatenate([sums[3:], sums[:3] + 3 * whole])[:m] - sums
    return set(map(tuple, outline[:-1][(change >= low) & (change <= high)].tolist()))


def line_ends(line: np.ndarray, relative: bool = True) -> set[tuple[int, int]]:
    """End pixels of a thin 4-connected line. Each pixel counts 4 if it is on the line, less its 4-neighbours on it;
    ends have the largest size of that count (``relative``), or a count of 3 and more."""
    count = 4 * line.astype(int) - sum(K._shift(line.astype(int), dr, dc, 0) for dr, dc in K.N4)
    hit = np.abs(count) >= np.abs(count).max() if relative else count >= 3
    return set(map(tuple, np.argwhere(hit).tolist()))


def merge_regions(mask: DataFrame, metric: str = "cityblock", sequential: bool = True, low: int = 3, high: int = 10, relative: bool = True) -> DataFrame:
    """image_id, r, c, label: watershed lines go whose ends both fail to be concave points of what they part.

    Lines are the 4-connected pieces of the watershed within the object, judged in column order of their first pixel.
    What a line parts is the 8-connected component that holds it once it alone is put back; sequentially, lines that
    went before are back too.
    """

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        ridge = (K.watershed(inverse_distance(a, metric)) == 0) & a
        lines, n = K.label(ridge, 4)
        parted = a & ~ridge
        merged = parted.copy()
        for k in range(1, n + 1):
            line = lines == k
            whole, _ = K.label((merged if sequential else parted) | line, 8)
            region = whole == whole[line][0]
            if not line_ends(line, relative) & concave_pixels(region, low, high):
                merged |= line
        return {"label": K.label(merged, 8)[0]}

    return per_image(mask, run, "label bigint")


def junctions(mask: DataFrame) -> DataFrame:
    """image_id, r, c, links, is_end: object pixels of thin lines with how many 8-neighbours they have."""

    def run(a: np.ndarray) -> pd.DataFrame:
        links = sum(K._shift(a.astype(int), dr, dc, 0) for dr, dc in K.N8)
        r, c = np.nonzero(a)
        return pd.DataFrame({"r": r, "c": c, "links": links[r, c], "is_end": links[r, c] <= 1})

    return rows_per_image(mask, run, "r bigint, c bigint, links bigint, is_end boolean")
