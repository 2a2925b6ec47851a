"""Whole images as numpy arrays inside a task: one group per image (or tile), kernels in between, pixels out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, over all the session's shuffle partitions. The number is stated, as adaptive
    execution would merge partitions by their bytes, and the work that follows a few bytes here is large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def raster(pdf: pd.DataFrame, value: str = "v", fill=0) -> tuple[np.ndarray, int, int]:
    """The dense array of one image's pixels, and its least row and column."""
    r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
    r0, c0 = int(r.min()), int(c.min())
    values = pdf[value].to_numpy()
    out = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), fill, dtype=bool if values.dtype == bool else float if values.dtype.kind == "f" else np.int64)
    out[r - r0, c - c0] = values
    return out, r0, c0


def pixels(arrays: dict[str, np.ndarray], r0: int = 0, c0: int = 0) -> pd.DataFrame:
    first = next(iter(arrays.values()))
    r, c = np.indices(first.shape)
    return pd.DataFrame({"r": r.ravel() + r0, "c": c.ravel() + c0} | {k: a.ravel() for k, a in arrays.items()})


def per_image(px: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    """Run ``kernel`` on every image's array; it returns arrays of the image's shape by name. ``schema`` names them.

    A group is one image: it must fit a task. Larger images go through the tiled operators.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, r0, c0 = raster(pdf, value)
        out = pixels(kernel(a), r0, c0)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    lead = ", ".join(f"{k} bigint" for k in keys)
    return dealt_by(px.select(*keys, "r", "c", value), *keys).groupBy(*keys).applyInPandas(run, f"{lead}, r bigint, c bigint, {schema}")


def rows_per_image(px: DataFrame, kernel: Callable[[np.ndarray], pd.DataFrame], schema: str, keys: tuple[str, ...] = ("image_id",), value: str = "v") -> DataFrame:
    """Run ``kernel`` on every image's array; it returns any rows of ``schema``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, _, _ = raster(pdf, value)
        out = kernel(a)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    lead = ", ".join(f"{k} bigint" for k in keys)
    return dealt_by(px.select(*keys, "r", "c", value), *keys).groupBy(*keys).applyInPandas(run, f"{lead}, {schema}")


Region = dict[str, np.ndarray]


def filled(region: Region) -> tuple[np.ndarray, int, int]:
    """The mask of a region's pixels in their own box, and the box's least row and column."""
    r, c = region["r"], region["c"]
    r0, c0 = int(r.min()), int(c.min())
    out = np.zeros((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), bool)
    out[r - r0, c - c0] = True
    return out, r0, c0


#: Regions of neighbouring labels that a task group holds: the groups grow in number with an image's regions.
REGIONS = 64


def per_region(labels: DataFrame, kernel: Callable[[Region], dict[str, list | np.ndarray]], schema: str, keys: tuple[str, ...] = ("image_id", "label"), columns: tuple[str, ...] = ("r", "c"), regions: int = REGIONS) -> DataFrame:
    """Run ``kernel`` on the pixels of every region; it returns the columns of ``schema`` without the keys, as
    arrays or lists.

    A task group is a run of ``regions`` labels of one image, not one region: most regions are small, and a group of
    its own costs more than they do.
    """
    image, label = keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf[label].to_numpy(), kind="stable")
        arrays = {k: pdf[k].to_numpy()[order] for k in (label, *columns)}
        names = arrays[label]
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        found, sizes = [], []
        for a, b in zip(cuts, cuts[1:]):
            rows = kernel({k: arrays[k][a:b] for k in columns})
            found.append(rows)
            sizes.append(len(next(iter(rows.values()))))
        whole = {image: pdf[image].iloc[0], label: np.repeat(names[cuts[:-1]], sizes)}
        for k in found[0]:
            parts = [f[k] for f in found]
            whole[k] = np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]
        return pd.DataFrame(whole)

    dealt = labels.select(image, label, *columns).withColumn("_bucket", F.floor(F.col(label) / regions))
    return dealt_by(dealt, image, "_bucket").groupBy(image, "_bucket").applyInPandas(run, f"{image} bigint, {label} bigint, {schema}")
