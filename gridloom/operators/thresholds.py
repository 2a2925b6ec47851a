"""Thresholds from histograms: everything after the count works on 256 rows an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.histograms import gray_histogram


def _running(hist: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Whole-number class masses at every level, so that results don't depend on the order of sums."""
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    g = F.col("bin") + 1
    return hist.select(
        *keys,
        F.col("bin").alias("t"),
        "n",
        F.sum("n").over(order).alias("w"),
        F.sum(g * F.col("n")).over(order).alias("m"),
        F.sum("n").over(whole).alias("total"),
        F.sum(g * F.col("n")).over(whole).alias("mass"),
        F.sum(g * g * F.col("n")).over(whole).alias("square"),
    )


def otsu_curves(hist: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, t, p0, p1, mean0, mean1, sigma_b2, eta; null where a class is empty. Means are in gray levels from 0."""
    run = _running(hist, keys)
    w, rest = F.col("w").cast("double"), (F.col("total") - F.col("w")).cast("double")
    between = F.col("mass").cast("double") * w - F.col("total").cast("double") * F.col("m")
    n = F.col("total").cast("double")
    sigma = F.when((w > 0) & (rest > 0), F.try_divide(between * between, w * rest) / (n * n))
    spread = F.col("square") / n - (F.col("mass") / n) * (F.col("mass") / n)
    return run.select(
        *keys,
        "t",
        (w / n).alias("p0"),
        (rest / n).alias("p1"),
        (F.try_divide(F.col("m").cast("double"), w) - 1).alias("mean0"),
        (F.try_divide((F.col("mass") - F.col("m")).cast("double"), rest) - 1).alias("mean1"),
        sigma.alias("sigma_b2"),
        F.when(spread > 0, sigma / spread).alias("eta"),
    )


def otsu(hist: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, threshold (the mean of the levels that tie), level (of 255), effectiveness; noughts for a constant image."""
    run = _running(hist, keys)
    w, rest = F.col("w").cast("double"), (F.col("total") - F.col("w")).cast("double")
    between = F.col("mass").cast("double") * w - F.col("total").cast("double") * F.col("m")
    score = F.when((w > 0) & (rest > 0), F.try_divide(between * between, w * rest))
    marked = run.withColumn("score", score).withColumn("best", F.max("score").over(Window.partitionBy(*keys)))
    n = F.col("total").cast("double")
    spread = F.col("square") * n - F.col("mass").cast("double") * F.col("mass")
    return marked.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("score") == F.col("best"), F.col("t"))), F.lit(0.0)).alias("threshold"),
        F.coalesce(F.max(F.try_divide(F.col("best"), spread)), F.lit(0.0)).alias("effectiveness"),
    ).withColumn("level", F.col("threshold") / 255.0)


def with_threshold(px: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Pixels with their image's threshold. One row an image: Spark broadcasts that side where its size allows."""
    return px.join(found.select(*keys, "threshold"), list(keys))


def otsu_mask(px: DataFrame) -> DataFrame:
    """image_id, r, c, v: the pixels strictly above their image's Otsu threshold."""
    return with_threshold(px, otsu(gray_histogram(px))).select("image_id", "r", "c", (F.col("v") > F.col("threshold")).alias("v"))


def concentration(mask: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return mask.groupBy(*keys).agg(F.avg(F.col("v").cast("int")).alias("concentration"))


def otsu_concentration(px: DataFrame) -> DataFrame:
    """image_id, threshold, effectiveness, concentration: pixels are counted once, by level; no pixel is joined."""
    hist = gray_histogram(px)
    found = otsu(hist)
    above = F.sum(F.when(F.col("bin") > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")
    return hist.join(found, "image_id").groupBy("image_id", "threshold", "effectiveness").agg(above.alias("concentration"))


def block_otsu(px: DataFrame, height: int, width: int, n_r: int = 5, n_c: int = 4, compare: str = "gt") -> DataFrame:
    """image_id, block_r, block_c, threshold, n_object, n_pixels, concentration; blocks must divide the image."""
    if height % n_r or width % n_c:
        raise ValueError(f"{n_r} by {n_c} blocks don't divide {height} by {width}")
    keys = ("image_id", "block_r", "block_c")
    blocks = px.withColumns({"block_r": F.expr(f"r div {height // n_r}"), "block_c": F.expr(f"c div {width // n_c}")})
    hist = gray_histogram(blocks, keys=keys)
    above = F.col("bin") > F.col("threshold") if compare == "gt" else F.col("bin") >= F.col("threshold")
    counted = hist.join(otsu(hist, keys).select(*keys, "threshold"), list(keys)).groupBy(*keys, "threshold")
    return counted.agg(F.sum(F.when(above, F.col("n")).otherwise(0)).alias("n_object"), F.sum("n").alias("n_pixels")).withColumn("concentration", F.col("n_object") / F.col("n_pixels"))


def block_summary(blocks: DataFrame) -> DataFrame:
    """Pooled and unweighted concentration of each image."""
    return blocks.groupBy("image_id").agg((F.sum("n_object") / F.sum("n_pixels")).alias("pooled"), F.avg("concentration").alias("unweighted"), F.avg("threshold").alias("mean_threshold"))


def _single_bins(px: DataFrame) -> DataFrame:
    """Histogram of the image stretched to its own range in single precision, and the range."""
    ranged = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))  # at most one row a level
    whole = Window.partitionBy("image_id")
    low, high = F.min("v").over(whole), F.max("v").over(whole)
    at = F.when(high > low, F.floor((F.col("v") - low).cast("float") / (high - low).cast("float") * F.lit(255.0).cast("float") + F.lit(0.5).cast("float"))).otherwise(0).cast("bigint")
    return ranged.select("image_id", at.alias("bin"), "n", low.alias("low"), high.alias("high"))


def two_thresholds(px: DataFrame) -> DataFrame:
    """image_id, low_threshold, high_threshold (in the image's own levels) that part three classes best.

    Every pair of levels of an image's 256-row table is scored: 32 640 rows an image, whatever its pixels.
    """
    bins = _single_bins(px)
    ends = bins.groupBy("image_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    filled = bins.groupBy("image_id", "bin").agg(F.sum("n").alias("n"))
    every = ends.select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))).alias("bin"))
    hist = every.join(filled, ["image_id", "bin"], "left").select("image_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    run = _running(hist, ("image_id",)).select("image_id", "t", "w", "m", "total", "mass")
    a, b = run.alias("a"), run.select("image_id", F.col("t").alias("t2"), F.col("w").alias("w2"), F.col("m").alias("m2")).alias("b")
    pairs = a.join(b, "image_id").where("t < t2")
    w1, w2, w3 = F.col("w").cast("double"), (F.col("w2") - F.col("w")).cast("double"), (F.col("total") - F.col("w2")).cast("double")
    m1, m2, m3 = F.col("m").cast("double"), (F.col("m2") - F.col("m")).cast("double"), (F.col("mass") - F.col("m2")).cast("double")
    score = F.when((w1 > 0) & (w2 > 0) & (w3 > 0), F.try_divide(m1 * m1, w1) + F.try_divide(m2 * m2, w2) + F.try_divide(m3 * m3, w3))
    scored = pairs.select("image_id", "t", "t2", score.alias("score")).where("score is not null")
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("image_id")))  # the join's own partitions
    tied = best.where(F.col("score") >= F.col("best") * (1 - 1e-13)).groupBy("image_id").agg(F.avg("t").alias("t1"), F.avg("t2").alias("t2"))
    back = lambda t: F.floor(F.col("low") + F.col(t) / 255.0 * (F.col("high") - F.col("low")) + 0.5).cast("bigint")
    return tied.join(ends, "image_id").select("image_id", back("t1").alias("low_threshold"), back("t2").alias("high_threshold"))


def quantize(v: Column, levels: list[Column]) -> Column:
    """1 + how many levels lie below v."""
    out = F.lit(1).cast("bigint")
    for x in levels:
        out = out + (v > x).cast("bigint")
    return out


def class_table(px: DataFrame, labels: Column, k: int, pixels: Column | None = None) -> DataFrame:
    """image_id, class (1 to k), coverage, mean gray (null for an empty class). Rows are pixels or, with ``pixels``, the
    levels of an image and how many pixels have each."""
    pixels = F.lit(1) if pixels is None else pixels
    counted = px.groupBy("image_id", labels.alias("class")).agg(F.sum(pixels).alias("n"), F.sum(F.col("v") * pixels).alias("s"))
    every = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("class"))
    whole = Window.partitionBy("image_id")
    joined = every.join(counted, ["image_id", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return joined.select("image_id", "class", (F.col("n") / F.sum("n").over(whole)).alias("coverage"), F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")).alias("mean_gray"))


def separability(hist: DataFrame, level: int) -> DataFrame:
    """image_id, eta of a fixed level; nought outside 0 to 254 and for constant images."""
    found = otsu_curves(hist).where(F.col("t") == level).select("image_id", F.coalesce("eta", F.lit(0.0)).alias("eta"))
    return found if 0 <= level <= 254 else found.withColumn("eta", F.lit(0.0))


def three_thresholds(px: DataFrame) -> DataFrame:
    """image_id, t1, t2, t3 that part four classes best: all triples of an image's 256-row table, in one task an image."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        n = np.bincount(pdf["bin"], weights=pdf["n"], minlength=256)
        w, m = np.cumsum(n), np.cumsum(n * np.arange(1, 257))
        best, found = -1.0, []
        with np.errstate(all="ignore"):
            last = np.where(w[-1] > w, (m[-1] - m) ** 2 / (w[-1] - w), np.nan)
            for a in np.flatnonzero(w > 0)[:-2] if len(w) > 2 else ():
                first = m[a] ** 2 / w[a]
                wb, mb = w[a + 1 :] - w[a], m[a + 1 :] - m[a]
                second = np.where(wb > 0, mb**2 / wb, np.nan)
                wc, mc = w[None, a + 1 :] - w[a + 1 :, None], m[None, a + 1 :] - m[a + 1 :, None]
                total = first + second[:, None] + np.where(wc > 0, mc**2 / wc, np.nan) + last[None, a + 1 :]
                top = np.nanmax(total) if np.isfinite(total).any() else -1.0
                if top >= best * (1 - 1e-13):
                    places = [(a, a + 1 + i, a + 1 + j) for i, j in np.argwhere(total >= top * (1 - 1e-13))]
                    found = places if top > best * (1 + 1e-13) else found + places
                    best = max(best, top)
        t = np.mean(found, axis=0) if found else np.zeros(3)
        back = np.floor(low + t / 255 * (high - low) + 0.5).astype(np.int64)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "t1": [back[0]], "t2": [back[1]], "t3": [back[2]]})

    return _single_bins(px).groupBy("image_id").applyInPandas(run, "image_id bigint, t1 bigint, t2 bigint, t3 bigint")
