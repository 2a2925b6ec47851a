"""Queries look at all images of the table and at all of an image."""

import pytest

from gridloom import catalog
from gridloom.operators import kernels as K


@pytest.mark.parametrize("name", ["three_thresholds", "two_layers", "simple_paths"])
def test_every_image_takes_part(spark, name):
    d = "/root/testdata/sf0.01"
    images = {r.i for r in spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id div 1000 as i").distinct().collect()}
    assert len(images) > 4
    assert {r.image_id for r in catalog.queries()[name](spark, d).select("image_id").distinct().collect()} == images


def test_paths_cross_the_whole_image(spark, tmp_path):
    """One way along the upper row and the right column in the first image, none in the second."""
    on = lambda k: k < 40 or k % 40 == 39
    rows = [(k, 50.0 if on(k) else 0.0) for k in range(1000)] + [(1000 + k, 50.0 if on(k) and k != 20 else 0.0) for k in range(1000)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["simple_paths"](spark, str(tmp_path)).collect()
    assert {r.image_id: r.n_paths for r in found} == {0: 1, 1: 0}


def test_paths_of_small_masks_against_recursion():
    import numpy as np

    def every(mask, at, end, path):
        if at == end:
            return [path]
        out = []
        for dr, dc in K.neighbours(4):
            p = (at[0] + dr, at[1] + dc)
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in path:
                out += every(mask, p, end, [*path, p])
        return out

    rng = np.random.default_rng(6)
    for _ in range(30):
        mask = rng.random((4, 5)) < 0.8
        mask[0, 0] = mask[3, 4] = True
        assert K.simple_paths(mask, (0, 0), (3, 4)) == every(mask, (0, 0), (3, 4), [(0, 0)])
