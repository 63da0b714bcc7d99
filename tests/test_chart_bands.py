"""Charts are looked for in bands, and grids labelled in tiles: no image lies in one task."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rigspark.operators import grid as GD
from rigspark.operators import graph as GR
from rigspark.plans import calibration as CAL


def flooded(mask):
    """Label of each cell by flood fill."""
    out, (rows, cols) = {}, mask.shape
    for start in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True):
        if start in out:
            continue
        out[start], stack = start, [start]
        while stack:
            y, x = stack.pop()
            for at in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= at[0] < rows and 0 <= at[1] < cols and mask[at] and at not in out:
                    out[at] = start
                    stack.append(at)
    return out


def cells_of(spark, image, key, name, kind):
    y, x = (a.ravel() for a in np.indices(image.shape))
    return spark.createDataFrame(pd.DataFrame({"k": key, "y": y, "x": x, name: image.ravel()}), f"k long, y long, x long, {name} {kind}")


def test_labels_run_over_tiles_and_only_their_edges_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    masks = {1: rng.random((530, 280)) < 0.42, 2: rng.random((300, 20)) < 0.3}
    masks[1][250:262, 5:270] = True
    df = cells_of(spark, masks[1].astype(int), 1, "mask", "int").union(cells_of(spark, masks[2].astype(int), 2, "mask", "int"))
    edges, components = [], GR.connected_components
    monkeypatch.setattr(GR, "connected_components", lambda df, *a: edges.append(df.count()) or components(df, *a))
    got = {(r.k, r.y, r.x): r.label for r in GD.label_grid(df, ["k"]).collect()}
    want = {(k, *at): f"{k}:{first[0]:08d}:{first[1]:08d}" for k, m in masks.items() for at, first in flooded(m).items()}
    assert got == want
    assert edges[0] < len(want) / 20


def test_bands_find_the_same_dark_parts_as_windows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = cells_of(spark, rng.random((600, 21)), 1, "v", "double").union(cells_of(spark, rng.random((12, 9)), 2, "v", "double"))
    seen, label = [], GD.label_grid
    monkeypatch.setattr(GD, "label_grid", lambda mask, keys: seen.append(mask) or label(mask, keys))
    CAL.detect_patches(df, ["k"], 4, 400, 6, 9, 0.02)
    g = GD.gaussian(df.withColumn("v", F.least(F.col("v") * 2, F.lit(1.0))), ["k"], 5, 1.0)
    m = GD.adaptive_threshold(g, ["k"], 9, 0.02)
    m = GD.close_gaps(m.select("k", "y", "x", F.col("mask").cast("double").alias("v")), ["k"], 1)
    want = {tuple(r) for r in m.where("v < 0.5").select("k", "y", "x").collect()}
    assert {tuple(r) for r in seen[0].where("mask = 1").select("k", "y", "x").collect()} == want
    assert "Window" not in seen[0]._jdf.queryExecution().executedPlan().toString()
