"""Bands of an image are refined together, in runs: the field is that of each band by itself."""

import numpy as np
import pandas as pd

from rigspark.operators import bands as BD
from rigspark.plans import flow as FL


def image_of(rows, cols, seed):
    rng = np.random.default_rng(seed)
    a = FL.blur(rng.random((rows, cols)), (5, 1.0))
    return {"v0": a, "v1": np.roll(a, 1, 1), "a0": np.ones_like(a), "a1": (rng.random(a.shape) < 0.97).astype(float)}


def test_bands_refined_together_are_those_refined_alone():
    whole = BD.Band(0, slice(0, 400), 400, image_of(400, 30, 1))
    bands = BD.cut(whole, 64, 18)
    assert [(b.first, b.own.start, b.own.stop, len(b["v0"])) for b in bands[:2]] == [(0, 0, 64, 82), (46, 18, 82, 100)]
    assert np.concatenate([b.y for b in bands]).tolist() == list(range(400))
    same = [b for b in bands if len(b["v0"]) == 100]
    rng = np.random.default_rng(2)
    fx, fy = (rng.normal(0, 2, (len(same), 100, 30)) for _ in range(2))
    together = FL.refined(same, fx, fy)
    for i, band in enumerate(same):
        alone = FL.refined([band], fx[i : i + 1], fy[i : i + 1])
        assert all((t[i] == a[0]).all() for t, a in zip(together, alone, strict=True))


def test_median_is_that_of_each_square():
    a = np.random.default_rng(3).normal(size=(2, 9, 7))
    p = np.pad(a, ((0, 0), (2, 2), (2, 2)), mode="edge")
    want = [[[np.median(p[k, i : i + 5, j : j + 5]) for j in range(7)] for i in range(9)] for k in range(2)]
    assert (FL.median5(a) == np.array(want)).all()


def test_the_length_of_a_run_does_not_matter(spark, monkeypatch):
    parts = [image_of(rows, 26, k) for k, rows in ((1, 300), (2, 40))]
    frame = pd.concat([pd.DataFrame({"k": k, "y": range(len(p["v0"])), "h": len(p["v0"])} | {c: a.tolist() for c, a in p.items()}) for k, p in enumerate(parts)])
    rows = spark.createDataFrame(frame, "k long, y long, h long, v0 array<double>, v1 array<double>, a0 array<double>, a1 array<double>").cache()
    got = []
    for cells in (1, FL.RUN_CELLS):
        monkeypatch.setattr(FL, "RUN_CELLS", cells)
        got.append({(r.k, r.y): (r.h, r.fx, r.fy) for r in FL.step(rows, None, ["k"], "right", 20.0).collect()})
    assert len(got[0]) == 340 and got[0] == got[1]
