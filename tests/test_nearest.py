"""Searches that rule out most pairs, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.operators import joins as J
from rigspark.operators import stats as D


@pytest.mark.parametrize("mode", ["floor", "ratio"])
def test_descriptors_equal_brute_force(spark, mode):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 10, (20, 6))
    v = centers[rng.integers(20, size=900)] + rng.normal(0, 1, (900, 6))
    v[5] = v[6]
    rows = [(i % 3 if i < 890 else 9, i, [float(x) for x in v[i]]) for i in range(900)] + [(0, 1000, None), (0, 1001, [float("nan")] * 6), (0, 1003, [None] * 6)]
    df = spark.createDataFrame(rows, "k int, id long, v array<double>")
    sides = [df.where("id % 2 = 0 and k < 9 or id = 890"), df.where("id % 2 = 1 and k < 9 or id = 899")]
    got = {(r.k, r.left_id): (r.right_id, round(r.distance, 9)) for r in J.match_descriptors(*sides, ["k"], "id", "v", mode).collect()}
    want = {}
    for k in (0, 1, 2, 9):
        a, b = ([i for i in range(900) if rows[i][0] == k and (i % 2 == s and k < 9 or i == (890, 899)[s])] for s in (0, 1))
        d = np.sqrt(((v[a][:, None] - v[b][None]) ** 2).sum(-1))
        for i, row in zip(a, d, strict=True):
            at = int(row.argmin())
            if row[at] <= max(3 * d.min(), 0.02) if mode == "floor" else len(b) > 1 and row[at] < 0.75 * np.sort(row)[1]:
                want[k, i] = (b[at], round(float(row[at]), 9))
    assert got == want and len(want) > 10


def test_plan_joins_on_cells_and_limits_ranks(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 50, (16, 8))
    rows = [(0, i, [float(x) for x in centers[i % 16] + rng.normal(0, 1, 8)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "k int, id long, v array<double>")
    out = J.match_descriptors(df.where("id < 800"), df.where("id >= 800"), ["k"], "id", "v", "ratio", ratio=2.0)
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "WindowGroupLimit" in text and out.count() == 800


def test_grid_equals_all_pairs(spark, monkeypatch):
    """Clusters, a far point, a line, equal places, a group of two and a lone point."""
    rng = np.random.default_rng(1)
    groups = {
        0: np.r_[rng.normal(0, 1e-3, (400, 2)), rng.uniform(-50, 50, (60, 2)), [[4000.0, 1.0]]],
        1: np.c_[np.arange(200.0), np.full(200, 7.0)],
        2: np.r_[np.full((30, 2), 3.0), rng.uniform(0, 9, (50, 2))],
        3: np.array([[0.0, 0.0], [5.0, 1.0]]),
        4: np.array([[1.0, 1.0]]),
        5: np.full((100, 2), 2.0),
    }
    rows = [(k, i, float(x), float(y)) for k, p in groups.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame([*rows, (0, 9999, None, 1.0), (0, 9998, float("nan"), 1.0)], "k int, id long, x double, y double")
    monkeypatch.setattr(D, "NEAR_POINTS", 10)
    monkeypatch.setattr(D, "CELL_POINTS", 4)
    got = {(r.k, r.id): r["__d"] for r in D.nearest_distance(df, ["k"], "id", "x", "y").collect()}
    want = {}
    for k, p in groups.items():
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        want |= {(k, i): v for i, v in enumerate(d.min(1)) if np.isfinite(v)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    kept = D.remove_isolated(df, ["k"], "id", "x", "y")
    assert kept.where("k = 1").count() == 200 and kept.where("k = 0 and x = 4000").count() == 0 and kept.columns == df.columns


def test_blocks_give_their_best_in_the_old_order(spark, monkeypatch):
    """Small blocks, equal vectors and an infinite component: as one comparison of all pairs."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    monkeypatch.setattr(J, "STRIP_ROWS", 3)
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(0, 1, (160, 5)), 1)
    v[101] = v[103] = v[2]
    v[7, 0] = np.inf
    df = spark.createDataFrame([(0, i, [float(x) for x in v[i]]) for i in range(160)], "k int, id long, v array<double>")
    got = {r.left_id: (r.right_id, r.distance) for r in J.match_descriptors(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["k"], "id", "v", factor=1e9, pivots=3).collect()}
    want = {}
    for i in range(0, 160, 2):
        d = [np.sqrt(sum(float(a - b) ** 2 for a, b in zip(v[i], v[j], strict=True))) for j in range(1, 160, 2)]
        want[i] = (2 * int(np.argmin(d)) + 1, min(d))
    # The least distance is 0, so only what lies within the floor is kept.
    assert got == {i: w for i, w in want.items() if w[1] <= 0.02} and got[2] == (101, 0.0)
    assert "FlatMapCoGroups" in J.match_descriptors(df, df, ["k"], "id", "v", "ratio")._jdf.queryExecution().executedPlan().toString()
