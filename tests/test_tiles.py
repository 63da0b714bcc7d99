"""Directional searches in tiles, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rigspark.operators import grid as GD
from rigspark.operators import joins as J


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def grids(spark):
    rng = random.Random(7)
    cells = [[(k, y, x, round(rng.random(), 2)) for k in range(2) for y in range(-3, 19) for x in range(-5, 23) if rng.random() < 0.9] for _ in "ab"]
    return cells, [spark.createDataFrame(c, "k long, y long, x long, v double") for c in cells]


def box(hint, percent):
    dist = int(24 * percent + 50) // 100
    ortho = (dist + 4) // 8
    along = range(-dist, 1) if hint in ("left", "up") else range(dist + 1)
    across = range(-ortho, ortho + 1)
    return [(c, a) if hint in ("left", "right") else (a, c) for a in along for c in across]


@pytest.mark.parametrize("hint", ["left", "right", "up", "down"])
def test_searches_equal_all_pairs(spark, hint, monkeypatch):
    monkeypatch.setattr(J, "TILE_COLS", 7)
    monkeypatch.setattr(GD, "MATCH_TILE", 8, raising=False)
    (a, b), (da, db) = grids(spark)
    there, here = {(k, y, x): v for k, y, x, v in b}, {(k, y, x): v for k, y, x, v in a}
    moves = box(hint, 20.0)
    want = {(k, y, x, oy, ox): (v, there[k, y + oy, x + ox]) for (k, y, x), v in here.items() for oy, ox in moves if (k, y + oy, x + ox) in there}
    got = {(r.k, r.y0, r.x0, r.oy, r.ox): (r.v0, r.v1) for r in J.search_box_candidates(da, db, ["k"], hint, 20.0).collect()}
    assert got == want
    found = {(r.k, r.y, r.x): (r.fy, r.fx, r.error) for r in GD.block_match(da, db, ["k"], hint, 20.0).collect()}
    best = {}
    for k, y, x in here:
        costs = []
        for oy, ox in moves:
            d = [abs(p[0] - p[1]) for i in range(-2, 3) for j in range(-2, 3) if (p := want.get((k, y + i, x + j, oy, ox)))]
            if d:
                length = math.hypot(oy, ox)
                costs.append((round(sum(d) / len(d) * (1 + length / 5) * (1.0 if length else 0.8), 8), abs(oy), abs(ox), oy, ox))
        if costs:
            best[k, y, x] = min(costs)
    assert found.keys() == best.keys()
    assert all(abs(found[c][2] - best[c][0]) < 1e-7 for c in best)
    assert sum(found[c][:2] != best[c][3:] for c in best) <= 2


def test_tiles_are_shuffled_and_not_pairs(spark):
    (a, _), (da, db) = grids(spark)
    for search, most in ((J.search_box_candidates, 1), (GD.block_match, 6)):
        before = shuffled_rows(spark)
        search(da, db, ["k"], "right", 20.0).agg(F.count("*")).collect()
        assert shuffled_rows(spark) - before < 2 * most * len(a) + 100 * (most == 1) * 8
