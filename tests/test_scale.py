"""Operators that must not hold a group, an image or a quadratic number of cells."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.functions.scalars import BAYER
from rigspark.operators import bands as BD
from rigspark.operators import grid as GD
from rigspark.operators import stats as D


def test_ranks_of_large_groups_without_sorting_them(spark, monkeypatch):
    e = F.xxhash64("id") % 1_000_003
    rows = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), "id", e.alias("e"))
    # Ties, both infinities, huge and tiny values, nulls and NaN.
    v = F.when(F.col("id") % 4 == 0, 1.5).when(F.col("id") % 1001 == 0, float("inf")).when(F.col("id") % 1003 == 0, float("nan")).when(F.col("id") % 1009 == 0, None)
    rows = rows.select("k", v.otherwise(F.col("e") * F.pow(F.lit(10.0), (F.col("id") % 40) - 20)).alias("v")).cache()
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 0.99999, 1.0]
    want = sorted(map(str, D.floor_percentile(rows, ["k"], "v", ps).collect()))
    monkeypatch.setattr(D, "GROUP_ROWS", 0)
    assert sorted(map(str, D.floor_percentile(rows, ["k"], "v", ps).collect())) == want
    all_ = D.floor_percentile(rows, [], "v", [0.5]).first().value
    values = np.sort([r.v for r in rows.collect() if r.v is not None and not np.isnan(r.v)])
    assert all_ == values[len(values) // 2]
    assert D.floor_percentile(rows.limit(0), ["k"], "v", ps).count() == 0
    few = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9)], "k string, v int")
    assert sorted(map(tuple, D.floor_percentile(few, ["k"], "v", [0.5]).collect())) == [("a", 0.5, 3), ("b", 0.5, 9)]


def fold(a, alpha, boundary):
    """The recursion cell by cell."""
    n, s, buffer = len(a), a[0], []
    for j in range(1, n + 1):
        s = alpha * s + (1 - alpha) * (a[j] if j < n else a[0] if boundary == "wrap" else a[n - 2])
        buffer.append(s)
    out, s = [0.0] * n, buffer[-1]
    for k in range(n - 1, -1, -1):
        s = alpha * s + (1 - alpha) * (buffer[k - 1] if k else buffer[-1] if boundary == "wrap" else buffer[1])
        out[k] = s
    return out


@pytest.mark.parametrize("boundary", ["reflect", "wrap"])
def test_lowpass_is_the_fold_at_any_length(spark, monkeypatch, boundary):
    rng = np.random.default_rng(3)
    lines = {i: rng.random(n) for i, n in enumerate((2, 3, 31, 32, 33, 200, 1025))}
    df = spark.createDataFrame([(1, i, j, float(v)) for i, a in lines.items() for j, v in enumerate(a)], "k int, y int, x int, v double")
    monkeypatch.setattr(GD, "SCAN_CELLS", 8)
    got = {}
    for r in GD.iir_lowpass(df, ["k"], "y", "x", "v", 0.25, boundary).collect():
        got.setdefault(r.y, {})[r.x] = r.lp
    for i, a in lines.items():
        want = fold(a.tolist(), 0.25**0.25, boundary)
        assert np.allclose([got[i][j] for j in range(len(a))], want, atol=1e-12)
    for alpha in (0.0, 0.999999):
        assert np.allclose(GD.lowpass(lines[6][None], alpha, boundary)[0], fold(lines[6].tolist(), alpha, boundary), atol=1e-9)


def test_lowpass_of_a_million_cells_takes_linear_time(spark):
    a = np.random.default_rng(1).random((1, 1_000_000))
    began = time.time()
    out = GD.lowpass(a, 0.9, "reflect")
    assert time.time() - began < 5 and np.allclose(out[0, :50], fold(a[0, :5000].tolist(), 0.9, "reflect")[:50], atol=1e-9)
    long = spark.range(1_000_000).select(F.lit(0).alias("y"), F.col("id").alias("x"), F.rand(1).alias("v"))
    assert GD.iir_lowpass(long, [], "y", "x", "v", 0.25).count() == 1_000_000


def plain_demosaic(m, pattern):
    """Green by vote and constant hue, cell by cell from the formulas."""
    h, w = m.shape
    color = lambda i, j: BAYER[pattern][(i % 2) * 2 + j % 2]
    ri = lambda i: -i if i < 0 else 2 * h - i - 2 if i >= h else i
    rj = lambda j: -j if j < 0 else 2 * w - j - 2 if j >= w else j
    at = lambda a, i, j: a[ri(i), rj(j)]
    gv, gh, dv, dh = (np.zeros((h, w)) for _ in range(4))
    for i in range(h):
        for j in range(w):
            for g, d, (a, b) in ((gv, dv, (1, 0)), (gh, dh, (0, 1))):
                one, two = (at(m, i - a, j - b), at(m, i + a, j + b)), (at(m, i - 2 * a, j - 2 * b), at(m, i + 2 * a, j + 2 * b))
                if color(i, j) == 1:
                    g[i, j], d[i, j] = m[i, j], (abs(two[1] - m[i, j]) + abs(m[i, j] - two[0])) / 2
                else:
                    g[i, j] = (one[0] + one[1]) / 2 + (2 * m[i, j] - two[0] - two[1]) / 4
                    d[i, j] = abs(one[0] - one[1]) / 2 + abs(-2 * m[i, j] + two[0] + two[1]) / 2
    green = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            votes = sum(at(dh, i + a, j + b) <= at(dv, i + a, j + b) for a in range(-4, 5) for b in range(-4, 5))
            green[i, j] = gv[i, j] if votes < 40 else gh[i, j]
    diff = {c: np.array([[m[i, j] - green[i, j] if color(i, j) == c else 0.0 for j in range(w)] for i in range(h)]) for c in (0, 2)}
    out = {1: green}
    for c in (0, 2):
        a = np.zeros((h, w))
        for i in range(h):
            for j in range(w):
                d = lambda *places: sum(at(diff[c], i + y, j + x) for y, x in places) / len(places)
                if color(i, j) == c:
                    a[i, j] = d((0, 0), (-2, 0), (2, 0), (0, -2), (0, 2))
                elif color(i, j) == 2 - c:
                    a[i, j] = d((-1, -1), (1, -1), (-1, 1), (1, 1))
                elif c in (color(i, 0), color(i, 1)):
                    a[i, j] = d((-2, -1), (0, -1), (2, -1), (-2, 1), (0, 1), (2, 1))
                else:
                    a[i, j] = d((-1, -2), (-1, 0), (-1, 2), (1, -2), (1, 2), (1, 2))
        out[c] = a + green
    return [out[c] for c in range(3)]


@pytest.mark.parametrize("pattern", ["RGGB", "GRBG", "GBRG", "BGGR"])
def test_edge_aware_demosaic_votes_like_the_formula(spark, monkeypatch, pattern):
    monkeypatch.setattr(BD, "BAND_ROWS", 5)
    y, x = np.mgrid[:36, :30]
    # Colored edges across, down and aslant, and a noisy corner.
    scene = np.stack([0.2 + 0.6 * (x > 11), 0.3 + 0.5 * (y > 17) - 0.2 * (x > 11), 0.1 + 0.7 * (x + y > 40)])
    scene[:, 26:, 20:] += np.random.default_rng(2).random((3, 10, 10)) * 0.3
    channel = np.array(BAYER[pattern]).reshape(2, 2)[y % 2, x % 2]
    m = np.take_along_axis(scene, channel[None], 0)[0]
    df = spark.createDataFrame([(7, int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "k int, y long, x long, v double")
    want = plain_demosaic(m, pattern)
    got = GD.demosaic_edge_aware(df, ["k"], pattern).collect()
    assert len(got) == m.size
    for r in got:
        assert np.allclose([r.r, r.g, r.b], [c[r.y, r.x] for c in want], atol=1e-9)


def test_edge_aware_demosaic_fills_missing_cells(spark):
    df = spark.createDataFrame([(7, int(i), int(j), 0.5) for i in range(12) for j in range(12) if (i, j) not in ((3, 4), (11, 11), (6, 0))], "k int, y long, x long, v double")
    full = df.unionByName(spark.createDataFrame([(7, 3, 4, 0.0), (7, 11, 11, 0.0), (7, 6, 0, 0.0)], df.schema))
    get = lambda d: {(r.y, r.x): (r.r, r.g, r.b) for r in GD.demosaic_edge_aware(d, ["k"]).collect()}
    assert get(df) == get(full) and len(get(df)) == 144
