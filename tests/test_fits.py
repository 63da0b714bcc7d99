import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.functions import camera as C
from rigspark.operators import fit as FT
from rigspark.operators import grid as GD
from rigspark.plans.calibration import visible_observations


def test_linear_regression_by_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 2))
    y = x @ [1.5, -2.0] + 0.3
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    m = FT.linreg_gd(df, ["a", "b"], ["y"], 2000, 0.5)
    assert m.ravel() == pytest.approx([1.5, -2.0, 0.3], abs=1e-4)
    a = np.c_[x, np.ones(200)]
    w = np.zeros(3)
    for _ in range(7):
        w -= 0.5 * (a.T @ (a @ w - y)) / 200
    assert FT.linreg_gd(df, ["a", "b"], ["y"], 7, 0.5).ravel() == pytest.approx(w)
    assert FT.linreg_gd(df.limit(0), ["a"], ["y"]).tolist() == [[0.0], [0.0]]


def test_points_are_found_again(spark):
    truth = B.points(spark, "/root/testdata/sf0.001").where("point_id <= 60")
    obs = visible_observations(truth, B.rig(spark)).drop("x", "y", "z")
    obs = obs.join(obs.groupBy("point_id").count().where("count > 1"), "point_id")
    start = truth.join(obs.select("point_id").distinct(), "point_id").select("point_id", *((F.col(c) * 1.05 + 3).alias(c) for c in "xyz"))
    got = {r.point_id: (r.x, r.y, r.z) for r in FT.triangulate(obs, ["point_id"], start, 6).collect()}
    want = {r.point_id: (r.x, r.y, r.z) for r in truth.collect()}
    assert got and all(np.allclose(got[p], want[p], atol=0.5) for p in got)


def test_project_and_unproject_are_inverse(spark):
    rig = B.rig(spark).withColumn("distortion", F.array(F.lit(0.05), F.lit(0.01)))
    px = spark.createDataFrame([(1024.0, 1024.0), (700.0, 1300.0), (1500.0, 900.0)], "px double, py double").crossJoin(rig)
    far = C.near_infinity(F.col("px"), F.col("py"))
    rows = px.withColumns({c: f for c, f in zip("xyz", far, strict=True)})
    rows = rows.withColumn("p", C.projected(tuple(F.col(c) for c in "xyz")))
    assert rows.where((F.abs(F.col("p.u") - F.col("px")) > 1e-2) | (F.abs(F.col("p.v") - F.col("py")) > 1e-2)).count() == 0


def test_midpoint_of_parallel_rays_is_far(spark):
    one = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(*C.midpoint(one(0, 0, 0), one(1, 0, 0), one(0, 2, 0), one(1, 0, 0)), *C.midpoint(one(0, 0, 0), one(1, 1, 0), one(2, 0, 0), one(-1, 1, 0))).first()
    assert row[0] == pytest.approx(1e6) and list(row[3:]) == pytest.approx([1, 1, 0])


def test_homography_inliers(spark):
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.02, 5], [-0.01, 0.95, -3], [1e-5, 2e-5, 1]])
    rows = []
    for i in range(160):
        p = rng.random(2) * 1000
        q = h @ [*p, 1]
        q = q[:2] / q[2] if i < 120 else rng.random(2) * 1000
        rows.append((i, *map(float, p), *map(float, q)))
    got = FT.ransac_inliers(spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double"), 1.0, 80)
    ids = {r.i for r in got.collect()}
    assert set(range(120)) <= ids and len(ids) <= 124


def test_vignetting_surface_is_recovered(spark):
    rng = np.random.default_rng(2)
    bez = lambda c, t: sum(math.comb(4, i) * (1 - t) ** (4 - i) * t**i * k for i, k in enumerate(c))
    h, v = [1.2, 1.0, 0.8, 1.0, 1.0], [1.5, 1.0, 0.9, 1.1, 1.4]
    pts = rng.random((120, 2))
    rows = [(1, float(x), float(y), float(bez(h, x) * bez(v, y))) for x, y in pts]
    [r] = FT.fit_vignetting(spark.createDataFrame(rows, "cam int, x double, y double, t double"), ["cam"], "x", "y", "t", rounds=6).collect()
    assert max(abs(bez(r.h, x) * bez(r.v, y) - t) for _, x, y, t in rows) < 1e-3


def test_edge_aware_demosaic_of_a_ramp(spark):
    rows = [(0, y, x, 0.01 * x + 0.02 * y) for y in range(16) for x in range(16)]
    got = GD.demosaic_edge_aware(spark.createDataFrame(rows, "k int, y long, x long, v double"), ["k"]).collect()
    inner = [r for r in got if 5 <= r.y <= 10 and 5 <= r.x <= 10]
    assert len(got) == 256 and all(abs(c - (0.01 * r.x + 0.02 * r.y)) < 1e-9 for r in inner for c in (r.r, r.g, r.b))


def test_gap_free_plans(spark):
    from rigspark.operators.joins import gather

    g = B.grid(spark, "/root/testdata/sf0.001")
    warp = g.select("image_id", F.col("y").alias("dy"), F.col("x").alias("dx"), (F.col("x") + 0.5).alias("sx"), F.col("y").alias("sy"))
    plan = gather(g, warp, ["image_id"], 50, 64)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_color_model_is_recovered(spark):
    from rigspark.plans.calibration import CHART_D50

    truth = np.r_[0.04, 0.05, 0.03, 1.1, -0.05, -0.05, 0.02, 0.95, 0.03, -0.1, 0.0, 1.1]
    rgb = np.random.default_rng(3).uniform(0.1, 0.9, (len(CHART_D50), 3))
    lab = FT._lab(truth, rgb, "D50")
    rows = [(1, *map(float, a), *map(float, b)) for a, b in zip(rgb, lab)]
    [r] = FT.fit_color(spark.createDataFrame(rows, "cam int, r double, g double, b double, l0 double, a0 double, b0 double"), ["cam"], steps=8).collect()
    assert r.error < 0.3 and all(0 <= k <= 0.9 for k in r.params[:3])


def test_points_of_one_camera_stay_and_crowded_points_agree(spark, monkeypatch):
    truth = B.points(spark, "/root/testdata/sf0.001")
    obs = visible_observations(truth, B.rig(spark)).drop("x", "y", "z")
    start = truth.select("point_id", *((F.col(c) * 1.05 + 3).alias(c) for c in "xyz"))
    get = lambda df: {r.point_id: (r.x, r.y, r.z) for r in df.collect()}
    got, first = get(FT.triangulate(obs, ["point_id"], start)), get(start)
    times = {r.point_id: r["count"] for r in obs.groupBy("point_id").count().collect()}
    alone = [p for p, n in times.items() if n == 1]
    assert alone and all(got[p] == first[p] for p in alone)
    some = obs.where("point_id < 25")
    monkeypatch.setattr(FT, "MOST_SEEN", 1)
    monkeypatch.setattr(FT, "SEEN_AT_ONCE", 3)
    again = get(FT.triangulate(some, ["point_id"], start, 3))
    monkeypatch.setattr(FT, "MOST_SEEN", 1024)
    want = get(FT.triangulate(some, ["point_id"], start, 3))
    assert any(times[p] > 1 for p in again) and again.keys() == want.keys()
    assert all(np.allclose(again[p], want[p], atol=1e-4, rtol=1e-6) for p in want)


def test_homography_is_scored_on_many_matches_in_short_time(spark):
    rows = spark.range(100_000).select("id", (F.col("id") % 997).cast("double").alias("x0"), (F.col("id") % 1009).cast("double").alias("y0"))
    rows = rows.select("id", "x0", "y0", (F.col("x0") * 1.1 + 5 + F.when(F.col("id") % 4 == 0, 50 + F.col("id") % 89).otherwise(0)).alias("x1"), (F.col("y0") * 0.9).alias("y1"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, 1.0, 2.0, 3.0)], "id long, x0 double, y0 double, x1 double, y1 double"))
    began = time.time()
    ids = FT.ransac_inliers(rows, 1.0).select(F.count("id"), F.min(F.col("id") % 4)).first()
    assert time.time() - began < 30 and tuple(ids) == (75_000, 1)
