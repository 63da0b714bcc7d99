import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.operators import bands as BD
from rigspark.plans import flow as FL
from rigspark.plans.panorama import pair_flow

SHIFT = (1.6, 4.4)  # down and right


def texture(y, x):
    """A smooth image that repeats nowhere near."""
    rng = np.random.default_rng(4)
    out = np.zeros(np.broadcast(y, x).shape)
    for _ in range(40):
        fy, fx, phase = rng.uniform(-0.35, 0.35), rng.uniform(-0.35, 0.35), rng.uniform(0, 6)
        out += np.sin(fy * y + fx * x + phase)
    return 0.5 + out / 40


def table(spark, images):
    rows = [(k, y, x, float(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "k int, y long, x long, v double")


@pytest.fixture(scope="module")
def pair(spark):
    y, x = np.mgrid[:90, :120].astype(float)
    small = np.mgrid[:40, :50].astype(float)
    a = {1: texture(y, x), 2: texture(*small)}
    b = {1: texture(y - SHIFT[0], x - SHIFT[1]), 2: texture(small[0], small[1] - 1)}
    return table(spark, a).cache(), table(spark, b).cache()


def far_off(field, full, shift):
    """Mean distance to the true displacement, in cells of the full image, edges left out."""
    f = {(r.y, r.x): (r.fx, r.fy) for r in field.collect()}
    h, w = max(y for y, _ in f) + 1, max(x for _, x in f) + 1
    scale = full / h
    inner = [(fx * scale - shift[1], fy * scale - shift[0]) for (y, x), (fx, fy) in f.items() if h * 0.15 <= y < h * 0.8 and w * 0.15 <= x < w * 0.8]
    return float(np.mean(np.hypot(*np.array(inner).T)))


def test_error_falls_from_level_to_level(spark, pair):
    rows = FL.image_lines(*pair, ["k"])
    levels = FL.field_levels(rows, ["k"], "right", 20.0)
    sizes = [f.where("k = 1").agg(F.max("h")).first()[0] for f in levels]
    assert sizes[-1] == 90 and sizes == sorted(sizes) and 24 < sizes[0] <= 28
    off = [far_off(BD.cells(f.where("k = 1"), ["k"], ["fx", "fy"]), 90, SHIFT) for f in levels]
    assert off[-1] < 0.25 and off[-1] < off[0] / 2 and off[-1] <= min(off) * 1.5
    # The small image has fewer levels and comes in later.
    assert [f.where("k = 2").count() > 0 for f in levels] == sorted(f.where("k = 2").count() > 0 for f in levels)


def test_known_shift_and_warp_error(spark, pair):
    field = FL.dense_flow(*pair, ["k"], "right", 20.0, scale=1.0).cache()
    assert sorted(field.groupBy("k").count().collect()) == sorted(pair[0].groupBy("k").count().collect())
    assert far_off(field.where("k = 1"), 90, SHIFT) < 0.25 and far_off(field.where("k = 2"), 40, (0, 1)) < 0.3
    for r in FL.warp_error(*pair, field, ["k"]).collect():
        assert r.rmse < r.rmse_still / 3
    half = FL.dense_flow(*pair, ["k"], "right", 20.0)
    assert far_off(half.where("k = 1"), 90, SHIFT) < 0.5


def test_bands_give_what_whole_images_give(spark, pair, monkeypatch):
    rows = FL.image_lines(*pair, ["k"])
    whole = FL.pyramid(rows, ["k"], ["v0", "v1", "a0", "a1"])
    monkeypatch.setattr(BD, "BAND_ROWS", 7)
    parts = FL.pyramid(rows, ["k"], ["v0", "v1", "a0", "a1"])
    get = lambda df: {(r.k, r.y): np.array(r.v0) for r in df.collect()}
    assert len(whole) == len(parts)
    for a, b in zip(whole, parts, strict=True):
        a, b = get(a), get(b)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    monkeypatch.setattr(BD, "BAND_ROWS", 33)
    field = FL.dense_flow(*pair, ["k"], "right", 20.0, scale=1.0)
    assert far_off(field.where("k = 1"), 90, SHIFT) < 0.25


def test_first_search_is_the_best_square():
    rng = np.random.default_rng(1)
    v0 = rng.random((30, 32))
    band = BD.Band(0, slice(0, 30), 30, {"v0": v0, "v1": np.roll(v0, (1, 3), (0, 1)) / 1.25, "a0": np.ones((30, 32)), "a1": np.ones((30, 32))})
    fx, fy = FL.first_match(band, 1.25, "right", 20.0)
    assert (fx[4:-5, 4:-8] == 3).all() and (fy[4:-5, 4:-8] == 1).all()
    assert FL.search_box("up", 20.0) == (5, [(a, c) for a in range(-5, 1) for c in range(-1, 2)])


def test_last_field_holds_where_nothing_moved(spark, pair):
    a, b = pair
    last = a.select("k", "y", "x", F.lit(7.0).alias("fx"), F.lit(-2.0).alias("fy"))
    still = FL.dense_flow(a, b, ["k"], "right", 20.0, 1.0, last, b)
    assert still.where((F.abs(F.col("fx") - 7) > 1e-6) | (F.abs(F.col("fy") + 2) > 1e-6)).count() == 0
    changed = FL.dense_flow(a, b, ["k"], "right", 20.0, 1.0, last, b.withColumn("v", F.col("v") - 1))
    assert far_off(changed.where("k = 1"), 90, SHIFT) < 0.25


def test_faint_cells_take_the_blur_and_opaque_ones_are_refined(spark, pair):
    a, b = pair
    hole = (F.col("y") < 20) & (F.col("x") < 20)
    alpha = lambda df: df.withColumn("a", F.when(hole, 0.0).otherwise(1.0))
    field = FL.dense_flow(alpha(a), alpha(b), ["k"], "right", 20.0, 1.0)
    assert far_off(field.where("k = 1 and not (y < 30 and x < 30)"), 90, SHIFT) < 0.4


def test_pairs_of_a_ring(spark):
    y, x = np.mgrid[:40, :48].astype(float)
    ring = table(spark, {i: texture(y, x - 2 * i) for i in range(3)}).withColumnRenamed("k", "cam")
    got = pair_flow(ring, "cam", scale=1.0)
    assert {r.pair_id for r in got.select("pair_id").distinct().collect()} == {0, 1, 2}
    assert far_off(got.where("pair_id = 0").drop("pair_id"), 40, (0, 2)) < 0.3
