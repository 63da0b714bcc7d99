import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.functions import camera as C
from rigspark.plans import adjustment as A
from rigspark.plans.calibration import visible_observations


@pytest.fixture(scope="module")
def rig(spark):
    """The rig with a lens distortion for each group."""
    bent = F.when(F.col("grp") == "side camera", F.array(F.lit(0.05), F.lit(0.01))).otherwise(F.array(F.lit(-0.02), F.lit(0.004)))
    return B.rig(spark).withColumn("distortion", bent)


@pytest.fixture(scope="module")
def points(spark):
    """Four hundred seeded points, most of them some metres away."""
    rng = np.random.default_rng(8)
    at = rng.standard_normal((400, 3)) * rng.choice([150, 600, 3000], (400, 1))
    return spark.createDataFrame([(f"t{i:03d}", *map(float, p)) for i, p in enumerate(at)], "trace_id string, x double, y double, z double")


@pytest.fixture(scope="module")
def obs(rig, points):
    seen = visible_observations(points, rig).select("trace_id", "id", "px", "py")
    many = seen.groupBy("trace_id").count().where("count > 1")
    return A.written(seen.join(many, "trace_id", "left_semi"))


def perturbed(rig: A.Rig, rotation=0.0, principal=0.0, focal=0.0, distortion=0.0, position=0.0) -> A.Rig:
    rng = np.random.default_rng(2)
    columns, size = A.unknowns(rig, A.ALL, True)
    step = np.zeros(size)
    for name, scale in (("rotation", rotation), ("principal", principal), ("focal", focal), ("distortion", distortion), ("position", position)):
        at = np.unique(columns[name][columns[name] >= 0])
        step[at] = scale * rng.standard_normal(len(at))
    return A.moved(rig, columns, step)


def apart(a: A.Rig, b: A.Rig) -> dict[str, float]:
    return {c: float(np.abs(getattr(a, c) - getattr(b, c)).max()) for c in ("axes", "principal", "focal", "distortion", "origin")}


def test_pixels_and_slopes(spark, rig, points):
    cams = A.Rig.of(rig)
    rows = visible_observations(points, rig).select("ordinal", "x", "y", "z", "px", "py").toPandas()
    cam, world = rows["ordinal"].to_numpy(), rows[["x", "y", "z"]].to_numpy()
    assert np.abs(A.pixel(cams, cam, world) - rows[["px", "py"]]).to_numpy().max() < 1e-6
    back = A.rays(cams, cam, rows[["px", "py"]].to_numpy())
    away = world - cams.origin[cam]
    assert np.abs(back - away / np.linalg.norm(away, axis=1)[:, None]).max() < 1e-7
    by, columns, h = A.slopes(cams, cam, world), A.unknowns(cams, A.ALL, False), 1e-6
    columns, size = columns
    for name, own in columns.items():
        for i in range(own.shape[1]):
            step = np.zeros(size)
            step[own[:, i][own[:, i] >= 0]] = h
            change = (A.pixel(A.moved(cams, columns, step), cam, world) - A.pixel(A.moved(cams, columns, -step), cam, world)) / (2 * h)
            free = own[cam, i] >= 0
            assert np.allclose(change[free], by[name][free, :, i], rtol=1e-4, atol=1e-2), name
    for i in range(3):
        e = np.eye(3)[i] * 1e-3
        change = (A.pixel(cams, cam, world + e) - A.pixel(cams, cam, world - e)) / 2e-3
        assert np.allclose(change, by["world"][:, :, i], rtol=1e-4, atol=1e-5)


def test_sees_like_the_columns(spark, rig, points):
    cams = A.Rig.of(rig)
    rows = points.crossJoin(F.broadcast(rig)).select("ordinal", "x", "y", "z", C.sees(tuple(F.col(c) for c in "xyz")).alias("s")).toPandas()
    got = A.sees(cams, rows["ordinal"].to_numpy(), rows[["x", "y", "z"]].to_numpy())
    assert (got == rows["s"].fillna(False).to_numpy(bool)).all()


def test_points_are_settled_from_afar(spark, rig, points, obs):
    got = {r.trace_id: (r.x, r.y, r.z) for r in A.tracks(obs, A.Rig.of(rig), "trace_id").collect()}
    want = {r.trace_id: (r.x, r.y, r.z) for r in points.collect()}
    assert len(got) > 300 and max(np.linalg.norm(np.subtract(got[k], want[k])) for k in got) < 1e-2


def test_all_parameters_are_found_again(spark, rig, obs):
    truth = A.Rig.of(rig)
    start = perturbed(truth, 0.01, 3.0, 0.01, 0.01)
    first = A.bundle_adjust(obs, start.table(spark), free=A.FIRST_PASS)
    assert first.rmse[-1] < first.rmse[0]
    done = A.bundle_adjust(obs, first.cameras, free=tuple(p for p in A.ALL if p != "position"))
    gone = apart(A.Rig.of(done.cameras), truth)
    assert done.rmse == sorted(done.rmse, reverse=True) and done.rmse[-1] < 1e-3
    assert gone["axes"] < 1e-5 and gone["principal"] < 0.02 and gone["focal"] < 0.02 and gone["distortion"] < 1e-4 and gone["origin"] == 0


def test_positions_are_found_again(spark, rig, obs):
    truth = A.Rig.of(rig)
    start = perturbed(truth, 0.002, 0.5, 0.001, 0.001, 0.3)
    done = A.bundle_adjust(obs, start.table(spark), steps=40)
    got = A.Rig.of(done.cameras)
    assert done.rmse[-1] < 1e-3
    # The first camera's pose is locked, so only the scale of the whole is open.
    scale = np.linalg.norm(got.origin - got.origin[0]) / np.linalg.norm(truth.origin - truth.origin[0])
    assert np.abs((got.origin - got.origin[0]) / scale - (truth.origin - truth.origin[0])).max() < 0.01


def test_gross_errors_weigh_little(spark, rig, obs):
    truth = A.Rig.of(rig)
    noisy = obs.withColumn("px", F.col("px") + F.when(F.xxhash64("trace_id", "id") % 50 == 0, 40.0).otherwise(0.0))
    done = A.bundle_adjust(noisy, perturbed(truth, 0.005).table(spark), free=("rotation",))
    assert apart(A.Rig.of(done.cameras), truth)["axes"] < 5e-4


def test_blocks_of_points_and_split_traces_give_the_same_system(spark, rig, obs, monkeypatch):
    cams = A.Rig.of(rig)
    columns, size = A.unknowns(cams, A.ALL, True)
    rows = A.tracks(obs, cams, "trace_id")
    a, g = A.reduced_system(rows, cams, columns, size)
    monkeypatch.setattr(A, "BLOCK_NUMBERS", 1)
    monkeypatch.setattr(A, "MOST_SEEN", 3)
    b, h = A.reduced_system(rows, cams, columns, size)
    assert np.allclose(a, b, rtol=1e-9, atol=1e-6 * np.abs(a).max()) and np.allclose(g, h, atol=1e-6 * (1 + np.abs(g).max()))
    split = A.tracks(obs, cams, "trace_id")
    assert split.select(F.max(F.size("cam"))).first()[0] < 10 and split.select(F.sum(F.size("cam"))).first()[0] == obs.count()


def test_nothing_seen(spark, rig):
    none = spark.createDataFrame([], "trace_id string, id string, px double, py double")
    done = A.bundle_adjust(none, rig)
    assert done.rmse == [0.0] and done.points.count() == 0 and sorted(done.cameras.collect()) == sorted(rig.collect())
    with pytest.raises(ValueError):
        A.Rig.of(rig.crossJoin(spark.range(10)).drop("id").withColumn("id", F.lit("x")))


def matches_of(obs):
    """Keypoints and all pair matches of seen points, one in fifty of them wrong."""
    image = F.concat(F.lit("rgb/"), "id", F.lit("/0001.png"))
    number = F.substring("trace_id", 2, 9).cast("int")
    kp = obs.select(image.alias("image"), number.alias("kp_idx"), F.col("px").alias("x"), F.col("py").alias("y"))
    a = kp.select(F.col("image").alias("image0"), F.col("kp_idx").alias("idx0"))
    b = kp.select(F.col("image").alias("image1"), F.col("kp_idx").alias("idx1"))
    good = a.join(b, (F.col("idx0") == F.col("idx1")) & (F.col("image0") < F.col("image1")))
    wrong = F.xxhash64("image0", "image1", "idx0") % 50 == 0
    bad = good.where(wrong).join(kp.groupBy("image").agg(F.max("kp_idx").alias("other")), F.col("image1") == F.col("image")).withColumn("idx1", F.col("other")).drop("image", "other")
    return good.where(~wrong).unionByName(bad), kp


def test_calibration_from_matches_with_outliers(spark, rig, obs):
    truth = A.Rig.of(rig)
    matches, keypoints = matches_of(obs)
    start = perturbed(truth, 0.004, 1.0, 0.002, 0.002)
    done = A.calibrate_geometry(A.written(matches), A.written(keypoints), start.table(spark), passes=4)
    gone = apart(A.Rig.of(done.cameras), truth)
    errors = [p["rmse_after"] for p in done.passes]
    assert errors[-1] < 0.01 and errors[-1] <= errors[0] and all(p["rmse_after"] <= p["rmse_before"] for p in done.passes)
    assert done.passes[-1]["outliers"] > 0 and gone["axes"] < 1e-4 and gone["focal"] < 0.2 and gone["principal"] < 0.2
