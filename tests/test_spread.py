"""Work that is large beside its bytes is not put together in one task."""

from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.plans import adjustment as A
from rigspark.plans import calibration as C


def test_tracks_lie_in_many_files_and_hold_their_costs(spark):
    points = B.points(spark, "/root/testdata/sf0.001").limit(200)
    obs = C.visible_observations(points, B.rig(spark)).select("point_id", "id", F.col("px") + 0.25, "py").toDF("point_id", "id", "px", "py")
    rows = A.tracks(obs, A.Rig.of(B.rig(spark)), "point_id")
    assert len(rows.inputFiles()) > 2
    assert rows.where("abs(cost - robust) > 1e-9 or square < 0").count() == 0


def test_pairs_of_cameras_are_spread(spark):
    rigs = B.rig(spark).withColumn("rig", F.lit(1))
    out = C.overlap_fraction(rigs, 4, ["rig"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    one = {(r["first"], r["second"]): r.overlap for r in C.overlap_fraction(B.rig(spark), 4).collect()}
    assert {(r["first"], r["second"]): r.overlap for r in out.collect()} == one and len(one) == 17 * 16
