"""Queries on images that are higher than those of the given tables."""

import pytest
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark import registry
from rigspark.plans.panorama import pole_to_side

ROWS = 80


@pytest.fixture(scope="module")
def high(spark, tmp_path_factory):
    """Two images of 80 rows; one holds 1 from row 50 on, rising from there."""
    d = str(tmp_path_factory.mktemp("high"))
    value = F.when((F.col("vec_id") % ROWS >= 50) & (F.col("label") == 1), F.col("vec_id") % ROWS - 49).otherwise(0).cast("float")
    rows = spark.range(2 * ROWS).select(F.col("id").alias("vec_id"), F.floor(F.col("id") / ROWS).cast("int").alias("label"))
    rows.withColumn("embedding", F.array_repeat(value, 64)).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_cubemap_reaches_the_last_rows(spark, high):
    assert registry.queries()["h9_cubemap"](spark, high).agg(F.max("v")).first()[0] > (ROWS - 50) / 2 - 3


def test_pole_to_side_uses_the_images_rows(spark, high):
    g = B.grid(spark, high)
    side, pole = (g.groupBy("y", "x").agg(f("v").alias("v")) for f in (F.avg, F.max))
    flow = side.select("y", "x", F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"))
    cells = lambda df: {(r.y, r.x): round(r.v, 6) + 0.0 for r in df.collect()}
    want = cells(pole_to_side(side, pole, flow, ROWS, 64, 90.0, 40.0, 90.0))
    assert len(want) == ROWS * 64 and cells(registry.queries()["h7_pole_to_side"](spark, high)) == want
    assert want != cells(pole_to_side(side, pole, flow, 50, 64, 90.0, 40.0, 90.0))


def test_panorama_samples_each_image_and_flow_once(spark):
    from pyspark.sql import functions as F

    from rigspark.operators.joins import gather
    from rigspark.plans.panorama import stereo_panorama

    cells = spark.range(4 * 6 * 20).select((F.col("id") % 4).alias("pair"), F.floor(F.col("id") / 80).alias("y"), (F.floor(F.col("id") / 4) % 20).alias("x"), F.sin("id").alias("v"))
    flow = cells.select("pair", "y", "x", F.cos("x").alias("fx"), F.sin("y").alias("fy"))
    out = stereo_panorama(cells, cells, flow, flow, "pair", 6, 20, 4, 120.0, 120, "left")
    # One join for each side's flow and image, one of both sides, one for the places of the chunks.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    warp = cells.select("pair", F.col("y").alias("dy"), F.col("x").alias("dx"), (F.col("x") + 0.3).alias("sx"), F.col("y").cast("double").alias("sy"), F.col("v").alias("more"))
    both = gather(flow, warp, ["pair"], 6, 20, "bilinear", "replicate", values=["fx", "fy"], keep=["more"])
    one = [gather(flow.select("pair", "y", "x", F.col(c).alias("v")), warp, ["pair"], 6, 20, "bilinear", "replicate", c) for c in ("fx", "fy")]
    want = one[0].join(one[1], ["pair", "dy", "dx"]).join(warp.select("pair", "dy", "dx", "more"), ["pair", "dy", "dx"])
    assert both.count() == 480 and both.select(*want.columns).exceptAll(want).count() == 0
