import numpy as np
from pyspark.sql import functions as F

from rigspark.functions import scalars as S
from rigspark.functions import sql
from rigspark.sources.footage import unpack_payload


def test_sql_functions_agree_with_columns(spark):
    names = sql.register(spark)
    assert set(names) >= {"rig_black_level", "rig_unpack_pixels"}
    spark.range(400).select((F.col("id") / 100 - 1).alias("v"), (F.col("id") - 200).alias("i"), (F.col("id") % 7).alias("y"), (F.col("id") % 5).alias("x")).createOrReplaceTempView("cells_")
    v, i = F.col("v"), F.col("i")
    pairs = {
        "rig_clamp(v, -0.5, 0.7)": S.clamp(v, -0.5, 0.7),
        "rig_ramp(v, 0.2, 0.9)": S.ramp(v, 0.2, 0.9),
        "rig_reflect(i, 150)": S.reflect(i, 150),
        "rig_wrap(i, 150)": S.wrap(i, 150),
        "rig_lerp(v, 3, 0.25)": S.lerp(v, 3.0, 0.25),
        "rig_widen8(cast(y as int))": S.widen8(F.col("y").cast("int")),
        "rig_black_level(v, 0.05)": S.black_level(v, 0.05),
        "rig_white_balance(v, 1.3)": S.white_balance(v, 1.3),
        "rig_clamp_stretch(v, 0.1, 0.8)": S.clamp_stretch(v, 0.1, 0.8),
        "rig_bezier(array(1.0, 0.5, 2.0, 0.7), v)": S.bezier([1.0, 0.5, 2.0, 0.7], v),
        "rig_bezier(array(0.4), v)": S.bezier([0.4], v),
        **{f"rig_bayer_channel(y, x, '{p}')": S.bayer_channel("y", "x", p) for p in S.BAYER},
    }
    rows = spark.table("cells_").select(*(F.struct(F.expr(q).cast("double").alias("a"), c.cast("double").alias("b")).alias(f"c{k}") for k, (q, c) in enumerate(pairs.items()))).collect()
    for k, q in enumerate(pairs):
        assert all(abs(r[k].a - r[k].b) < 1e-9 for r in rows), q


def test_pixels_unpacked_in_sql(spark):
    sql.register(spark)
    rng = np.random.default_rng(1)
    frames = [(1, bytes(rng.integers(0, 256, 12, np.uint8)), 8, 4, 3), (2, bytes(rng.integers(0, 256, 18, np.uint8)), 12, 4, 3), (3, None, 8, 4, 3)]
    spark.createDataFrame(frames, "f int, payload binary, bpp int, width int, height int").createOrReplaceTempView("frames_")
    got = spark.sql("select f, y, x, v from frames_, lateral rig_unpack_pixels(payload, bpp, width, height)").collect()
    want = {(f, k // w, k % w): int(v) for f, payload, bpp, w, h in frames if payload for k, v in enumerate(unpack_payload(payload, bpp)[: w * h])}
    assert {(r.f, r.y, r.x): r.v for r in got} == want and len(want) == 24
