"""Queries of composite jobs and of streams, on projections of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.catalog import query, r6, s6
from rigspark.scratch import written


def _parquet(df: DataFrame, path: str, log: str):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append")


def _streamed(spark: SparkSession, d: str, build, writer=_parquet) -> DataFrame:
    """Run a stream over the events, split by time into five files, and return what it wrote."""
    packets = written(B.stream(spark, d))
    base = spark.conf.get("spark.checkpoint.dir").rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    cuts = packets.agg(F.percentile("counter", [0.2, 0.4, 0.6, 0.8])).first()[0]
    low = None
    for high in [*cuts, None]:
        part = packets
        part = part.where(F.col("counter") > low) if low is not None else part
        part = part.where(F.col("counter") <= high) if high is not None else part
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        low = high
    from rigspark.streaming.frames import stream_frames

    # A state partition costs two files a batch: no more of them than the machine works on at once.
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        out = build(stream_frames(spark, f"{base}/in"))
        q = writer(out, f"{base}/out", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{base}/out")


@query("select serial, counter, previous, counter-previous-1 lost from (select user_id serial, event_id counter, lag(event_id) over (partition by user_id order by event_id) previous from events) where counter-previous>1")
def s2_stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.streaming.frames import stream_gaps

    return _streamed(spark, d, stream_gaps)


@query("select serial, counter from (select user_id serial, event_id counter, row_number() over (partition by user_id order by event_id) rn from events) where rn%5=0")
def s3_stream_decimate(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.streaming.frames import stream_decimate

    return _streamed(spark, d, lambda s: stream_decimate(s, 5))


@query("""select serial, counter, take from (select user_id serial, event_id counter, last_value(case when event_type='signup' then 1 when event_type='error' then 0 end ignore nulls) over w is_on,
 cast(sum(case when event_type='signup' then 1 else 0 end) over w as bigint) take from events window w as (partition by user_id order by event_id)) where is_on=1""")
def s5_stream_takes(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.streaming.frames import stream_takes

    return _streamed(spark, d, lambda s: stream_takes(s, "signup", "error"))


@query(f"""with f as (select user_id serial, event_id counter, value, row_number() over (partition by user_id order by event_id) n from events)
 select serial, counter, {s6('power(0.6, n) * sum(value * power(0.6, -n) * case when n = 1 then 1 else 0.4 end) over (partition by serial order by n rows unbounded preceding)', 5)} as value from f""")
def s8_stream_temporal_blend(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.streaming.frames import stream_temporal_blend

    return _streamed(spark, d, lambda s: stream_temporal_blend(s, 0.4, None)).select("serial", "counter", r6("value", 5).alias("value"))


@query("select user_id serial, event_id counter, user_id%4 shard from events")
def s9_footage_stream(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.streaming.frames import write_footage_stream

    return _streamed(spark, d, lambda s: s, lambda s, out, log: write_footage_stream(s, out, log, 4)).select("serial", "counter", F.col("shard").cast("long").alias("shard"))


_TONED = "power(floor(least(greatest({c},0),1)*4095)/4095, {g})"
_BEZ = "({a}*power(1-{t},3)+3*{b}*power(1-{t},2)*{t}+3*{c}*(1-{t})*power({t},2)+{d}*power({t},3))"


def _tone_sql(x: str, low: float, high: float, contrast: float) -> str:
    dark = _BEZ.format(a="0.0::double", b=f"{0.1666 + low!r}::double", c="0.3333::double", d="0.5::double", t=f"(2*{x})")
    bright = _BEZ.format(a="0.5::double", b="0.6666::double", c=f"{0.8333 + high!r}::double", d="1.0::double", t=f"(2*({x}-0.5))")
    slope = f"tan({contrast!r}::double*pi()/4)"
    return f"least(greatest({slope}*(case when {x}<=0.5 then {dark} else {bright} end)+0.5*(1-{slope}),0),1)"


_CCM = ((1.5, -0.3, -0.2), (-0.25, 1.4, -0.15), (0.05, -0.45, 1.4))


def _developed_sql() -> str:
    from rigspark.functions.scalars import color_matrix

    m = color_matrix([list(c) for c in zip(*_CCM, strict=True)], 1.2)
    linear = ", ".join(f"({row[0]!r}::double*r+{row[1]!r}::double*g+{row[2]!r}::double*b) {n}" for n, row in zip("rgb", m, strict=True))
    bins = ", ".join(f"{_TONED.format(c=n, g=f'{g}::double')} {n}" for n, g in zip("rgb", (0.9, 1.0, 1.1), strict=True))
    return f"select vec_id, {', '.join(s6(_tone_sql(n, 0.05, -0.04, 1.1), 2) + f' {n}' for n in 'rgb')} from (select vec_id, {bins} from (select vec_id, {linear} from ({B.TRIPLES_SQL})))"


@query(_developed_sql())
def h1_color_and_tone(spark: SparkSession, d: str) -> DataFrame:
    """Rounded to two digits: a bin of the table is 0.0002 wide."""
    from rigspark.plans.isp import color_and_tone

    lit = lambda *v: [F.lit(x) for x in v]
    out = color_and_tone(F.col("r"), F.col("g"), F.col("b"), lambda i, j: F.lit(_CCM[i][j]), F.lit(1.2), lit(0.9, 1.0, 1.1), lit(*[0.05] * 3), lit(*[-0.04] * 3), F.lit(1.1))
    return B.triples(spark, d).select("vec_id", *(r6(c, 2).alias(n) for n, c in zip("rgb", out, strict=True)))


@query()
def h2_to_spherical(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import to_spherical

    rig = B.rig(spark).withColumns({c: F.transform(c, lambda v: v / 32) for c in ("resolution", "principal", "focal")})
    images = B.grid(spark, d).join(F.broadcast(rig.select(F.col("ordinal").cast("long").alias("image_id"), "id")), "image_id").select("id", "y", "x", "v")
    rig = rig.join(F.broadcast(images.select("id").distinct()), "id", "left_semi")
    return to_spherical(images, rig, 40, 30, 1.2, 0.6, B.grid_size(images)).select("id", "y", "x", r6("v").alias("v"), r6("a").alias("a"))


@query()
def h5_stereo_panorama(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import stereo_panorama

    g = B.grid(spark, d).withColumnRenamed("image_id", "pair")
    flow = g.select("pair", "y", "x", F.lit(1.5).alias("fx"), F.lit(0.0).alias("fy"))
    rows, cols = B.grid_size(g)
    pairs = g.select("pair").distinct().count()
    out = stereo_panorama(g, g, flow, flow, "pair", rows, cols, pairs, 60.0, cols * 6, "left")
    return out.select("y", "x", r6("v").alias("v"))


@query()
def h7_pole_to_side(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import pole_to_side

    g = B.grid(spark, d)
    side, pole = (g.groupBy("y", "x").agg(f("v").alias("v")) for f in (F.avg, F.max))
    flow = side.select("y", "x", F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"))
    rows, cols = B.grid_size(side)
    return pole_to_side(side, pole, flow, rows, cols, 90.0, 40.0, 90.0).select("y", "x", r6("v").alias("v"))


@query()
def h11_detect_patches(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import detect_patches

    g = B.grid(spark, d).withColumn("v", F.col("v") + 0.5)
    return detect_patches(g, ["image_id"], 4, 400, 6, 9, 0.02)


@query()
def h14_calibrate_vignetting(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import calibrate_vignetting

    g = B.grid(spark, d)
    s = g.select("image_id", F.lit(0).alias("ch"), (F.col("x") / 64.0).alias("x"), (F.col("y") / 64.0).alias("y"), (0.8 - 0.2 * (F.col("x") / 64.0 - 0.5) ** 2 + 0.02 * F.col("v")).alias("v"))
    return calibrate_vignetting(s, ["image_id"]).select("image_id", "ch", F.transform("h", lambda c: F.round(c, 3)).alias("h"))


@query()
def h12_black_hole_level(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import black_hole_level

    return black_hole_level(B.grid(spark, d).withColumn("v", F.col("v") + 0.5), ["image_id"], share=0.05, least=2)


@query()
def h13_calibrate_color(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import calibrate_color

    e = B.table(spark, d, "embeddings")
    patch = (F.col("vec_id") % 24).cast("int").alias("patch")
    rows = e.groupBy(F.col("label").alias("serial"), patch).agg(*(F.avg(0.5 + F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("rgb")))
    return calibrate_color(rows, ["serial"]).select("serial", F.transform("white_balance", lambda v: F.round(v, 3)).alias("white_balance"))
