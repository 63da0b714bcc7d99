"""Streams over several batches and restarts: sets, histograms, the sharded sink, state of cameras."""

import datetime as dt
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.streaming import frames as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def packets(spark, tmp_path):
    """Set 0 of cameras 1 to 3 and set 1 without camera 3; packets of the days after; camera 3, too late."""
    def write(rows):
        spark.createDataFrame(rows, S.PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write([(s, c, T0 + dt.timedelta(seconds=c), "frame", s / 10) for s in (1, 2, 3) for c in (0, 1)] + [(s, 2, T0 + dt.timedelta(seconds=2), "frame", s / 10) for s in (1, 2)])
    write([(1, 90, T0 + dt.timedelta(days=1), "frame", 0.95)])
    write([(1, 91, T0 + dt.timedelta(days=2), "frame", 0.95)])
    write([(3, 2, T0 + dt.timedelta(seconds=2), "frame", 0.3)])
    return tmp_path


def run(writer, base):
    q = writer.option("checkpointLocation", str(base / f"log-{uuid.uuid4().hex}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_sets_report_what_is_missing(spark, packets):
    out = S.stream_sets(S.stream_frames(spark, str(packets / "in")), 2, n=3)
    run(out.writeStream.format("parquet").option("path", str(packets / "sets")).outputMode("append"), packets)
    got = {r.frame: (r.cameras, r.complete) for r in spark.read.parquet(str(packets / "sets")).collect()}
    assert got[0] == (3, True) and got[1] == (2, False)


def test_histogram_of_one_camera(spark, packets):
    run(S.stream_histogram(S.stream_frames(spark, str(packets / "in")), 1, str(packets / "hist"), 10, 0.0, 1.0), packets)
    got = spark.read.parquet(str(packets / "hist"))
    assert got.select("serial").distinct().count() == 1 and got.agg(F.sum("n")).first()[0] == 5


def test_sink_keeps_every_packet_once(spark, packets):
    run(S.write_footage_stream(S.stream_frames(spark, str(packets / "in")), str(packets / "out"), str(packets / "log"), 2), packets)
    got = spark.read.parquet(str(packets / "out"))
    assert got.count() == 11 and got.where("shard <> serial % 2").count() == 0


def test_state_goes_on_over_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    kinds = ["frame", "frame", "start", "stop"]
    rows = [(s, int(c), T0, kinds[rng.integers(4)], float(rng.random())) for s in range(5) for c in np.sort(rng.choice(200, 60, False))]
    builds = {"gaps": S.stream_gaps, "decimate": lambda d: S.stream_decimate(d, 7), "takes": lambda d: S.stream_takes(d, "start", "stop"), "blend": lambda d: S.stream_temporal_blend(d, 0.3, None)}
    for low, high in ((0, 50), (50, 90), (90, 140), (140, 200)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], S.PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if high in (90, 200):
            for name, build in builds.items():
                q = build(S.stream_frames(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-log"))
                assert q.trigger(availableNow=True).start().awaitTermination(240)
    got = {n: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / n)).collect()) for n in builds}
    want = {n: [] for n in builds}
    for s in range(5):
        last, value, take, on = None, None, 0, False
        for i, (_, c, _, kind, v) in enumerate([r for r in rows if r[0] == s]):
            if last is not None and c > last + 1:
                want["gaps"].append((s, c, last, c - last - 1))
            if i % 7 == 6:
                want["decimate"].append((s, c))
            take, on = (take + 1, True) if kind == "start" else (take, on and kind != "stop")
            if on:
                want["takes"].append((s, c, take))
            value = v if value is None else v * 0.3 + value * 0.7
            want["blend"].append((s, c, value))
            last = c
    assert got == {n: sorted(w) for n, w in want.items()} and all(want.values())


def test_silent_cameras_begin_anew(spark, tmp_path):
    def send(c, v):
        spark.createDataFrame([(1, c, T0, "frame", v)], S.PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()

    def run():
        q = S.stream_temporal_blend(S.stream_frames(spark, str(tmp_path / "in")), 0.5, ttl_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        assert q.trigger(availableNow=True).start().awaitTermination(120)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        ttl_ms = 40_000
        send(1, 8.0)
        send(2, 4.0)
        time.sleep(42)
        send(3, 2.0)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {r.counter: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 8.0, 2: 6.0, 3: 2.0}


def test_cameras_of_a_bucket_are_worked_on_together():
    import numpy as np
    import pandas as pd

    from rigspark.streaming.frames import _gaps

    rows = pd.DataFrame({"serial": [1, 1, 2, 2], "counter": [1, 4, 3, 4]})
    states, out = _gaps(rows, np.array([0, 2]), [None, (1,)])
    assert states == [(4,), (4,)] and out.to_numpy().tolist() == [[1, 4, 1, 2], [2, 3, 1, 1]]
