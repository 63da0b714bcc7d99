"""Streams of frame packets: gaps, decimation, sets, histograms, blends and the sharded sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PACKET_SCHEMA = "serial long, counter long, ts timestamp, kind string, value double"


def stream_frames(spark: SparkSession, path: str, schema: str = PACKET_SCHEMA, files_per_trigger: int = 1) -> DataFrame:
    """Packets from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: What keeps the state of a camera: typed state with a time to live needs this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets that the cameras' states are kept in, where none of them expires.
BUCKETS = 1024


class _OfCameras(StatefulProcessor):
    """Typed values of cameras, carried from batch to batch by ``step(rows, begin, values)``.

    ``rows`` are the batch's packets of some cameras, one camera after the other and each in the
    order of its counters, from ``begin`` on; ``values`` are None at first and after the time to
    live.  ``step`` gives the new values and the rows to put out.  The state of a bucket is an
    array of serials, and one for each field.
    """

    def __init__(self, step: Callable, state: str, ttl_ms: int | None) -> None:
        self.step, self.state, self.ttl_ms = step, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.iloc[np.lexsort((frame["counter"].to_numpy(), frame["serial"].to_numpy()))].reset_index(drop=True)
        serials, begin = np.unique(frame["serial"].to_numpy(), return_index=True)
        known = {}
        if self.value.exists():
            own, *fields = self.value.get()
            known = dict(zip(own, zip(*fields, strict=True), strict=True))
        serials = serials.tolist()
        values, out = self.step(frame, begin, [known.get(s) for s in serials])
        known.update(zip(serials, values, strict=True))
        self.value.update((list(known), *map(list, zip(*known.values(), strict=True))))
        yield out


def of_camera(df: DataFrame, step: Callable, out: str, state: str, ttl_ms: int | None = None) -> DataFrame:
    """Rows that ``step`` puts out for each camera; see :class:`_OfCameras`.

    A state not written for ``ttl_ms`` is dropped, in processing time; for this Spark runs batches
    without data on and on, so a run over what is there (``availableNow``) ends only with None, or
    with ``spark.sql.streaming.noDataMicroBatches.enabled`` off.  Then each camera has a state of
    its own, that expires by itself; without it cameras share :data:`BUCKETS` states, which are
    read and written once a batch.  Sets :data:`PROVIDER`.
    """
    df.sparkSession.conf.set(*PROVIDER)
    arrays = ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in ["serial long", *state.split(", ")]))
    of = F.pmod(F.xxhash64("serial"), F.lit(BUCKETS)) if ttl_ms is None else F.col("serial")
    return df.withColumn("__of", of).groupBy("__of").transformWithStateInPandas(_OfCameras(step, arrays, ttl_ms), out, "append", "None" if ttl_ms is None else "ProcessingTime")


def _times(rows: pd.DataFrame, begin: np.ndarray) -> np.ndarray:
    """How many rows each camera has."""
    return np.diff(np.r_[begin, len(rows)])


def _gaps(rows: pd.DataFrame, begin: np.ndarray, values: list[tuple | None]) -> tuple[list[tuple], pd.DataFrame]:
    """The state: the largest counter of a camera."""
    c = rows["counter"].to_numpy()
    before = np.r_[c[:1], c[:-1]]
    before[begin] = [v[0] if v else first for v, first in zip(values, c[begin].tolist(), strict=True)]
    # A camera's counters ascend, so the largest so far is the one before or that of the state.
    most = np.maximum(before, np.repeat(before[begin], _times(rows, begin)))
    at = c - most > 1
    last = np.maximum(c[np.r_[begin[1:], len(c)] - 1], before[begin])
    return [(v,) for v in last.tolist()], pd.DataFrame({"serial": rows["serial"].to_numpy()[at], "counter": c[at], "previous": most[at], "lost": (c - most - 1)[at]}).astype("int64")


def stream_gaps(df: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Lost frames of each camera.  Files must arrive in order per camera; within a batch rows are sorted.

    With ``ttl_ms`` a camera silent for that long begins anew, see :func:`of_camera`.
    """
    return of_camera(df, _gaps, "serial long, counter long, previous long, lost long", "last long", ttl_ms)


def stream_decimate(df: DataFrame, n: int) -> DataFrame:
    """Every n-th packet of each camera."""
    def step(rows: pd.DataFrame, begin: np.ndarray, values: list[tuple | None]) -> tuple[list[tuple], pd.DataFrame]:
        """The state: how many rows of a camera came so far."""
        seen, times = np.array([v[0] if v else 0 for v in values]), _times(rows, begin)
        place = np.arange(1, len(rows) + 1) + np.repeat(seen - begin, times)
        return [(v,) for v in (seen + times).tolist()], rows.loc[place % n == 0, ["serial", "counter"]]

    return of_camera(df, step, "serial long, counter long", "n long")


def stream_takes(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Packets between a packet of kind ``start`` and the next of kind ``stop``, with their ``take``.

    As ``segment_takes``: the start's packet belongs to its take, the stop's does not, and a start
    within a take begins another.
    """
    def step(rows: pd.DataFrame, begin: np.ndarray, values: list[tuple | None]) -> tuple[list[tuple], pd.DataFrame]:
        """The state: the number of the last take, and whether it is still on."""
        times = _times(rows, begin)
        of, end = np.repeat(np.arange(len(begin)), times), begin + times - 1
        take, on = (np.array(v) for v in zip(*(v or (0, False) for v in values), strict=True))
        starts = (rows["kind"] == start).to_numpy()
        total = np.cumsum(starts)
        takes = total + np.repeat(take - (total - starts)[begin], times)
        events = rows["kind"].map({start: 1.0, stop: 0.0}).groupby(of).ffill().to_numpy(float)
        is_on = np.where(np.isnan(events), on[of], events == 1)
        return list(zip(takes[end].tolist(), is_on[end].astype(bool).tolist(), strict=True)), rows[["serial", "counter"]].assign(take=takes.astype("int64"))[is_on.astype(bool)]

    return of_camera(df, step, "serial long, counter long, take long", "take long, is_on boolean")


def stream_sets(df: DataFrame, frames: int, delay: str = "10 minutes", window: str = "1 hour", n: int | None = None) -> DataFrame:
    """Cameras that arrived for each set of ``frames`` counters, once its window is closed.

    With ``n``, the number of cameras of the rig, sets that lack some come with ``complete`` false.
    """
    frame = F.floor(F.col("counter") / frames)
    out = df.withWatermark("ts", delay).groupBy(F.window("ts", window), frame.alias("frame")).agg(F.size(F.collect_set("serial")).alias("cameras"))
    return out if n is None else out.withColumn("complete", F.col("cameras") >= n)


def stream_histogram(df: DataFrame, serial: int, sink: str, bins: int, lo: float, hi: float):
    """A writer that appends, for each batch, the chosen camera's histogram below ``sink``."""
    from rigspark.operators.stats import histogram

    def write(batch: DataFrame, batch_id: int) -> None:
        histogram(batch.where(F.col("serial") == serial), ["serial"], "value", bins, lo, hi).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    return df.writeStream.foreachBatch(write)


def stream_temporal_blend(df: DataFrame, motion: float, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Each value drawn to the last blended one of its camera: ``value * motion + last * (1 - motion)``.

    A camera silent for ``ttl_ms`` begins anew, see :func:`of_camera`.
    """
    def step(rows: pd.DataFrame, begin: np.ndarray, values: list[tuple | None]) -> tuple[list[tuple], pd.DataFrame]:
        seen, out, states = rows["value"].tolist(), [], []
        for first, end, value in zip(begin.tolist(), [*begin[1:].tolist(), len(seen)], values, strict=True):
            last = value[0] if value else None
            for v in seen[first:end]:
                last = v if last is None else v * motion + last * (1 - motion)
                out.append(last)
            states.append((last,))
        return states, rows[["serial", "counter"]].assign(value=out)

    return of_camera(df, step, "serial long, counter long, value double", "v double", ttl_ms)


def write_footage_stream(df: DataFrame, path: str, checkpoint: str, shards: int, camera: str = "serial"):
    """A writer of packets as Parquet by shard, exactly once by the file sink's log."""
    rows = df.withColumn("shard", F.pmod(F.col(camera), F.lit(shards)))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("shard").outputMode("append")
