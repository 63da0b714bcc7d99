"""Operators on ordered rows of a key: gaps, decimation, ordinals, takes, blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_gaps(df: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Rows whose counter is not one above the key's last: with ``previous`` and ``lost`` frames."""
    w = Window.partitionBy(*keys).orderBy(counter)
    rows = df.withColumn("previous", F.lag(counter).over(w))
    return rows.where(F.col(counter) - F.col("previous") > 1).withColumn("lost", F.col(counter) - F.col("previous") - 1)


def decimate(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every n-th row of each key, beginning with the n-th."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") % n == 0).drop("__rn")


def assign_ordinals(df: DataFrame, key: str, by_text: bool = False) -> DataFrame:
    """``(key, ordinal)``: the place of each distinct key in order, of its text if asked."""
    order = F.col(key).cast("string") if by_text else F.col(key)
    keys = df.select(key).distinct()
    return keys.withColumn("ordinal", F.row_number().over(Window.orderBy(order)) - 1)


def segment_takes(df: DataFrame, keys: list[str], order: list[str], starts: Column, stops: Column) -> DataFrame:
    """Rows between a start and the next stop, with ``take`` counted from 1 in each key.

    The start's row belongs to its take, the stop's row does not; a start within a take begins
    another.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    event = F.when(starts, 1).when(stops, 0)
    rows = df.withColumn("__on", F.last(event, ignorenulls=True).over(w)).withColumn("take", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    return rows.where("__on = 1").drop("__on")


def route_shards(df: DataFrame, camera: str, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(camera), F.lit(n)))


def shard_counts(df: DataFrame, camera: str, n: int) -> DataFrame:
    """Cameras of each shard."""
    return route_shards(df, camera, n).groupBy("shard").agg(F.count_distinct(camera).alias("cameras"))


def assemble_sets(df: DataFrame, frame: Column, camera: str, n: int) -> DataFrame:
    """For each frame the cameras that arrived, and whether all ``n`` did."""
    return df.groupBy(frame.alias("frame")).agg(F.count_distinct(camera).alias("cameras")).withColumn("complete", F.col("cameras") >= n)


def temporal_blend(df: DataFrame, keys: list[str], frame: str, v: str, motion: Column) -> DataFrame:
    """The field drawn to that of the frame before, the more the less moved; the first stays."""
    from rigspark.operators.joins import with_previous

    rows = with_previous(df, keys, frame, [v])
    w = 1 - motion
    return rows.withColumn(v, F.when(F.col(f"prev_{v}").isNull(), F.col(v)).otherwise(F.col(v) * (1 - w) + F.col(f"prev_{v}") * w)).drop(f"prev_{v}")


def frame_range(headers: DataFrame, first: str, last: str, start: int, count: int) -> DataFrame:
    """Frames asked for within what is there; a start past the end is an error.

    ``count`` 0 asks for all from ``start`` on.
    """
    there = F.col(last) - F.col(first) + 1
    begin = F.when(F.lit(start) >= there, F.raise_error(F.lit("start frame is past the end"))).otherwise(F.col(first) + start)
    end = F.when(F.lit(count) > 0, F.least(F.col(first) + start + count - 1, F.col(last))).otherwise(F.col(last))
    return headers.withColumn("begin", begin.cast("long")).withColumn("end", end.cast("long"))


def line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to the line through a and b; where these are one point, to that point."""
    cross = (bx - ax) * (ay - py) - (ax - px) * (by - ay)
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    away = F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
    return F.coalesce(F.abs(cross) / F.nullif(length, F.lit(0.0)), away)


def raster_order(points: DataFrame, keys: list[str], k: int, x: str = "x", y: str = "y") -> DataFrame:
    """Scattered grid points in reading order, rows of ``k``: adds ``row`` and ``place``.

    The top edge runs through the points nearest to the upper left and the upper right corner.
    """
    corner = points.groupBy(*keys).agg(F.min_by(F.struct(x, y), F.struct(F.col(x) + F.col(y), F.col(x))).alias("__a"), F.max_by(F.struct(x, y), F.struct(F.col(x) - F.col(y), F.col(x))).alias("__b"))
    rows = points.join(corner, keys)
    d = line_distance(F.col(x), F.col(y), F.col(f"__a.{x}"), F.col(f"__a.{y}"), F.col(f"__b.{x}"), F.col(f"__b.{y}"))
    by = Window.partitionBy(*keys).orderBy("__d", x, y)
    rows = rows.withColumn("__d", F.round(d, 9)).withColumn("row", F.floor((F.row_number().over(by) - 1) / k))
    place = F.row_number().over(Window.partitionBy(*keys, "row").orderBy(x, y)) - 1
    return rows.withColumn("place", F.col("row") * k + place).drop("__a", "__b", "__d")
