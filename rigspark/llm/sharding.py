"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import written

#: Rows that one range of a ranking should hold.
RANGE_ROWS = 8192
#: Rows of the tables of counts up to which they are broadcast (under 50 bytes a row).
BROADCAST_ROWS = 500_000


def _bounded(df: DataFrame) -> DataFrame:
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _offsets(rows: DataFrame, keys: list[str], place: str, count: str = "n") -> DataFrame:
    """Rows of each range and how many rows of the earlier ranges come before it."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.groupBy(*keys, place).agg(F.count(F.lit(1)).alias("__rows"))
    return _bounded(found.withColumn(count, F.coalesce(F.sum("__rows").over(w), F.lit(0))).drop("__rows"))


def interleave(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 4) -> DataFrame:
    """Adds ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 within the shard).

    Within each source rows are ranked by a seeded hash of id and text; all rows are then sorted
    by fractional rank, ``(rank + 1/2) / rows of the source``, and cut into shards whose row
    counts differ by one at most.  So every shard holds each source in the proportion of the
    whole.  A null source is a source of its own, null ids and texts hash as such, and rows equal
    in id and text take neighbouring ranks of their source in either order.  An empty table gives
    an empty result; columns named ``shard`` or ``slot`` are replaced, all others of any name stay
    as they are.

    Plan: each of the two rankings is a count over hash or rank ranges of about ``RANGE_ROWS``
    rows, running sums over these counts, and a row number within each range.  No task gets more
    than such a range for any key, however many rows a source has.
    """
    # The input's columns stand under numbers until the end, apart from the helpers' names.
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = docs.select(*(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(names)))
    id_col, text_col, source_col = (f"__in{names.index(c)}" for c in (id_col, text_col, source_col))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))
    rows = docs.withColumn("__key", key).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    total = docs.count()
    sources = _bounded(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__all")))
    unit = F.shiftrightunsigned("__hash", 11).cast("double") / F.lit(float(1 << 53))
    rows = rows.join(sources, "__key").withColumn("__range", F.floor(unit * F.ceil(F.col("__all") / RANGE_ROWS)))

    before = _offsets(rows.select("__key", "__range"), ["__key"], "__range", "__before")
    within = F.row_number().over(Window.partitionBy("__key", "__range").orderBy(unit, "__hash", id_col))
    ranked = rows.join(before, ["__key", "__range"]).withColumn("__rank", (F.col("__before") + within - 0.5) / F.col("__all"))
    ranked = ranked.withColumn("__part", F.floor(F.col("__rank") * F.ceil(F.lit(max(total, 1)) / RANGE_ROWS)))

    before = _offsets(ranked.select("__part"), [], "__part", "__earlier")
    within = F.row_number().over(Window.partitionBy("__part").orderBy("__rank", "__key", "__hash", id_col))
    place = F.col("__earlier") + within - 1
    out = ranked.join(before, "__part").withColumn("__place", place.cast("long"))
    n = max(total, 1)
    out = out.withColumn("shard", F.expr(f"__place * {shards}L div {n}L"))
    slot = F.col("__place") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return out.select(*(F.col(f"__in{i}").alias(c) for i, c in enumerate(names)), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 4) -> DataFrame:
    """Shard and slot of each document with its size in bytes plus 8 and its text's CRC-32.

    The law is ``rows``: the row counts of the shards differ by one at most, and every shard
    holds the sources in proportion, so equal texts, which the contract calls groups, are rows of
    their own and may lie in several shards: the laws bind sizes, counts or keys, not groups.  A null text has
    size 8 and the CRC-32 of no bytes, 0.  ``grown_shard`` is null under this law.
    """
    size: Column = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    # Only what decides the order is carried: a hash stands for the text.
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text_col).alias("text"))
    placed = interleave(written(narrow), shards, "doc_id", "text", "source", seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
