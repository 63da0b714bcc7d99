"""WARC archives: written by Spark's text writer, read back with boundary-chain verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigspark.llm.common import scratch_dir, written

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_SHARED = 100
#: Shared payloads up to which their table is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 500_000


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record for each row below ``path``, several archives in parallel.

    The payload is the html in UTF-8 (null: empty).  Of the rows whose payloads are equal and
    have at least ``LEAST_SHARED`` bytes, those with the smallest id are ``response`` records and
    the others ``revisit`` records without payload that name it; all other rows are responses.
    A row without an id only revisits; where no row of a group has one, all are responses.
    Line ends in urls are percent-encoded, a null url is empty.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    shared = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("n > 1 and first is not null").drop("n"))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    rows = rows.join(shared, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn(F.col("id"))),
        _header("WARC-Target-URI", url),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(_header("WARC-Refers-To", urn(F.col("first"))), _header("X-Payload-Length", F.col("bytes").cast("string")))).otherwise(""),
        _header("Content-Length", F.when(F.col("revisit"), "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(F.col("revisit"), "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


_LINE = "file string, block long, seq long, rel long, length long, next_rel long, exit_rel long, whole boolean, piece binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _parse(raw: bytes, keep: bool) -> tuple[int, int, dict] | None:
    """Header length, content length and the record's columns from what follows the magic."""
    stop = raw.find(END)
    if stop < 0:
        return None
    head = dict(re.findall(rb"^([A-Za-z-]+): ?([^\r\n]*)\r?$", raw[: stop + 1], re.M))
    length = head.get(b"Content-Length", b"")
    stated, digest = head.get(b"X-Payload-Length", b"0"), head.get(b"WARC-Payload-Digest", b"")
    # A count beyond 18 digits is no size of anything.
    if not (re.fullmatch(rb"[0-9]{1,18}", length) and re.fullmatch(rb"[0-9]{1,18}", stated) and digest.isascii() and b"WARC-Type" in head):
        return None
    number = lambda v: int(m[1]) if v and (m := re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", v)) and -(1 << 63) <= int(m[1]) < 1 << 63 else None
    at, size = stop + len(END), int(length)
    body = raw[at : at + size]
    kind = head[b"WARC-Type"].decode("utf-8", "replace")
    out = {"page_id": number(head.get(b"WARC-Record-ID")), "url": head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), "record_type": kind, "refers_to": number(head.get(b"WARC-Refers-To"))}
    if kind == "revisit":
        out |= {"payload_bytes": int(stated), "payload_digest": digest.decode().removeprefix("sha256:"), "payload": None}
    else:
        out |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body if keep else None}
    return at, size, out


def _scan(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Candidate records of each split, with their successors relative to the split.

    What stands between two magics comes in file order.  ``next_rel`` is where the record that
    begins there says that the next one begins; ``exit_rel`` the first such place outside the
    candidates of the split, found by following the chain inside it from the end backwards.
    """
    place = [(c, pa.int64()) for c in ("block", "seq", "rel", "length", "next_rel", "exit_rel")]
    schema = pa.schema([("file", pa.string()), *place, ("whole", pa.bool_()), ("piece", pa.binary()), *list(_RECORD)[:7]])

    def ended(rows: list[dict]) -> pa.RecordBatch:
        exits: dict[int, int | None] = {}
        for r in reversed(rows):
            r["exit_rel"] = exits.get(r["next_rel"], r["next_rel"]) if r["next_rel"] is not None else None
            exits[r["rel"] - len(MAGIC)] = r["exit_rel"]
        return pa.RecordBatch.from_pylist(rows, schema)

    rows: list[dict] = []
    at = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("file", "block", "value")]
        for file, block, value in zip(*(c.to_pylist() for c in columns), strict=True):
            if rows and (rows[0]["file"], rows[0]["block"]) != (file, block):
                yield ended(rows)
                rows, at = [], 0
            raw = value or b""
            row = {"file": file, "block": block, "seq": len(rows), "rel": at, "length": len(raw), "next_rel": None, "whole": False, "piece": None}
            # What stands before a file's first magic is no record.
            found = _parse(raw, keep) if rows or block else None
            if found:
                head, size, columns_ = found
                row |= {"next_rel": at + head + size + len(END), "whole": len(raw) == head + size + len(END)}
            if found and row["whole"]:
                row |= columns_
            else:
                row["piece"] = raw
            rows.append(row)
            at += len(raw) + len(MAGIC)
    if rows:
        yield ended(rows)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands between the magics, numbered as in ``_scan``."""
    last, seq = None, 0
    for batch in batches:
        numbers = []
        for at in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            last, seq = at, seq + 1 if at == last else 0
            numbers.append(seq)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(numbers, pa.int64()), batch.column("value")], ["file", "block", "seq", "piece"])


def _follow(rows: pa.Table) -> pa.Table:
    """Mark the records of one split that are reachable from the record where the chain enters it."""
    rows = rows.sort_by("seq")
    due, owner, owners, real = rows["entry"][0].as_py(), None, [], []
    for start, nxt in zip(rows["start"].to_pylist(), rows["next"].to_pylist(), strict=True):
        real.append(due is not None and start == due)
        if real[-1]:
            owner, due = start, nxt
        owners.append(owner)
    return rows.drop_columns(["entry"]).append_column("real", pa.array(real)).append_column("owner", pa.array(owners, pa.int64()))


def _rebuild(rows: pa.Table, keep: bool) -> pa.Table:
    """A record whose payload holds the magic, put together from its pieces."""
    rows = rows.sort_by("start")
    raw = MAGIC.join(rows["piece"].to_pylist())
    found = _parse(raw, keep)
    whole = found is not None and len(raw) >= found[0] + found[1]
    return pa.Table.from_pylist([found[2] | {"file": rows["file"][0].as_py(), "offset": rows["owner"][0].as_py()}] if whole else [], _RECORD)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, verified by their boundary chains.

    Returns ``(file, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload)``; size and digest of a revisit are those it states.  Archives are read in splits by
    the magic, which may also stand inside payloads: each task emits every candidate with the
    offset of its successor, jumps to the end of its split at once, and pointer jumping over the
    splits, doubling the reach in each round, keeps what the start of the file leads to.
    Candidates inside payloads are not reached; their bytes go back to the record around them.

    An unreadable header (one without a type, with lengths that are no numbers or a digest beyond
    ASCII) ends the chain of its file; a page number that does not fit is null; a record cut off by the file's end is left
    out; a file that does not begin with the magic has no records.  No files, no rows.
    """
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    source = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = written(source.mapInArrow(lambda it: _scan(it, payload), f"{_LINE}, {_FIELDS}"))

    # Where each split's text begins in its file.
    splits = lines.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("base", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).drop("bytes"))
    lines = lines.join(splits, ["file", "block"]).withColumns({"start": F.col("base") + F.col("rel") - len(MAGIC), "next": F.col("base") + F.col("next_rel"), "exit": F.col("base") + F.col("exit_rel")})

    jump = written(lines.where("next is not null").select("file", "start", "exit"))
    reach = jump.where("start = 0").select("file", "start")
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        reach = written(reach.union(reach.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))).distinct())
        jump = written(jump.join(jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("far")), ["file", "exit"]).select("file", "start", F.col("far").alias("exit")))
    entries = reach.join(lines.select("file", "start", "block"), ["file", "start"]).select("file", "block", F.col("start").alias("entry"))

    names = ["file", "block", "seq", "start", "length", "next", "whole", "piece"] + [f.split()[0] for f in _FIELDS.split(", ")]
    schema = f"file string, block long, seq long, start long, length long, next long, whole boolean, piece binary, {_FIELDS}, real boolean, owner long"
    marked = lines.join(entries, ["file", "block"], "left").select(*names, "entry")
    marked = marked.groupBy("file", "block").applyInArrow(_follow, schema)
    plain = marked.where("real and whole").select("file", F.col("start").alias("offset"), *[f.split()[0] for f in _FIELDS.split(", ")])

    # Pieces that a split begins with belong to the last record of the splits before it.
    rest = marked.where("not (real and whole)").select("file", "block", "seq", "start", "piece", "owner")
    last = marked.where("real").groupBy("file", "block").agg(F.max("start").alias("last"))
    carried = splits.select("file", "block").join(last, ["file", "block"], "left").withColumn("carry", F.last("last", ignorenulls=True).over(earlier))
    rest = rest.join(carried.select("file", "block", "carry"), ["file", "block"]).withColumn("owner", F.coalesce("owner", "carry"))
    rest = written(rest.where("owner is not null").drop("carry"))
    # A payload may hold a whole record; the scan took it for one and kept no bytes of it.
    lost = rest.where("piece is null").drop("piece")
    if lost.limit(1).count():
        again = source.mapInArrow(_numbered, "file string, block long, seq long, piece binary")
        rest = rest.where("piece is not null").unionByName(lost.join(again, ["file", "block", "seq"]))
    broken = rest.select("file", "start", "piece", "owner").groupBy("file", "owner").applyInArrow(lambda rows: _rebuild(rows, payload), f"{_FIELDS}, file string, offset long")
    return plain.unionByName(broken.select(plain.columns))


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives, read these back and report each page's record."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark)
    write_warc(pages, path)
    return read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
