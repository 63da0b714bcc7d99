"""What the corpus operators share: scratch tables, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark.scratch import scratch_dir, written  # noqa: F401  (shared with the other operators)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows to Python in batches of ``rows``: with long texts this bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh_names(df: DataFrame, *names: str) -> dict[str, str]:
    """A name for each helper column that no column of ``df`` has, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return {n: mark + n for n in names}


def fresh_prefix(df: DataFrame) -> str:
    """A prefix for helper columns that no column of ``df`` begins with, in any case."""
    mark = "__"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def word_count(text: Column | str) -> Column:
    """Number of words of the plain rule; null counts as no text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordRule:
    """Which bytes separate words, and a 64-bit value for each byte with A-Z lower-cased."""

    def __init__(self, separators: bytes) -> None:
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
        self.value[65:91] = self.value[97:123]


#: Words are runs of anything but white space.
PLAIN = WordRule(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALPHANUMERIC = WordRule(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))

_PIECE = 1 << 20
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _hash_piece(data: np.ndarray, first: np.ndarray, rule: WordRule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of one piece; ``first``: where a text begins in it."""
    global _powers, _inverse
    n = len(data)
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n + _PIECE, _ODD)], dtype=np.uint64)
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(n + _PIECE, np.uint64(pow(int(_ODD), -1, 1 << 64)))], dtype=np.uint64)
    word = ~rule.apart[data]
    edge = np.zeros(n + 1, bool)
    edge[first[(first >= 0) & (first < n)]] = True
    before = np.r_[False, word[:-1]]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(rule.value[data] * _powers[:n], out=total[1:])
    return mix((total[end] - total[start]) * _inverse[start]), start


def word_hashes(data: np.ndarray, offsets: np.ndarray, rule: WordRule = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and the bounds of each text among them.

    ``data``: the UTF-8 bytes; text i lies at ``offsets[i]:offsets[i + 1]``.  A polynomial hash
    over prefix sums needs no step for each word; long texts go piece by piece, cut between words.
    """
    hashes, places, at, stop = [], [], int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = min(at + _PIECE, stop)
        if to < stop and (cut := np.flatnonzero(rule.apart[data[at:to]])).size:
            to = at + int(cut[-1]) + 1
        elif to < stop:  # one word, or texts without a separator
            later = offsets[(offsets > at) & (offsets <= stop)]
            far = np.flatnonzero(rule.apart[data[to:stop]])
            to = min(int(later[0]), to + int(far[0]) + 1 if far.size else stop)
        h, start = _hash_piece(data[at:to], offsets - at, rule)
        hashes.append(h)
        places.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts of about 1 MB: first row, bytes, offsets.  Null is no text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, place, data = column.buffers()
    offsets = np.frombuffer(place, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        null = np.asarray(column.is_null())
        if (np.diff(offsets)[null] > 0).any():
            yield from texts_of(pa.array(["" if v is None else v for v in column.to_pylist()], pa.large_string()))
            return
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE)))
        last = min(last, len(column))
        yield first, data, offsets[first : last + 1]
        first = last


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and the bounds of each text among them.

    A shingle is the hash of ``width`` consecutive words; a text with fewer words is one shingle,
    a text without words has none.
    """
    n, count = len(hashes), np.diff(bounds)
    text = np.repeat(np.arange(len(count)), count)
    out = np.full(max(n - width + 1, 0), np.uint64(width), np.uint64)
    for i in range(width):
        out = mix(out * _ODD + hashes[i : n - width + 1 + i]) if len(out) else out
    whole = text[: len(out)] == text[n - len(out) :] if len(out) else np.zeros(0, bool)
    out, owner = out[whole], text[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        one = []
        for t in short:
            h = np.uint64(count[t])
            for x in hashes[bounds[t] : bounds[t + 1]]:
                h = mix(np.array([h]) * _ODD + x)[0]
            one.append(h)
        out, owner = np.r_[out, np.array(one, np.uint64)], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])] if len(out) else np.zeros(0, bool)
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(count) + 1))


def shingled(batch: pa.RecordBatch, width: int, text: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, shingles and bounds for each run of texts of a batch."""
    for first, data, offsets in texts_of(batch.column(batch.schema.get_field_index(text))):
        yield first, *shingle_sets(*word_hashes(data, offsets), width)
