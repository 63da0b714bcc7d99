"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigspark.llm.common import small_batches, written

#: Pieces that are packed together in one task.
GROUP_PIECES = 4096


class WordTokens:
    """Token ids of texts, word by word: no token crosses a blank or a line feed, so the ids of a
    text are those of its words, and a word met before needs no second run of the tokenizer.

    ASCII letters are lower-cased first, as the tokenizer does, but in texts where a special token
    may stand; punctuation round a word is looked up apart from it, as no token joins a letter or
    digit with it.  Words not met before are tokenised many at a time, joined by a mark whose id
    parts them again; words that hold the mark, and long ones, go by themselves.  At most
    ``WORDS`` are remembered.
    """

    WORDS, LONGEST, MARK, AROUND, SPECIAL = 1_000_000, 64, b"~", b'.,;:!?#$%&*()"', b"<|"
    INNER = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encode([self.MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if self.mark is not None and self.MARK not in w]
        for first in range(0, len(plain), 512):
            run = plain[first : first + 512]
            [ids] = self._encode([(b" " + self.MARK + b" ").join(run)])
            at = np.flatnonzero(ids == self.mark)
            data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            if len(at) == len(run) - 1:
                self.known |= zip(run, (data[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)), strict=True)
        rest = [w for w in words if w not in self.known]
        self.known |= zip(rest, (ids.tobytes() for ids in self._encode(rest)), strict=True)

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        core = word.strip(self.AROUND)
        if core == word or not core or core[0] not in self.INNER or core[-1] not in self.INNER:
            return (word,)
        at = word.index(core)
        return word[:at], core, word[at + len(core) :]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian 32-bit numbers."""
        raw = [text.encode() for text in texts]
        words = [(t if self.SPECIAL in t else t.lower()).replace(b"\n", b" ").split(b" ") for t in raw]
        if len(self.known) > self.WORDS:
            self.known.clear()
        known = self.known
        new = set().union(*words).difference(known)
        long = {w for w in new if len(w) > self.LONGEST}
        parts = {w: self._parts(w) for w in new - long}
        self._learn([p for p in {p for ps in parts.values() for p in ps} if p not in known])
        known |= {w: known[a] + known[b] + known[c] for w, (a, b, c) in ((w, ps) for w, ps in parts.items() if len(ps) == 3)}
        if not long:
            return [b"".join(map(known.__getitem__, own)) for own in words]
        long = sorted(long)
        once = dict(zip(long, (ids.tobytes() for ids in self._encode(long)), strict=True))
        return [b"".join([once[w] if w in once else known[w] for w in own]) for own in words]


@cache
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def cuts(tokens: int, capacity: int, longest: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: full sequences, then equal parts of the rest."""
    full = tokens // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    start, rest = full * capacity, tokens % capacity
    parts = -(-rest // longest)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((start, length))
        start += length
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """Pieces of each document's tokens: ``row`` (a number of the document's row), ``doc_id``,
    ``start``, ``length``, ``ids`` (little-endian 32-bit) and ``doc_tokens``.

    A document is the ids of its whole text, null counting as empty, and ``end_id``.  Full
    sequences are cut off its front; what is left is cut into equal parts of at most ``longest``
    (a quarter of the capacity), so that pieces fit beside each other.
    """
    longest = longest or max(capacity // 4, 1)
    small_batches(docs.sparkSession, 256)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"row long, start long, length long, ids binary, doc_tokens long, doc_id {named.schema['doc_id'].dataType.simpleString()}"

    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, texts = batch.column("row"), batch.column("doc_id"), batch.column("text")
            at, out = [], []
            for i in range(0, len(batch), 32):
                for k, found in enumerate(_words(tokenizer)(texts[i : i + 32].to_pylist()), i):
                    ids, tokens = found + end, len(found) // 4 + 1
                    for start, length in cuts(tokens, capacity, longest):
                        at.append(k)
                        out.append((start, length, ids[4 * start : 4 * (start + length)], tokens))
            start, length, ids, tokens = zip(*out, strict=True) if out else ((), (), (), ())
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.take(taken), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), names.take(taken)], names=["row", "start", "length", "ids", "doc_tokens", "doc_id"])

    return named.mapInArrow(cut, schema)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by largest differencing: sums nearly equal.

    A partial partition is ``windows`` sums, of which those above zero are kept in falling order.
    The two with the widest spread are merged, the largest sums of one with the smallest of the
    other, until one is left.
    """
    n = len(sizes)
    pairs: list[np.ndarray] = []  # what each merged sum consists of
    known = n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        if len(a) < len(b):
            a, own, b, other = b, other, a, own
        both = len(a) + len(b) - windows
        if both > 0:
            met = a[-both:] + b[: -both - 1 : -1]
            pairs.append(np.stack([own[-both:], other[: -both - 1 : -1]], 1))
            sums = np.concatenate([a[:-both], met, b[:-both]])
            nodes = np.concatenate([own[:-both], np.arange(known, known + both), other[:-both]])
            known += both
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([own, other])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), count, sums, nodes))
        count += 1
    window = np.full(known, -1)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    joined = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    for k in range(known - n - 1, -1, -1):
        window[joined[k]] = window[n + k]
    return window[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, no window above ``capacity``: their count rises until all fit."""
    windows = max(-(-int(sizes.sum()) // capacity), 1)
    while True:
        window = difference(sizes, windows)
        over = int(np.bincount(window, sizes, windows).max(initial=0)) - capacity
        if over <= 0:
            return window
        # As many more as fit the same spread below the capacity.
        mean = sizes.sum() / windows
        room = mean - over if mean - over > capacity / 2 else mean
        windows = max(windows + 1, int(np.ceil(sizes.sum() / room)))


def packed(found: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to :func:`pieces` (a written table, of any further columns).

    Pieces are dealt by hash to groups of about ``GROUP_PIECES``; each group is packed by itself,
    from ids and lengths only, and loses less than a sequence or two to padding.  Full pieces are
    sequences of their own.
    """
    groups = max(-(-found.count() // GROUP_PIECES), 1)

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], ignore_index=True)
        length = frame["length"].to_numpy()
        full = length == capacity
        window = np.empty(len(frame), np.int64)
        window[~full] = windows_of(length[~full], capacity) if (~full).any() else 0
        window[full] = np.arange(full.sum()) + (window[~full].max() + 1 if (~full).any() else 0)
        frame["sequence_id"] = window * groups + frame["part"]
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - length
        return frame[["row", "start", "sequence_id", "offset"]]

    narrow = found.select("row", "start", "length", F.pmod(F.xxhash64("row", "start"), F.lit(groups)).alias("part"))
    placed = narrow.groupBy("part").applyInPandas(place, "row long, start long, sequence_id long, offset long")
    return found.join(placed, ["row", "start"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of token sequences: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every id of every document, null and empty texts included (they are ``end_id`` alone), lies in
    exactly one piece; a sequence's pieces follow each other without gap and sum to ``capacity``
    at most.  Rows with equal ids are documents of their own.  Texts of any length are tokenised
    whole, word by word.  Reruns agree for the same partitions of the input.  An
    empty table gives an empty result; further columns are not looked at.
    """
    return packed(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity).drop("row")


def sequences(packed_pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens``, ``ids`` (binary) and the ``starts`` of the pieces.

    A sequence is padded with ``pad_id`` to ``capacity`` unless its length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    missing = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing))
    return out.select("sequence_id", "n_tokens", F.concat(ids, pad).alias("ids"), F.col("parts.offset").alias("starts"))


def packing_report(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """:func:`pack_documents` with the CRC-32 of each piece's ids in their place."""
    found = pieces(docs, tokenizer, capacity, end_id).select("row", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packed(written(found), capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
