"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigspark.llm.common import ALPHANUMERIC, mix, texts_of, word_hashes, written

#: Windows of one search, on average over the passes; a larger benchmark is searched in several
#: passes.  The tables take about 40 bytes a window, and three times that while they are built.
PASS_WINDOWS = 4_000_000
#: Windows of one row of the benchmark's table.
PIECE_WINDOWS = 4096
#: Words of a block of the shift table.
BLOCK = 2
#: Possible first words of the stretches of text that are searched side by side.
STRETCH = 512
#: Possible windows that are compared at a time.
LOOK = 1 << 15


class Places:
    """Places of values in a sorted array of distinct ones, -1 for others.

    A bit table, a few bytes a value, turns down most of what is not there before the binary search.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.right = np.uint64(64 - min(24, max(10, math.ceil(math.log2(8 * len(values))))))
        self.there = np.zeros(1 << (64 - int(self.right)), bool)
        self.there[self.slots(values)] = True

    def slots(self, values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.right).astype(np.int64)

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        some = np.flatnonzero(self.there[self.slots(values)])
        at = np.minimum(np.searchsorted(self.values, values[some]), len(self.values) - 1)
        out[some] = np.where(self.values[at] == values[some], at, -1)
        return out


class Searcher:
    """Wu-Manber over words: the windows of ``least`` words of pieces of text, given as word hashes.

    Words are numbered; a word that no piece has is 0.  The shift table tells for a block of two
    words how far the search may move on; where it may not, the bucket of the last two words of a
    window gives those to compare directly.  All tables are flat sorted arrays.
    """

    def __init__(self, pieces: list[tuple[int, np.ndarray]], least: int) -> None:
        self.least, self.block = least, min(BLOCK, least)
        sizes = np.array([len(h) for _, h in pieces])
        self.words, numbers = np.unique(np.concatenate([h for _, h in pieces]), return_inverse=True)
        self.base, self.flat = len(self.words) + 1, (numbers + 1).astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        # Of each block within a piece: how far it lies from the end of the first window that holds it.
        count = sizes - self.block + 1
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        keys = self.keys(self.flat)[np.repeat(begin, count) + at]
        reach = np.maximum(least - self.block - at, 0)
        order = np.lexsort((reach, keys))
        first = np.r_[True, np.diff(keys[order]) != 0]
        self.blocks, self.shift = keys[order][first], reach[order][first].astype(np.int32)
        # Distinct windows, dealt to buckets by their last block and sorted by their hash there.
        count = sizes - least + 1
        starts = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(np.array([o for o, _ in pieces], np.int32), count)
        last, own = self.keys(self.flat)[starts + least - self.block], self.window_hash(self.flat, starts)
        order = np.lexsort((owner, own, last))
        starts, owner, last, own = starts[order], owner[order], last[order], own[order]
        fresh = np.r_[True, (np.diff(last) != 0) | (own[1:] != own[:-1])]
        for at in range(1, len(starts), 1 << 16):  # equal hashes, unequal words
            part = np.arange(at, min(at + (1 << 16), len(starts)))
            part = part[~fresh[part]]
            fresh[part] = (self.at(self.flat, starts[part]) != self.at(self.flat, starts[part - 1])).any(1)
        self.starts, self.last, self.own = starts[fresh].astype(np.int32), last[fresh], own[fresh]
        self.owners, self.ends = owner, np.r_[np.flatnonzero(fresh)[1:], len(owner)]

    def keys(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.int64)
        return ids if self.block == 1 else ids[:-1] * self.base + ids[1:]

    def block_keys(self, blocks: np.ndarray) -> np.ndarray:
        """Keys of blocks given as rows of word numbers."""
        return blocks[:, 0] if self.block == 1 else blocks[:, 0] * self.base + blocks[:, 1]

    def at(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words of the windows that begin at ``starts``."""
        return ids[np.asarray(starts, np.int64)[:, None] + np.arange(self.least)]

    def window_hash(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(self.least):
            out = mix(out + ids[starts + k].astype(np.uint64) + np.uint64(1))
        return out

    @functools.cached_property
    def places(self) -> tuple[Places, Places]:
        """Places of the words and of the blocks, made where they are used."""
        return Places(self.words), Places(self.blocks)

    @functools.cached_property
    def buckets(self) -> tuple[Places, np.ndarray]:
        """Places of the windows' last blocks, and where the bucket of each begins and ends."""
        first = np.flatnonzero(np.r_[True, self.last[1:] != self.last[:-1]])
        return Places(self.last[first]), np.r_[first, len(self.last)]

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Text, first word and owners of every occurrence, for consecutive texts with these bounds."""
        begins = self.halts(hashes, bounds)
        for low in range(0, len(begins), LOOK):
            part = begins[low : low + LOOK]
            owner = np.searchsorted(bounds, part, "right") - 1
            for i, window in self.compare(hashes, part):
                yield int(owner[i]), int(part[i] - bounds[owner[i]]), self.owners[(self.ends[window - 1] if window else 0) : self.ends[window]]

    def halts(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the shift table does not let the search move on: first words of possible windows.

        Texts are cut into stretches of ``STRETCH`` possible first words.  All stretches advance
        together, each by its own shift; words that are jumped over are not looked up.
        """
        back, (words, blocks) = self.least - self.block, self.places
        room = np.maximum(np.diff(bounds) - self.least + 1, 0)
        count = -(-room // STRETCH)
        text = np.repeat(np.arange(len(room)), count)
        at = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
        end, out = np.minimum(at + STRETCH, bounds[:-1][text] + room[text]), [np.zeros(0, np.int64)]
        while len(at):
            ids = words.of(hashes[(at + back)[:, None] + np.arange(self.block)].ravel()).reshape(-1, self.block) + 1
            # A block with a word that no piece has is none of theirs.
            known = np.flatnonzero((ids > 0).all(1))
            place = blocks.of(self.block_keys(ids[known]))
            shift = np.full(len(at), back + 1)
            shift[known[place >= 0]] = self.shift[place[place >= 0]]
            out.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            at, end = at[at < end], end[at < end]
        return np.sort(np.concatenate(out))

    def compare(self, hashes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of the possible windows those that occur, with their places in the buckets.

        Within the bucket of the last block a hash leaves those that are then compared word by word.
        """
        buckets, edges = self.buckets
        ids = self.places[0].of(self.at(hashes, begins).ravel()).reshape(-1, self.least) + 1
        rows = np.flatnonzero((ids > 0).all(1))
        ids = ids[rows]
        own = self.window_hash(ids.ravel(), np.arange(len(rows)) * self.least)
        bucket = buckets.of(self.block_keys(ids[:, -self.block :]))
        low, high = edges[bucket], edges[bucket + 1]
        top = high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            open_, less = low < high, self.own[np.minimum(middle, len(self.own) - 1)] < own
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        while len(low):
            same = np.flatnonzero((low < top) & (self.own[np.minimum(low, len(self.own) - 1)] == own))
            rows, ids, own, low, top = rows[same], ids[same], own[same], low[same], top[same]
            equal = (self.at(self.flat, self.starts[low]) == ids).all(1)
            yield from zip(rows[equal].tolist(), low[equal].tolist(), strict=True)
            low = low + 1

def searchers(items: list[tuple[str, bytes]], window: int) -> tuple[list[Searcher], list[str]]:
    """One searcher for full windows and one for each length of shorter items; the items' names."""
    names = sorted({i for i, _ in items})
    number, by = {n: i for i, n in enumerate(names)}, {}
    for name, raw in items:
        hashes = np.frombuffer(raw, np.uint64)
        by.setdefault(min(len(hashes), window), []).append((number[name], hashes))
    # Each length of short item shifts by its own length, not by the shortest one.
    return [Searcher(by[n], n) for n in sorted(by)], names


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of the items, as hashes, cut into pieces that hold each window once."""
    for batch in batches:
        names, out = batch.column("item"), {"item": [], "words": [], "windows": []}
        for first, data, offsets in texts_of(batch.column("text")):
            hashes, bounds = word_hashes(data, offsets, ALPHANUMERIC)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                for at in range(a, max(b - window + 1, a + (b > a)), PIECE_WINDOWS):
                    piece = hashes[at : min(at + PIECE_WINDOWS + window - 1, b)]
                    out["item"].append(names[first + i].as_py())
                    out["words"].append(piece.tobytes())
                    out["windows"].append(max(len(piece) - window + 1, 1))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("words", pa.binary()), ("windows", pa.int64())]))


def _passes(benchmark: DataFrame, item_col: str, item_text: str, window: int) -> Iterator:
    """The tables of each pass, built once on the driver from its bounded share and broadcast."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    pieces = written(rows.mapInArrow(lambda it: _pieces(it, window), "item string, words binary, windows long").distinct())
    total = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / PASS_WINDOWS))
    for i in range(passes):
        held = pieces.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == i).select("item", "words").collect()
        yield i + 1 == passes, spark.sparkContext.broadcast(searchers([(r.item, bytes(r.words)) for r in held], window))


def _hits(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """Adds the words of each text, the hit words as runs, and the items that occur."""
    search, names = tables.value
    for batch in batches:
        counts, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        for first, data, offsets in texts_of(batch.column("text")):
            hashes, bounds = word_hashes(data, offsets, ALPHANUMERIC)
            counts.append(np.diff(bounds))
            marks: dict[int, np.ndarray] = {}
            owners: dict[int, set[int]] = {}
            for s in search:
                for text, begin, own in s.search(hashes, bounds):
                    if text not in marks:
                        marks[text], owners[text] = np.zeros(bounds[text + 1] - bounds[text] + 2, bool), set()
                        for x, y in zip(hits[first + text][::2], hits[first + text][1::2], strict=True):
                            marks[text][x + 1 : y + 1] = True
                    marks[text][begin + 1 : begin + s.least + 1] = True
                    owners[text].update(own.tolist())
            for text, hit in marks.items():
                hits[first + text] = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
                items[first + text] = sorted({names[i] for i in owners[text]}.union(items[first + text]))
        keep = {f.name: batch.column(f.name) for f in batch.schema if f.name not in ("hits", "items", "n_words")}
        yield pa.RecordBatch.from_pydict(keep | {"n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))})


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Where benchmark windows occur in each document.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.  A
    window is ``window`` consecutive words of an item; an item with fewer, but some, is one
    window.  Returns ``(doc_id, text, n_words, hits, items)``: ``hits`` holds begin and end of
    each run of words inside an occurrence, ``items`` the ids (as strings, sorted) of the items
    that have an occurring window.

    Null or wordless texts have no words and no hits; null or wordless items have no window and
    items without an id count under the empty string.  Rows repeat as they come in; repeated
    items merge.  Texts of any length are searched whole; empty tables give no rows or no hits;
    other columns are not looked at.  Words are compared by 64-bit hashes, windows word by word.

    The benchmark is dealt by hash into passes of ``PASS_WINDOWS`` windows on average, so that
    what the driver and a task hold is bounded.  A pass reads the documents that the one before
    wrote; with a single pass there is no writing, and there never is a shuffle.
    """
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for last, tables in _passes(benchmark, item_col, item_text, window):
        out = out.mapInArrow(lambda it, tables=tables: _hits(it, tables), schema)
        out = out if last else written(out)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts for each document: words, words hit, items that occur and their digest."""
    found = find_contamination(docs, benchmark, **options).drop("text")
    lengths = F.aggregate(F.expr("transform(hits, (x, i) -> if(i % 2 = 0, -x, x))"), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", lengths.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns, whatever their names.

    Rows are judged as in :func:`find_contamination`, each by itself.
    """
    # mapInArrow takes a dot in a name for a field's: columns go by their places.
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
        search, _ = tables.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for first, data, offsets in texts_of(batch.column(at)):
                hashes, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                for s in search:
                    for text, _, _ in s.search(hashes, bounds):
                        keep[first + text] = False
            yield batch.filter(pa.array(keep))

    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for last, tables in _passes(benchmark, item_col, item_text, window):
        docs = docs.mapInArrow(lambda it, tables=tables: clean(it, tables), docs.schema)
        docs = docs if last else written(docs)
    return docs.toDF(*names)
