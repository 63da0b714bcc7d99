"""N-gram Jaccard join: linked documents by T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_names, mix, shingled, written
from rigspark.operators.graph import connected_components

#: Shingles of one block of the search; larger candidate groups are searched block by block.
BLOCK_SHINGLES = 1 << 18
#: Buckets of a set's histogram, and documents of one block of the comparison of histograms.
HISTOGRAM, BLOCK_DOCS = 512, 2048
#: From so many blocks of a size class on the blocks grow instead, up to this many documents each.
MOST_BLOCKS, LARGEST_BLOCK = 12, 16_384
#: Rows of a table that are broadcast at once to the texts (24 bytes a row); more go in ranges, at most so many.
BROADCAST_ROWS, MOST_RANGES = 1_000_000, 8
#: One set in so many is looked through for common shingles: those that this many of them hold, but not more than so many.
SAMPLED, COMMON_SETS, MOST_COMMON = 12, 8, 1 << 20
#: Signatures that a task remembers (a power of two; 17 bytes each).
RECENT = 1 << 18
#: Weight of the logarithm in DivideSkip's choice of how many long lists to set aside.
DIVIDE_MU = 0.0085
#: Ids that DivideSkip finds before it first looks whether they link; sets whose histograms a set is first compared with.
FIRST_IDS, FIRST_SETS = 4, 64


class Schemes:
    """Size intervals and, for each, the number of parts of the signature.

    A set of a size in interval r can only link with sizes in r-1, r and r+1, so a pair meets
    in the scheme of its larger interval.  Linked sets of that scheme differ in at most k
    elements; of k + 1 + e parts that hash the elements, at least 1 + e are then equal in both.
    A set with at most e empty parts has a non-empty equal part among them; only a set with more
    sends out its empty parts as well, so no linked pair is missed.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.high, self.parts = percent, [1, 2], {}

    def interval(self, n: int) -> int:
        """Index r with high[r-1] <= n < high[r]."""
        while self.high[-1] <= n:
            self.high.append((self.high[-1] - 1) * 100 // self.percent + 2)
        return int(np.searchsorted(self.high, n, side="right"))

    def shape(self, r: int) -> tuple[int, int]:
        """Parts and allowed empty parts of scheme r."""
        if r not in self.parts:
            self.interval(self.high[min(r, len(self.high) - 1)])
            while len(self.high) <= r:
                self.interval(self.high[-1])
            least = self.high[max(r - 2, 0)]
            k = 2 * (self.high[r] - 1) * (100 - self.percent) // (100 + self.percent)
            e = 0
            if k:
                while e < k + 4:
                    mean = (k + 1 + e) * (1 - 1 / (k + 1 + e)) ** least
                    if e >= mean + 2 * math.sqrt(mean) + 1:
                        break
                    e += 1
            self.parts[r] = (k + 1 + e, e)
        return self.parts[r]

    def signatures(self, tokens: np.ndarray, bounds: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Owner and signature of all sets, under each one's own scheme and, if reached, the next.

        Shingles of ``common`` (sorted) do not count: without them two sets differ in no more than
        before, so whatever they are as many parts stay equal.  Of a linked pair either one set
        has at most e empty parts, and a non-empty equal one, or both have more and send out
        the parts of their whole sets as well.
        """
        sizes, owners, out = np.diff(bounds), [], []
        own = np.array([self.interval(int(n)) if n else 0 for n in sizes])
        mixed = mix(tokens + np.uint64(0x632BE59BD9B4E019))
        folded, owner = mix(mixed), np.repeat(np.arange(len(sizes)), sizes)
        counts = np.ones(len(tokens), bool) if common is None or not len(common) else common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
        for step in (0, 1):
            scheme = own + step
            on = sizes > 0
            if step:
                on &= sizes * 100 >= np.array([self.high[r] for r in own]) * self.percent
            shapes = np.array([self.shape(int(r)) if use else (0, 0) for r, use in zip(scheme, on, strict=True)], np.int64).reshape(-1, 2)
            of, sig, held = self._parts(mixed, folded, owner, counts, scheme, shapes[:, 0])
            spare = shapes[:, 0] - np.bincount(of[held], minlength=len(sizes)) > shapes[:, 1]
            owners.append(of[held])
            out.append(sig[held])
            if spare.any():
                of, sig, _ = self._parts(mixed, folded, owner, spare[owner], scheme, np.where(spare, shapes[:, 0], 0))
                owners.append(of)
                out.append(sig)
        return np.concatenate(owners), np.concatenate(out)

    @staticmethod
    def _parts(mixed: np.ndarray, folded: np.ndarray, owner: np.ndarray, counts: np.ndarray, scheme: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and signature of each of a set's ``parts``, and whether it is not empty; of the shingles those that count."""
        base = np.r_[0, np.cumsum(parts)]
        mine = counts & (parts[owner] > 0)
        slot = base[owner[mine]] + (mixed[mine] % parts[owner[mine]].astype(np.uint64)).astype(np.int64)
        # Sums of 64-bit values modulo 2**64, in pieces that stay exact in double precision.
        total = np.zeros(base[-1], np.uint64)
        for shift in (0, 22, 44):
            part = (folded[mine] >> np.uint64(shift)) & np.uint64(0x3FFFFF)
            total += np.bincount(slot, part.astype(np.float64), base[-1]).astype(np.uint64) << np.uint64(shift)
        of = np.repeat(np.arange(len(parts)), parts)
        place = (np.arange(base[-1]) - base[of]).astype(np.uint64)
        sig = mix(total * np.uint64(0x9E3779B97F4A7C15) + mix(place * np.uint64(1_000_003) + scheme[of].astype(np.uint64)))
        return of, sig, np.bincount(slot, minlength=base[-1]) > 0


def _digests(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set, null for an empty one."""
    two = np.zeros((len(bounds) - 1, 2), np.uint64)
    for i, salt in enumerate((0x1234567, 0x89ABCDEF)):
        total = np.r_[np.uint64(0), np.cumsum(mix(tokens ^ np.uint64(salt)), dtype=np.uint64)]
        two[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    return [row.tobytes() if n else None for row, n in zip(two, np.diff(bounds), strict=True)]


def _profiles(batches: Iterator[pa.RecordBatch], width: int, text: bool) -> Iterator[pa.RecordBatch]:
    """Set size and set digest of each row's text, with or without the text."""
    for batch in batches:
        sizes, digests = [], []
        for _, tokens, bounds in shingled(batch, width):
            sizes.append(np.diff(bounds))
            digests += _digests(tokens, bounds)
        out = {"doc_id": batch.column("doc_id"), "n": pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), "digest": pa.array(digests, pa.binary())}
        yield pa.RecordBatch.from_pydict(out | ({"text": batch.column("text")} if text else {}))


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, tokens, _ in shingled(batch, width):
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(tokens.view(np.int64))})


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted shingles that many sets hold, as one set in ``SAMPLED`` shows; of too many the commonest.

    They chain documents that have no more than a passage in common.  Signatures lose no pair
    whichever shingles stand here, so a sample will do; it grows with the table, as else the
    chains would.
    """
    rows = texts.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).mapInArrow(lambda it: _shingle_rows(it, width), "shingle long")
    often = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= COMMON_SETS))
    if often.count() > MOST_COMMON:
        often = often.orderBy(F.desc("sets"), "shingle").limit(MOST_COMMON)
    return np.sort(often.select("shingle").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _signature_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int, common: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each signature of each text, but for those that the task has met lately.

    Where a signature repeats in a batch, or is still in a table of ``RECENT`` slots, the row
    links the two texts at once (``hub``, under any signature) and its own signature goes no
    further.  So one that a large part of all texts share leaves each task a few times only.
    """
    schemes, slots = Schemes(percent), np.uint64(RECENT - 1)
    held, holder, used = np.zeros(RECENT, np.uint64), np.zeros(RECENT, np.int64), np.zeros(RECENT, bool)
    for batch in batches:
        ids = np.asarray(batch.column("rep"))
        for first, tokens, bounds in shingled(batch, width):
            owner, sig = schemes.signatures(tokens, bounds, common)
            if not len(sig):
                continue
            rep = ids[first + owner]
            own, at, which = np.unique(sig, return_index=True, return_inverse=True)
            lead, slot = rep[at], (own & slots).astype(np.int64)
            met = used[slot] & (held[slot] == own)
            hubs = np.where(met, holder[slot], lead)
            links = np.concatenate([np.stack([rep, lead[which]]), np.stack([lead, hubs])], 1)
            links = np.unique(links[:, links[0] != links[1]], axis=1)
            held[slot[~met]], holder[slot[~met]], used[slot[~met]] = own[~met], lead[~met], True
            yield pa.RecordBatch.from_pydict({
                "rep": np.r_[lead[~met], links[0]],
                "sig": pa.array(np.r_[own[~met], mix(mix(links[0].view(np.uint64)) + links[1].view(np.uint64))].view(np.int64)),
                "hub": pa.array(np.r_[np.zeros((~met).sum(), np.int64), links[1]], mask=np.r_[np.ones((~met).sum(), bool), np.zeros(links.shape[1], bool)]),
            })


class Links:
    """Union-find over the documents of a block pair."""

    def __init__(self, n: int) -> None:
        self.label, self.left = np.arange(n), n

    def join(self, a: int, b: int) -> None:
        keep, gone = sorted((int(self.label[a]), int(self.label[b])))
        self.label[self.label == gone] = keep
        self.left -= 1


def t_occurrences(lists: list[np.ndarray], least: int, mu: float = DIVIDE_MU, offer: Callable[[np.ndarray, np.ndarray], np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur on at least ``least`` of the sorted lists, with their counts, by DivideSkip.

    The longest lists are set aside.  The short ones are merged with a heap: ids are popped
    until one occurs often enough, else the lists skip ahead by binary search to the next id
    that still can.  The ids that come out probe the long lists by binary search.

    With ``offer`` they do so in batches, each four times the one before, and are offered as they
    come out.  It answers with a mask of all ids that need no search any more, which leave the
    short lists, or with None.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = min(least - 1, int(least / (mu * math.log(max(len(lists[-1]), 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need, found, counts, out = least - aside, [], [], []
    # The long lists one after another, each in a lane of its own: one binary search probes them all.
    lanes, flat = np.arange(aside) * (max(int(x[-1]) for x in lists) + 1), None

    def probed() -> np.ndarray | None:
        """What the long lists leave of the ids found since the last time goes out; what its receiver answers."""
        nonlocal flat
        ids, times = np.array(found, np.int64), np.array(counts, np.int64)
        if aside and len(ids):
            if flat is None:
                flat = np.concatenate(long) + np.repeat(lanes, [len(x) for x in long])
            keys = lanes[:, None] + ids
            at = np.minimum(np.searchsorted(flat, keys.ravel()), len(flat) - 1).reshape(keys.shape)
            times = times + (flat[at] == keys).sum(0)
        ids, times = ids[times >= least], times[times >= least]
        out.append((ids, times))
        found.clear()
        counts.clear()
        return offer(ids, times) if offer and len(ids) else None

    heads, batch = [(int(x[0]), i, 0) for i, x in enumerate(short)], FIRST_IDS
    heapq.heapify(heads)
    while len(heads) >= need:
        top, popped = heads[0][0], []
        while heads and heads[0][0] == top:
            popped.append(heapq.heappop(heads))
        if len(popped) >= need:
            found.append(top)
            counts.append(len(popped))
            target = top + 1
        else:
            while heads and len(popped) < need - 1:
                popped.append(heapq.heappop(heads))
            if not heads:
                break
            target = max(heads[0][0], top + 1)
        for _, i, at in popped:
            x = short[i]
            if x[at] < target:  # a list popped only to skip may stand at the target or beyond it
                at = at + 1 if at + 1 < len(x) and x[at + 1] >= target else at + int(np.searchsorted(x[at:], target))
            if at < len(x):
                heapq.heappush(heads, (int(x[at]), i, at))
        if offer and len(found) >= batch:
            batch *= 4
            if (settled := probed()) is not None:
                for _, i, at in heads:
                    short[i] = short[i][at:][~settled[short[i][at:]]]
                heads = [(int(short[i][0]), i, 0) for _, i, _ in heads if len(short[i])]
                heapq.heapify(heads)
    probed()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links_of_block(sets: list[np.ndarray], sides: list[int], percent: int, apart: bool) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets, as index pairs (a spanning forest).

    With ``apart`` only pairs of different sides count.  A set probes the smaller ones; those
    already connected with it need no check, as a further link between them changes nothing.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, side = size[order], np.array(sides)[order]
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), size)
    _, local, times = np.unique(tokens, return_inverse=True, return_counts=True)
    by = np.argsort(local, kind="stable")
    postings, begin = owner[by], (np.cumsum(times) - times)[local]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    ends = np.r_[0, np.cumsum(size)]
    links, groups = [], Links(len(order))

    def linked(x: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
        before = groups.left
        for y in ids[(100 + percent) * counts >= percent * (size[x] + size[ids])]:
            if groups.label[x] != groups.label[y]:
                groups.join(x, int(y))
                links.append((int(order[x]), int(order[y])))
        return groups.label == groups.label[x] if groups.left < before else None

    for x in range(1, len(order)):
        if groups.left == 1:
            break
        low = int(np.searchsorted(size, -(-percent * size[x] // 100)))
        if low >= x:
            continue
        lists = []
        # Of each posting list what stands before x itself; x has no links yet.
        for a, b in zip(begin[ends[x] : ends[x + 1]].tolist(), place[ends[x] : ends[x + 1]].tolist(), strict=True):
            if a < b and postings[b - 1] >= low:
                p = postings[a:b]
                p = p if p[0] >= low else p[np.searchsorted(p, low) :]
                lists.append(p[side[p] != side[x]] if apart else p)
        t_occurrences(lists, -(-percent * int(size[x]) // 100), offer=lambda ids, counts, x=x: linked(x, ids, counts))
    return links


def _search(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links within each block pair; rows of a block pair follow one another."""
    def ended(rows: list) -> pd.DataFrame:
        apart = rows[0][1] != rows[0][2]
        at = links_of_block([np.frombuffer(r[5], np.uint64) for r in rows], [r[4] for r in rows], percent, apart)
        return pd.DataFrame({"src": [rows[a][3] for a, _ in at], "dst": [rows[b][3] for _, b in at]}, dtype="int64")

    held: list = []
    for frame in frames:
        for row in frame[["grp", "bi", "bj", "rep", "block", "tokens"]].itertuples(index=False):
            if held and held[0][:3] != row[:3]:
                yield ended(held)
                held = []
            if not any(r[3] == row[3] and r[5] == row[5] for r in held[-1:]):  # repeated rows
                held.append(tuple(row))
    if held:
        yield ended(held)


def histograms(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many tokens of each set fall into each bucket, a byte each; 255 stands for any more."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = owner * HISTOGRAM + (tokens >> np.uint64(55)).astype(np.int64)
    full = np.bincount(at, minlength=(len(bounds) - 1) * HISTOGRAM).reshape(-1, HISTOGRAM)
    # A set with a bucket beyond a byte could hold anything: its bound must never reject.
    full[(full > 254).any(1)] = 255
    return full.astype(np.uint8)


def _histogram_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, tokens, bounds in shingled(batch, width):
            rows = batch.slice(first, len(bounds) - 1)
            held = pa.array([h.tobytes() for h in histograms(tokens, bounds)], pa.binary())
            yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in ("rep", "grp", "cls", "n_subs", "sub", "below", "above")} | {"n": pa.array(np.diff(bounds), pa.int64()), "hist": held})


def possible_links(sizes: np.ndarray, hists: np.ndarray, sides: np.ndarray, percent: int, apart: bool) -> list[tuple[int, int]]:
    """Pairs, as a spanning forest, whose histograms leave room for the overlap of a link.

    Two sets have at most the sum of the smaller counts of each bucket in common, so a pair whose
    sum is too small is no link; nothing else is ruled out.
    """
    order = np.argsort(sizes, kind="stable")
    size, hist, side = sizes[order], hists[order], sides[order]
    pairs, groups = [], Links(len(order))
    for x in range(1, len(order)):
        if groups.left == 1:
            break
        low = int(np.searchsorted(size, -(-percent * size[x] // 100)))
        near = np.arange(low, x)
        near = near[groups.label[near] != groups.label[x]]
        if apart:
            near = near[side[near] != side[x]]
        step = FIRST_SETS
        while len(near):
            part, near, step = near[:step], near[step:], min(4 * step, 4096)
            most = np.minimum(hist[part], hist[x]).sum(1, dtype=np.int64)
            most = np.where(hist[part, 0] == 255, size[part], most)
            for y in part[(100 + percent) * most >= percent * (size[part] + size[x])]:
                if groups.label[x] != groups.label[y]:
                    groups.join(x, int(y))
                    pairs.append((int(order[x]), int(order[y])))
            near = near[groups.label[near] != groups.label[x]]
    return pairs


def _compare(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Possible links of each block pair; rows of a block pair follow one another."""
    def ended(rows: list) -> pd.DataFrame:
        apart = rows[0][1:3] != rows[0][3:5]
        sides = np.array([r[6:8] == rows[0][1:3] for r in rows])
        at = possible_links(np.array([r[8] for r in rows]), np.frombuffer(b"".join(r[9] for r in rows), np.uint8).reshape(-1, HISTOGRAM), sides, percent, apart)
        return pd.DataFrame({"rep": [rows[a][5] for a, _ in at], "hub": [rows[b][5] for _, b in at]}, dtype="int64")

    held: list = []
    for frame in frames:
        for row in frame[["grp", "ci", "si", "cj", "sj", "rep", "cls", "sub", "n", "hist"]].itertuples(index=False):
            if held and held[0][:5] != row[:5]:
                yield ended(held)
                held = []
            held.append(tuple(row))
    if held:
        yield ended(held)


def _refined(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate edges that are left when the histograms of the members are compared.

    A passage that many documents share can chain thousands of candidates; their histograms, a
    small part of the sets in size, tell most of them apart.  Sets are compared within a size
    class and with the next one, in blocks of ``BLOCK_DOCS``; in a large class the blocks grow, so
    that a histogram goes to a fixed number of block pairs up to ``MOST_BLOCKS * LARGEST_BLOCK``
    members of a class.
    """
    cls = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    members = members.withColumn("cls", cls)
    blocks = lambda size: F.ceil(F.count(F.lit(1)) / size)
    n_subs = F.greatest(F.least(blocks(BLOCK_DOCS), F.lit(MOST_BLOCKS)), blocks(LARGEST_BLOCK)).cast("int")
    counts = written(members.groupBy("grp", "cls").agg(n_subs.alias("n_subs")))
    near = lambda step, name: counts.select("grp", (F.col("cls") + step).alias("cls"), F.col("n_subs").alias(name))
    members = members.join(counts, ["grp", "cls"]).join(near(1, "below"), ["grp", "cls"], "left").join(near(-1, "above"), ["grp", "cls"], "left").fillna(0, ["below", "above"])
    members = members.withColumn("sub", F.pmod(F.xxhash64("rep"), "n_subs").cast("int")).drop("n").withColumnRenamed("rep", "member")
    rows = _beside(texts, F.col("rep"), members, "member", "inner").select("rep", "grp", "cls", "n_subs", "sub", "below", "above", "text")
    rows = rows.mapInArrow(lambda it: _histogram_rows(it, width), "rep long, grp long, cls int, n_subs int, sub int, below int, above int, n long, hist binary")
    pair = lambda ci, si, cj, sj: F.struct(ci.alias("ci"), si.alias("si"), cj.alias("cj"), sj.alias("sj"))
    c, s, upto = F.col("cls"), F.col("sub"), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto("n_subs"), lambda j: pair(c, F.least(s, j), c, F.greatest(s, j)))
    up = F.transform(upto("above"), lambda j: pair(c, s, c + 1, j))
    down = F.transform(upto("below"), lambda j: pair(c - 1, j, c, s))
    rows = rows.withColumn("p", F.explode(F.concat(own, up, down))).select("grp", "p.*", "rep", "cls", "sub", "n", "hist")
    keys = ["grp", "ci", "si", "cj", "sj"]
    return written(rows.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInPandas(lambda it: _compare(it, percent), "rep long, hub long").distinct())


def _token_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, tokens, bounds in shingled(batch, width):
            rows = batch.slice(first, len(bounds) - 1)
            held = pa.array([tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in ("rep", "grp", "block", "n_blocks")} | {"tokens": held})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Documents with the component of those that near-equal word n-gram sets link.

    A document's set holds its distinct ``width``-word shingles (the whole sequence if it has
    fewer words); two documents link when ``100 * |intersection| >= percent * |union|``.
    Returns ``(doc_id, n_shingles, component_id)``, one row for each input row, where
    ``component_id`` is the smallest id that links reach.  All links count, between all
    documents; those with equal sets are searched as one.

    Null, empty and wordless texts have an empty set and link with nothing, so they stand for
    themselves.  Rows that share an id are one document with the links of them all, and all get
    its component; each keeps its row and its own set size.  A row with a null id takes the
    component of documents with an equal set, else null.  Texts of any length are read whole; an
    empty table gives an empty result; other columns are not looked at.  Shingles are compared by
    64-bit hashes, sets by 128 bits.

    Plan: candidates meet by signatures (:class:`Schemes`) of what is left of the sets without
    :func:`common_shingles`; they are grouped into candidate
    components over (first, member) edges; within these, histograms of the sets rule out most
    pairs that cannot link (:func:`_refined`); only the sets of what is left are searched, in blocks of
    bounded size, by :func:`t_occurrences`; the links that connect them give the components.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    profile = written(base.mapInArrow(lambda it: _profiles(it, width, False), "doc_id long, n long, digest binary"))
    known = profile.where("digest is not null and doc_id is not null")
    texts, sizes, names, same_id = _one_of_each_set(base, profile, known, width)
    common = base.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    rows = texts.mapInArrow(lambda it: _signature_rows(it, width, percent, common.value), "rep long, sig long, hub long")

    first = F.min("rep").over(Window.partitionBy("sig"))
    edges = written(rows.withColumn("hub", F.coalesce("hub", first)).where("rep <> hub").select("rep", "hub").distinct())
    groups = connected_components(edges, "rep", "hub").withColumnRenamed("node", "rep").withColumnRenamed("component", "grp")
    edges = _refined(texts, groups.join(sizes, "rep"), width, percent)
    groups = connected_components(edges, "rep", "hub").withColumnRenamed("node", "rep").withColumnRenamed("component", "grp")
    members = groups.join(sizes, "rep")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    members = members.join(blocks, "grp").select(F.col("rep").alias("member"), "grp", F.pmod(F.xxhash64("rep"), "n_blocks").cast("int").alias("block"), "n_blocks")

    sets = _beside(texts, F.col("rep"), members, "member", "inner").select("rep", "grp", "block", "n_blocks", "text")
    sets = sets.mapInArrow(lambda it: _token_rows(it, width), "rep long, grp long, block int, n_blocks int, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    pairs = sets.withColumn("other", other).select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "block", "tokens")
    pairs = pairs.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "rep")
    links = pairs.mapInPandas(lambda it: _search(it, percent), "src long, dst long")
    found = connected_components(written(links if same_id is None else links.union(same_id)))

    if same_id is None:
        # Every name is the smallest id of its set, and components are called by names.
        own = profile.join(names, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
        linked = _small(found.where("node <> component"))
        return own.join(linked, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    # Some names are no ids: a component is called by the smallest id of its documents.
    labels = names.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    placed = written(profile.join(labels, "digest", "left"))
    lowest = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # A wordless row of an id goes with the id's other rows.
    of_id = placed.where("component is not null and doc_id is not null").groupBy("doc_id").agg(F.first("component").alias("other"))
    placed = placed.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("component", "other"))
    return placed.join(lowest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _one_of_each_set(base: DataFrame, profile: DataFrame, known: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """One text ``(rep, text)`` of each distinct set under the set's name, the sizes of the sets by
    name, the names by digest, and edges between the names that one id's rows have.

    A set is called by the smallest id that has one row only, whose text needs no further look.
    Where there is none, a hash of its digest is its name, and of its rows one is taken by digest.
    Without ids that repeat, which is the rule, there are no such names and no edges (None), and
    names are given only for sets of several documents; others are called by their own id.
    """
    repeated = written(profile.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    if not repeated.limit(1).count():
        several = profile.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
        several = _small(several.where("rows > 1 and rep is not null").drop("rows"))
        spare = known.join(several, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("spare"))
        texts = _beside(base.where("doc_id is not null"), F.col("doc_id"), spare, "spare", "left_anti").withColumnRenamed("doc_id", "rep")
        return texts, known.select(F.col("doc_id").alias("rep"), "n"), several, None
    marked = known.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left")
    names = marked.groupBy("digest").agg(F.min(F.when(F.col("again").isNull(), F.col("doc_id"))).alias("rep"), F.first("n").alias("n"))
    names = written(names.withColumn("known", F.col("rep").isNotNull()).withColumn("rep", F.coalesce("rep", F.xxhash64("digest"))))
    once = names.where("known").select("rep")
    single = _beside(base, F.col("doc_id"), once, "rep", "left_semi").withColumnRenamed("doc_id", "rep")
    more = _beside(base, F.col("doc_id"), repeated.withColumnRenamed("doc_id", "again"), "again", "left_semi").mapInArrow(lambda it: _profiles(it, width, True), "doc_id long, n long, digest binary, text string")
    more = more.where("digest is not null").join(names.where("not known").select("digest", "rep"), "digest").select("rep", "text").dropDuplicates(["rep"])
    texts = written(single.select("rep", "text").union(more))
    held = written(marked.where("again").join(names.select("digest", "rep"), "digest").select("doc_id", "rep").distinct())
    same_id = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst"))
    return texts, names.select("rep", "n"), names.select("digest", "rep"), same_id


def _small(df: DataFrame) -> DataFrame:
    """Write the rows out; broadcast them if their count is within the bound, else leave the join to Spark."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _beside(rows: DataFrame, key: Column, table: DataFrame, name: str, how: str) -> DataFrame:
    """Rows with a text joined to a table, whose column ``name`` holds each key once; the rows are not shuffled.

    Texts that are shuffled take twice their files' bytes.  So a table beyond the bound of a
    broadcast is cut into ranges of its keys; the rows of each range, which are read by
    themselves, meet that part of the table.
    """
    table = written(table)
    ranges = min(-(-table.count() // max(BROADCAST_ROWS, 1)), MOST_RANGES)
    if ranges < 2:
        return rows.join(F.broadcast(table), key == F.col(name), how)
    cuts = table.approxQuantile(name, [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    cuts = sorted({min(max(int(c), -(1 << 63)), (1 << 63) - 1) for c in cuts})
    # Rows without a key stand in the first range.
    within = [lambda c: c < cuts[0], *(lambda c, a=a, b=b: (c >= a) & (c < b) for a, b in pairwise(cuts)), lambda c: c >= cuts[-1]]
    mine = [key.isNull() | within[0](key), *(f(key) for f in within[1:])]
    parts = (rows.where(m).join(F.broadcast(table.where(f(F.col(name)))), key == F.col(name), how) for m, f in zip(mine, within, strict=True))
    return reduce(DataFrame.union, parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The input without near copies: of each linked group the rows with its smallest id stay.

    Rows with a null id and texts without words all stay; so do rows that repeat a kept id, and
    all columns of any name.
    """
    found = jaccard_components(docs, id_col, text_col, width, percent)
    name = fresh_names(docs, "gone")["gone"]
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return _beside(docs, F.col(f"`{id_col}`").cast("long"), gone, name, "left_anti")
