"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import written

#: Links of a node on the upper layers; the bottom layer has twice as many.
LINKS = 16
#: Length of the candidate list while building and while searching.  At a full shard of random
#: vectors of 64 components the search then finds over 0.99 of the 20 nearest where their lengths
#: are equal and over 0.9 where they are not (README).
EF_BUILD, EF_SEARCH = 100, 384
#: Distinct vectors of a shard, and queries of one block; a block of queries is then at least as
#: large as the graph that is sent to it, so copies of graphs at most double what is shuffled.
SHARD_ROWS, QUERY_ROWS = 16_384, 32_768
#: How much the lengths in one graph may differ, vectors that it has at least, and candidates kept
#: at least where a shard has several graphs.
BAND, BAND_ROWS, LEAST_SEARCH = 1.1, 512, 96
#: Nodes inserted together, and queries walked together; nodes that a walk opens in one step.
INSERT_ROWS, WALK_ROWS, OPEN_NODES = 512, 128, 8


def _best(most: int, score: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The columns of the ``most`` largest scores of each row, in any order."""
    if score.shape[1] <= most:
        return [score, *more]
    at = np.argpartition(-score, most - 1, axis=1)[:, :most]
    return [np.take_along_axis(a, at, 1) for a in (score, *more)]


class Layers:
    """Layered graph over vectors of one length, each layer a flat array of neighbours (-1: none).

    Inner products are made comparable with distances by one more component that brings all
    vectors to the largest norm.  Nodes are inserted, and queries searched, many at a time: each
    step of the walk is one numpy operation over all of them.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 10) -> None:
        n = len(vectors)
        norm = np.einsum("ij,ij->i", vectors, vectors)
        more = np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]
        self.points = np.concatenate([vectors, more], 1).astype(np.float32)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log(1 - draw) / math.log(LINKS)).astype(np.int32)
        self.links = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(self.level.max()) + 1)]
        self.entry, done = 0, 1
        while done < n:
            size = min(INSERT_ROWS, max(1, done // 4), n - done)
            self._insert(np.arange(done, done + size, dtype=np.int32))
            done += size

    def _walk(self, q: np.ndarray, starts: np.ndarray, ef: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` most similar nodes that a best-first walk, ``OPEN_NODES`` at a time, finds for each row of ``q``, in any order."""
        rows = len(q)
        at_once = min(OPEN_NODES, ef)
        # Where a node was met, as a place among a step's neighbours from 1 on; a node met twice in a step counts once.
        seen = np.zeros((rows, len(self.points) + 1), np.int16)
        seen[:, -1] = 1  # the place of -1
        seen[np.arange(rows)[:, None], starts] = 1
        s = np.einsum("ad,amd->am", q, self.points[starts])
        s[starts < 0] = -np.inf
        s, i = _best(ef, s, starts)
        best, node = np.full((rows, ef), -np.inf, np.float32), np.full((rows, ef), -1, np.int32)
        best[:, : s.shape[1]], node[:, : s.shape[1]] = s, i
        open_, active = best > -np.inf, np.arange(rows)
        while True:
            active = active[open_[active].any(1)]
            if not len(active):
                return best, node
            s, at = _best(at_once, np.where(open_[active], best[active], -np.inf), np.broadcast_to(np.arange(ef), (len(active), ef)))
            open_[active[:, None], at] = False
            near = np.where(s[:, :, None] > -np.inf, links[node[active[:, None], at]], -1).reshape(len(active), -1)
            row, column = np.nonzero(seen[active[:, None], near] == 0)
            fresh = near[row, column]
            seen[active[row], fresh] = column + 1
            once = seen[active[row], fresh] == column + 1
            row, column, fresh = row[once], column[once], fresh[once]
            new = np.full(near.shape, -np.inf, np.float32)
            new[row, column] = np.einsum("ad,ad->a", self.points[fresh], q[active[row]])
            held = (np.concatenate(x, 1) for x in ((best[active], new), (node[active], near), (open_[active], new > -np.inf)))
            best[active], node[active], open_[active] = _best(ef, *held)

    def _select(self, s: np.ndarray, i: np.ndarray, most: int) -> np.ndarray:
        """Of each row, neighbours that are nearer to the node than to each other, filled up with the nearest."""
        order = np.argsort(-s, axis=1, kind="stable")
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        real, points = s > -np.inf, self.points[i]
        among = points @ points.transpose(0, 2, 1)
        nearest, kept, count = np.full(s.shape, -np.inf, np.float32), np.zeros(s.shape, bool), np.zeros(len(s), int)
        for c in range(s.shape[1]):
            kept[:, c] = real[:, c] & (s[:, c] > nearest[:, c]) & (count < most)
            count += kept[:, c]
            np.maximum(nearest, np.where(kept[:, c, None], among[:, :, c], -np.inf), out=nearest)
        order = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(real, order, 1), np.take_along_axis(i, order, 1), -1)

    def _insert(self, new: np.ndarray) -> None:
        """Link new nodes with what a walk finds and with the new ones before them."""
        q, own, top = self.points[new], self.level[new], int(self.level[self.entry])
        starts = np.full((len(new), EF_BUILD), -1, np.int32)
        starts[:, 0] = self.entry
        for k in range(max(top, int(own.max())), -1, -1):
            links, on = self.links[k], own >= k
            if k <= top and not on.all():
                starts[~on, 0] = self._walk(q[~on], starts[~on][:, :1], 1, links)[1][:, 0]
            if not on.any():
                continue
            mine, s, i = new[on], np.zeros((on.sum(), 0), np.float32), np.zeros((on.sum(), 0), np.int32)
            if k <= top:
                s, i = self._walk(q[on], starts[on], EF_BUILD, links)
                starts[on] = i
            mates = q[on] @ q[on].T
            mates[np.triu_indices(len(mine))] = -np.inf
            s, i = _best(EF_BUILD, np.concatenate([s, mates], 1), np.concatenate([i, np.broadcast_to(mine, mates.shape)], 1))
            chosen = self._select(s, i, LINKS)
            links[mine, : chosen.shape[1]] = chosen
            real = chosen >= 0
            self._link_back(links, chosen[real], np.broadcast_to(mine[:, None], chosen.shape)[real])
        if int(own.max()) > top:
            self.entry = int(new[own.argmax()])

    def _link_back(self, links: np.ndarray, nodes: np.ndarray, new: np.ndarray) -> None:
        """Add each of ``new`` to the links of its node; where they do not fit, select again."""
        if not len(nodes):
            return
        order = np.argsort(nodes, kind="stable")
        nodes, first, count = np.unique(nodes[order], return_index=True, return_counts=True)
        more = np.full((len(nodes), int(count.max())), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(new)) - np.repeat(first, count)] = new[order]
        both, width = np.concatenate([links[nodes], more], 1), links.shape[1]
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        held = (both >= 0).sum(1)
        links[nodes[held <= width]] = both[held <= width, :width]
        full = np.flatnonzero(held > width)
        full = full[np.argsort(held[full], kind="stable")]
        for at in range(0, len(full), WALK_ROWS):
            part = full[at : at + WALK_ROWS]
            i = both[part, : int(held[part].max())]
            s = np.einsum("ad,amd->am", self.points[nodes[part]], self.points[i])
            s[i < 0] = -np.inf
            links[nodes[part]] = self._select(s, i, width)

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """For each query the ``ef`` nodes that the walk finds, in any order (-1: none)."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        starts = np.full((len(q), 1), self.entry, np.int32)
        for k in range(int(self.level[self.entry]), 0, -1):
            starts = self._walk(q, starts, 1, self.links[k])[1]
        return self._walk(q, starts, ef, self.links[0])[1]

    def arrays(self) -> dict[str, np.ndarray]:
        """The flat form: upper layers hold the rows of their own nodes only."""
        out = {"points": self.points, "level": self.level, "entry": np.array(self.entry), "links0": self.links[0]}
        return out | {f"links{k}": x[self.level >= k] for k, x in enumerate(self.links) if k}

    @classmethod
    def of(cls, arrays) -> Layers:
        self = cls.__new__(cls)
        self.points, self.level, self.entry = arrays["points"], arrays["level"], int(arrays["entry"])
        self.links = [arrays["links0"]]
        for k in range(1, int(self.level.max()) + 1):
            full = np.full((len(self.points), LINKS), -1, np.int32)
            full[self.level >= k] = arrays[f"links{k}"]
            self.links.append(full)
        return self


class Graph:
    """A shard's graphs: one for each band of vectors whose lengths differ little.

    In one graph over all lengths the component that makes inner products comparable outweighs the
    others for short vectors, and these crowd together.  Bands hold lengths within ``BAND`` of
    each other, but ``BAND_ROWS`` vectors at least; vectors of one length are one band.  Every
    band is searched, a small one with a shorter list of candidates.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 10) -> None:
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        order = np.argsort(-norm, kind="stable")
        cuts, first = [0], 0
        while first < len(order):
            last = int(np.searchsorted(-norm[order], -norm[order[first]] / BAND, "right"))
            last = max(last, first + BAND_ROWS)
            first = len(order) if len(order) - last < BAND_ROWS else last
            cuts.append(first)
        # Within a band nodes keep the order that they came in.
        self.rows = [np.sort(order[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.bands = [Layers(vectors[rows], seed) for rows in self.rows]

    @property
    def links(self) -> list[np.ndarray]:
        return [links for band in self.bands for links in band.links]

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """For each query the nodes that the walks find, at least ``ef`` where there are as many, in any order (-1: none)."""
        out, total = [], sum(map(len, self.rows))
        for rows, band in zip(self.rows, self.bands, strict=True):
            width = min(max(int(ef * math.sqrt(len(rows) / total)), LEAST_SEARCH), ef, len(rows)) if len(self.rows) > 1 else min(ef, len(rows))
            found = band.search(queries, width)
            out.append(np.where(found >= 0, rows[found], -1))
        return np.concatenate(out, 1)

    def arrays(self) -> dict[str, np.ndarray]:
        """The flat form of all bands."""
        out = {}
        for i, (rows, band) in enumerate(zip(self.rows, self.bands, strict=True)):
            out |= {f"rows_{i}": rows} | {f"{name}_{i}": a for name, a in band.arrays().items()}
        return out

    @classmethod
    def of(cls, arrays) -> Graph:
        self = cls.__new__(cls)
        count = sum(k.startswith("rows_") for k in arrays)
        self.rows = [arrays[f"rows_{i}"] for i in range(count)]
        self.bands = [Layers.of({k.rsplit("_", 1)[0]: a for k, a in arrays.items() if k.endswith(f"_{i}")}) for i in range(count)]
        return self


def _distinct(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Vectors of a batch as bytes with the smallest ids of each: repeated ones before any shuffle."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
            held.setdefault(np.array(v, np.float64).tobytes(), []).append(i)
        ids = [sorted(set(x))[:most] for x in held.values()]
        yield pa.RecordBatch.from_pydict({"vec": pa.array(list(held), pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64()))})


def _build(rows: pa.Table, seed: int) -> pa.Table:
    rows = rows.sort_by("vec")  # the same graph again if the task is run again
    vectors = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.float64).reshape(len(rows), -1)
    # A seeded order, as the sorted one would link like with like first.
    order = np.random.default_rng(seed).permutation(len(rows))
    vectors, ids = vectors[order], [rows["ids"][int(i)].as_py() for i in order]
    file = io.BytesIO()
    np.savez(file, **Graph(vectors, seed).arrays(), vectors=vectors, ids=np.array([i for x in ids for i in x], np.int64), ends=np.cumsum([len(x) for x in ids]))
    return pa.table({"dim": pa.array([rows["dim"][0].as_py()], pa.int32()), "shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "graph": pa.array([file.getvalue()], pa.large_binary())}).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))


def search_width(k: int, shards: int) -> int:
    """Candidates kept in each of ``shards`` shards: one holds a share of the ``k`` nearest only."""
    return max(int(max(EF_SEARCH, 2 * k) / math.sqrt(shards)), LEAST_SEARCH, math.ceil(2 * k / shards))


def _search(queries: pa.Table, graphs: pa.Table, k: int, width: int) -> pa.Table:
    """The ``k`` best rows of one shard for each query of a block."""
    asked, tags, found_ids, found_scores = [], [], [], []
    if len(queries) and len(graphs):
        with np.load(io.BytesIO(graphs["graph"][0].as_py())) as arrays:
            arrays = dict(arrays)
        graph, ids, ends, vectors = Graph.of(arrays), arrays["ids"], arrays["ends"], arrays["vectors"]
        begins = np.r_[0, ends[:-1]]
        query_ids, query_tags = queries["query_id"].to_pylist(), queries["tag"].to_pylist()
        for at in range(0, len(queries), WALK_ROWS):
            q = np.frombuffer(b"".join(queries["vec"].slice(at, WALK_ROWS).to_pylist()), np.float64).reshape(-1, vectors.shape[1])
            nodes = graph.search(q, width)
            scores = np.where(nodes >= 0, np.einsum("amd,ad->am", vectors[nodes], q), -np.inf)
            # What is below the k + 1 best nodes cannot be among the k best rows other than the query's own.
            least = np.sort(scores, axis=1)[:, -min(k + 1, scores.shape[1])]
            for row, own in enumerate(query_ids[at : at + len(q)]):
                near = np.flatnonzero((scores[row] >= least[row]) & (nodes[row] >= 0))
                # The product of the two original vectors, the same whatever else is searched with it.
                exact = (vectors[nodes[row, near]] * q[row]).sum(1).tolist()
                best = heapq.nsmallest(k, [(-s, int(i)) for s, n in zip(exact, nodes[row, near], strict=True) for i in ids[begins[n] : ends[n]] if i != own])
                asked.append(own)
                tags.append(query_tags[at + row])
                found_ids.append([i for _, i in best])
                found_scores.append([-s for s, _ in best])
    columns = [pa.array(asked, pa.int64()), pa.array(tags, pa.int64()), pa.array(found_ids, pa.list_(pa.int64())), pa.array(found_scores, pa.list_(pa.float64()))]
    return pa.table(columns, ["query_id", "tag", "ids", "scores"])


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vec)`` of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 10) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Returns ``(query_id, rank, vec_id, score)``; ``score`` is the inner product of the original
    vectors in double precision, ties go to the smaller id, and a query's own id is no answer.
    Approximate: each shard's graph finds its best rows, and the shards' results are merged.

    Null and zero vectors, those that hold null or non-finite components, and rows without an id
    take no part.  Rows equal in id and vector count once; equal vectors are one node with the
    ``k + 1`` smallest ids, which is all that an answer can use.  Vectors of other lengths than
    the query's are not compared with it.  Without queries or vectors there are no rows.

    Every row is indexed.  Shards are cut by a hash of the vector and hold ``SHARD_ROWS`` distinct
    vectors on average; a graph is built once, stored as a row of flat arrays, and meets blocks of
    about ``QUERY_ROWS`` queries.  Only ids and scores of the ``k`` best of each shard go on.
    Columns of any other name are not looked at.
    """
    rows = _usable(vectors, id_col, vector_col).mapInArrow(lambda it: _distinct(it, k + 1), "vec binary, ids array<long>")
    lowest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    nodes = written(rows.groupBy("vec").agg(lowest.alias("ids")).withColumn("dim", F.octet_length("vec").cast("int")))
    shards = max(1, math.ceil(nodes.count() / SHARD_ROWS))
    width = search_width(k, shards)
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    graphs = written(nodes.groupBy("dim", "shard").applyInArrow(lambda rows: _build(rows, seed), "dim int, shard int, graph binary"))

    asked = _usable(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id").mapInArrow(_raw, "query_id long, vec binary")
    asked = written(asked.distinct().withColumn("dim", F.octet_length("vec").cast("int")))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    # The tag tells rows apart that share an id but not the vector.
    asked = asked.withColumn("tag", F.xxhash64("vec")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(lambda q, g: _search(q, g, k, width), "query_id long, tag long, ids array<long>, scores array<double>")
    hits = found.select("query_id", "tag", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("hit")).select("query_id", "tag", "hit.vec_id", "hit.score")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(v, np.float64).tobytes() for v in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id"), "vec": pa.array(raw, pa.binary())})


def neighbours_of_every_twentieth(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Neighbours of the rows whose id is divisible by 20 among all rows."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), k)
