"""Connected components and match-graph operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigspark.scratch import small, written

#: Nodes up to which the table of minima is broadcast (about 16 bytes a node); edges that cannot have more are contracted by one task.
BROADCAST_NODES = 500_000
#: Edges that a task contracts at a time.
CHUNK_EDGES = 1_000_000
#: Images of a match graph up to which numbers stand for their keypoints.
MOST_IMAGES = 20_000
#: Times that the edges around each node are contracted together before the steps on single nodes begin.
AROUND_ROUNDS = 4
#: Rows of one node from which on its minimum is broadcast instead of its rows being shuffled to one task.
HEAVY_ROWS = 100_000


def roots(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the smallest one that edges from ``u`` to smaller nodes ``v`` link it to."""
    low = np.arange(count)
    while len(u):
        # The root of each edge's larger end goes below the smaller end's; then every node to its root.
        np.minimum.at(low, u, v)
        while (low[low] != low).any():
            low = low[low]
        ends = low[u], low[v]
        u, v = np.maximum(*ends), np.minimum(*ends)
        u, v = u[u != v], v[u != v]
    return low


def _rooted(parts: list[pa.Table]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of the edges, their order, and in that order the place of the smallest one that each is linked to."""
    edges = pa.concat_tables(parts)
    both = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks], edges["u"].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()].reshape(2, -1)
    return both.dictionary, order, roots(len(order), ends.max(0), ends.min(0))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every ``CHUNK_EDGES`` edges of a task, each node with the smallest one that they link it to."""

    def stars(parts: list[pa.Table]) -> pa.RecordBatch:
        nodes, order, low = _rooted(parts)
        own = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(order[n])) for n in (own, low[own])], ["u", "v"])

    parts, size = [], 0
    for batch in batches:
        parts.append(pa.Table.from_batches([batch]))
        size += len(batch)
        if size >= CHUNK_EDGES:
            yield stars(parts)
            parts, size = [], 0
    if size:
        yield stars(parts)


def _finished(edges: DataFrame) -> DataFrame:
    """All nodes ``u`` of a few edges, each with the smallest one ``m`` that it is linked to, by one task."""

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([batch]) for batch in batches]
        if sum(map(len, parts)):
            nodes, order, low = _rooted(parts)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(n)) for n in (order, order[low])], ["u", "m"])

    return written(edges.coalesce(1).mapInArrow(labels, edges.withColumnRenamed("v", "m").schema))


def _with_low(rows: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """Rows ``u, v`` with their node's minimum ``m``; nodes of very many rows are broadcast apart, so no task has one's rows."""
    low_m = low.select("u", "m")
    if few:
        return rows.join(F.broadcast(low_m), "u")
    heavy = low.where(F.col("n") > HEAVY_ROWS).select("u", "m")
    if not heavy.limit(1).count():
        return rows.join(low_m, "u")
    rest = rows.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(low.where(F.col("n") <= HEAVY_ROWS).select("u", "m"), "u")
    return rows.join(F.broadcast(heavy), "u").unionByName(rest)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: ``(node, component)``, named by their smallest node.

    Each task first contracts the edges it reads, ``CHUNK_EDGES`` at a time, to stars, and then the
    edges around the nodes that it is dealt (:func:`_around`).  That ends most small components:
    a node whose only neighbour is smaller goes where that one goes and leaves the graph.
    What is left goes the same way, up to ``AROUND_ROUNDS`` times, and then by
    :func:`_stars`.  Edges that are few, ``BROADCAST_NODES / 2`` at most, are contracted by one
    task: rounds over many partitions would cost more than the edges do.  Rows with a null end are
    ignored; a node that only has a loop is its own component.
    """
    both = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"))
    if 2 * both.count() <= BROADCAST_NODES:
        return _finished(both).toDF("node", "component")
    found, loops = _labels(both.where("u <> v"), AROUND_ROUNDS), both.where("u = v").select("u")
    if loops.limit(1).count():
        found = found.unionByName(loops.distinct().join(found, "u", "left_anti").withColumn("m", F.col("u")))
    return found.toDF("node", "component")


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(ends)


def _around(edges: DataFrame) -> DataFrame:
    """Stars in place of the edges: of those that a task reads, then of those around the nodes dealt to it.

    Edges may be contracted wherever they are, so Spark is free to cut what belongs to a hub.
    """
    stars = edges.mapInArrow(_contracted, edges.schema)
    return _both_ways(stars).hint("rebalance", "u").mapInArrow(_contracted, edges.schema)


def _labels(edges: DataFrame, rounds: int) -> DataFrame:
    """All nodes ``u`` of edges without loops, each with the smallest one ``m`` that it is linked to."""
    if not rounds:
        return _stars(edges)
    work = written(_around(edges))
    low = written(_both_ways(work).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far")))
    leaf = (F.col("m") < F.col("u")) & (F.col("m") == F.col("far"))
    if not low.where((F.col("m") < F.col("u")) & ~leaf).limit(1).count():
        return low.select("u", F.least("u", "m").alias("m"))
    # Every edge leads from its larger end; those of leaves have done their work.
    rest = written(work.join(low.where(~leaf).select("u"), "u", "left_semi").distinct())
    many = rest.count()
    deeper = _finished(rest) if 2 * many <= BROADCAST_NODES else written(_labels(rest, rounds - 1))
    deeper = deeper.select(F.col("u").alias("root"), F.col("m").alias("to"))
    placed = low.select("u", F.when(leaf, F.col("m")).otherwise(F.col("u")).alias("root"))
    placed = placed.join(F.broadcast(deeper) if 2 * many <= BROADCAST_NODES else deeper, "root", "left")
    return placed.select("u", F.coalesce("to", "root").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    """:func:`_labels` by the published large-star and small-star steps.

    A step is a grouped minimum and an equi join, never a pair of neighbours, so a hub with a third
    of all edges costs its edges only: partial aggregation
    spreads the minimum, and the join with the table of minima, one row a node, is a broadcast up
    to ``BROADCAST_NODES`` nodes; beyond that, nodes of more than ``HEAVY_ROWS`` rows, of which
    there are few, are broadcast and the others shuffled.  The loop ends when every edge is
    one of a star below its smallest node, or when few edges are left.
    """
    nodes = written(_both_ways(edges).select(F.col("u").alias("node")).distinct())
    few = nodes.count() <= BROADCAST_NODES
    work = written(edges.mapInArrow(_contracted, edges.schema).distinct())
    while 2 * work.count() > BROADCAST_NODES:
        around = _both_ways(work)
        below = F.count_if(F.col("v") < F.col("u")).alias("below")
        low = written(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"), below))
        if not low.where("below > 1 or (below = 1 and n > 1)").limit(1).count():
            labels = low.where("below = 1").select("u", "m")
            break
        # Large star: each node hands its larger neighbours to the smallest of its neighbourhood.
        large = written(_with_low(around.where("v > u"), low, few).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: each node and its smaller neighbours point to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        rest = _with_low(large, low, few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        work = written(rest.union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        labels = _finished(work)
    spread = F.broadcast if few else lambda df: df
    return nodes.join(spread(labels), nodes.node == labels.u, "left").select(F.col("node").alias("u"), F.coalesce("m", "node").alias("m"))


def singleton_traces(matches: DataFrame) -> DataFrame:
    """One trace per match; its key is the match itself: adds ``trace``."""
    return matches.withColumn("trace", F.struct("image0", "idx0", "image1", "idx1"))


def _numbered(matches: DataFrame) -> DataFrame | None:
    """``image`` and ``no``, numbers in the order of the nodes' names; None where whole numbers cannot stand for the nodes."""
    ends = [matches.select(F.col(f"image{i}").alias("image"), F.col(f"idx{i}").alias("idx")) for i in (0, 1)]
    images = ends[0].union(ends[1]).where("image is not null").groupBy("image")
    known = images.agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_if(F.col("idx").isNull()).alias("none")).limit(MOST_IMAGES + 1).collect()
    if len(known) > MOST_IMAGES or any("#" in r.image or r.none or r.low < 0 or r.high >= 1 << 31 for r in known):
        return None
    names = sorted((r.image for r in known), key=lambda image: f"{image}#".encode())
    return F.broadcast(matches.sparkSession.createDataFrame([(image, i) for i, image in enumerate(names)], "image string, no long"))


def trace_members(matches: DataFrame) -> DataFrame:
    """Traces as components of the matched keypoints: ``(trace_id, image, kp_idx)``.

    A trace is called by its first member, image and index.  Up to ``MOST_IMAGES`` images are
    numbered, and whole numbers stand for the keypoints.
    """
    if (images := _numbered(matches)) is not None:
        rows = matches
        for i in (0, 1):
            rows = rows.join(images.withColumnsRenamed({"image": f"image{i}", "no": f"no{i}"}), f"image{i}")
        whole = lambda i: F.shiftleft(f"no{i}", 32) + F.col(f"idx{i}")
        found = connected_components(rows.select(whole(0).alias("src"), whole(1).alias("dst")))
        index = lambda c: F.col(c).bitwiseAND((1 << 32) - 1).cast("int")
        found = found.select(F.shiftright("component", 32).alias("first"), F.shiftright("node", 32).alias("no"), index("component").alias("at"), index("node").alias("kp_idx"))
        found = found.join(images.withColumnsRenamed({"image": "named", "no": "first"}), "first").join(images, "no")
        return found.select(F.concat_ws("#", "named", F.lpad(F.col("at").cast("string"), 10, "0")).alias("trace_id"), "image", "kp_idx")
    node = lambda i: F.concat_ws("#", f"image{i}", F.lpad(F.col(f"idx{i}").cast("string"), 10, "0"))
    found = connected_components(matches.select(node(0).alias("src"), node(1).alias("dst")))
    return found.select(F.col("component").alias("trace_id"), F.substring_index("node", "#", 1).alias("image"), F.substring_index("node", "#", -1).cast("int").alias("kp_idx"))


def trace_observations(members: DataFrame, keypoints: DataFrame, cameras: DataFrame, camera_of) -> DataFrame:
    """Members with their keypoint's place and their image's camera."""
    rows = members.join(keypoints, ["image", "kp_idx"]).withColumn("id", camera_of)
    return rows.join(small(cameras), "id")
