"""Merkle manifest of a dataset: a root, and a proof for each row, by butterfly exchange."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import written
from rigspark.scratch import small

#: Leaves of one block, the part of a tree that one task holds; rounded down to a power of the fanout.
BLOCK_LEAVES = 4096
#: Rounds of the exchange after which its state is written, which cuts the plan.
ROUNDS_A_TABLE = 8

_STEP = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(*cols: Column) -> Column:
    """SHA-256 in lower-case hex of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)), 256)


def levels_of(n: int, fanout: int) -> int:
    """How often ``n`` nodes are joined, ``fanout`` at a time, until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(nodes: list[str], fanout: int) -> list[str]:
    """The next level: every ``fanout`` consecutive nodes, the last run may be shorter, joined."""
    return [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def paths(nodes: list[str], fanout: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each node its siblings left and right of it, level by level."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    width = 1
    for _ in range(levels):
        runs = (nodes[i : i + fanout] for i in range(0, len(nodes), fanout))
        beside = [("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))]
        for k, own in enumerate(steps):
            own.append(beside[k // width])
        nodes, width = climb(nodes, fanout), width * fanout
    return steps


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in steps:
        node = digest(left + node + right)
    return node


def positions(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row of its group in ``order``, and ``n``, the rows of the group.

    Rows are dealt to sorted ranges, whatever their groups; a place is the rows of the group in
    earlier ranges and a row number within one, so no task holds more than a range of any group.
    Rows equal in all of ``order`` take neighbouring places.
    """
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tie = F.monotonically_increasing_id()
    keyed = nodes.withColumn("tie", tie).repartitionByRange(ranges, group, *order, "tie")
    rows = written(keyed.withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(group).alias("__of"), F.col("part").alias("__in"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(group)).alias("n")
    )
    counts = small(written(counts))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "tie")) - 1
    rows = rows.withColumn("within", within)
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("__of")) & (F.col("part") == F.col("__in")))
    return rows.withColumn("pos", F.col("before") + F.col("within")).drop("__of", "__in", "before", "within", "part", "tie")


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """Exchanges subtree roots between the blocks of each group until every block knows the root above all.

    ``blocks``: ``grp``, ``block`` (gapless from 0), ``total`` (blocks of the group), ``root``.
    In round r the blocks whose numbers differ in digit r to base ``fanout`` form one exchange
    group: each sends the root of the subtree that it lies in to all of them, and each hashes the
    common ancestor by itself.  The siblings that came in are the next step of its proof.  Block
    numbers are filled up to a power of ``fanout`` with empty blocks, at most ``fanout`` times as
    many, so a subtree cut off at the end of the group is passed on like a full one.  Every block
    sends and gets ``fanout`` rows a round; there is no way down.
    """
    top = blocks.agg(F.max("total")).first()[0] or 0
    rounds = levels_of(top, fanout)
    need = F.lit(1).cast("long")
    for r in range(rounds):  # the least power of the fanout that holds all blocks
        need = F.when(F.col("total") > fanout**r, F.lit(fanout ** (r + 1))).otherwise(need)
    state = blocks.withColumn("need", need)
    if rounds:
        empty = state.where("block = 0").withColumn("block", F.explode(F.filter(F.sequence("total", "need"), lambda b: b < F.col("need"))))
        state = state.unionByName(empty.withColumn("root", F.lit(None).cast("string")))
    state = state.select("grp", "block", "total", "need", "root", F.array().cast(_STEP).alias("steps"))
    for r in range(rounds):
        width = fanout**r
        digit = F.expr(f"(block div {width}L) % {fanout}L")
        sent = state.withColumn("digit", digit).withColumn(
            "to", F.explode(F.when(F.col("need") > width, F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda d: F.col("block") + (d - F.col("digit")) * width)).otherwise(F.array("block")))
        )
        own = F.col("to") == F.col("block")
        met = sent.groupBy("grp", "to", "total", "need").agg(
            F.array_sort(F.collect_list(F.struct("digit", "root"))).alias("all"), F.max(F.when(own, F.col("digit"))).alias("digit"), F.first(F.when(own, F.col("steps")), ignorenulls=True).alias("steps"), F.first(F.when(own, F.col("root")), ignorenulls=True).alias("root")
        )
        text = lambda keep: F.concat_ws("", F.transform(F.filter("all", keep), lambda s: s["root"]))
        everyone = text(lambda s: s["root"].isNotNull())
        step = F.struct(text(lambda s: s["digit"] < F.col("digit")).alias("left"), text(lambda s: s["digit"] > F.col("digit")).alias("right"))
        joins = F.col("need") > width
        state = met.select(
            "grp",
            F.col("to").alias("block"),
            "total",
            "need",
            F.when(joins, F.when(everyone != "", F.sha2(everyone, 256))).otherwise(F.col("root")).alias("root"),
            F.when(joins, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
        )
        if r % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1:
            state = written(state)
    return state.where("block < total").drop("total", "need")


def roots(nodes: DataFrame, fanout: int) -> DataFrame:
    """For each block of the trees ``grp``: the tree's root and the steps from the block's root to it."""
    width = block_width(fanout)

    def root_of(frame: pd.DataFrame) -> pd.DataFrame:
        n, level = int(frame["n"][0]), frame.sort_values("pos")["leaf"].tolist()
        for _ in range(levels_of(min(n, width), fanout)):
            level = climb(level, fanout)
        return pd.DataFrame({"grp": frame["grp"][:1], "block": frame["block"][:1], "total": [-(-n // width)], "root": level})

    found = nodes.groupBy("grp", "block").applyInPandas(root_of, "grp string, block long, total long, root string")
    return written(butterfly(written(found), fanout))


def proofs(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Adds ``steps`` and ``folded`` to nodes, and the columns of ``above`` beside grp, block and steps."""
    width = block_width(fanout)
    more = [f for f in above.schema.fields if f.name not in ("grp", "block", "steps")]

    def prove(frame: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", ignore_index=True)
        own = paths(frame["leaf"].tolist(), fanout, levels_of(min(int(frame["n"][0]), width), fanout))
        upper = [(s["left"], s["right"]) for s in top["steps"][0]]
        ends: dict[str, str] = {}  # most leaves of a block end in the same root
        folded = []
        for leaf, forged, steps in zip(frame["leaf"], frame["forged"], own, strict=True):
            end = fold(forged or leaf, steps)
            if end not in ends:
                ends[end] = fold(end, upper)
            folded.append(ends[end])
        for f in more:
            frame[f.name] = top[f.name][0]
        frame["steps"] = [[{"left": a, "right": b} for a, b in steps + upper] for steps in own]
        frame["folded"] = folded
        return frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*nodes.schema.fields, *more])
    return nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(prove, f"{fields}, steps {_STEP}, folded string")


def block_width(fanout: int) -> int:
    return fanout ** max(int(math.log(BLOCK_LEAVES) / math.log(fanout) + 1e-9), 1)


def in_blocks(nodes: DataFrame, group: str, order: list[str], fanout: int) -> DataFrame:
    """Nodes with their places in the tree ``grp`` and aligned blocks.

    ``grp`` sorts like ``group``, null first, and no two groups share it.
    """
    placed = positions(nodes, group, order)
    name = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("-"))
    return placed.withColumn("block", F.expr(f"pos div {block_width(fanout)}L")).withColumn("grp", name)


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """Manifest of rows given as ``id``, ``lang``, ``leaf`` and ``forged``.

    The leaves of each ``lang`` ascend by ``id`` (null first), then by their digest; while several
    nodes remain, every ``fanout`` consecutive ones (the last run may be shorter, even of one)
    become the SHA-256 of their digests.  The subroots, by ``lang`` (null first, then bytewise),
    give the root in the same way.

    Returns ``id``, ``leaf``, ``subroot``, ``root``, ``steps`` (for each level from the leaf to
    the root the siblings left and right of the path), ``folded`` (the root that ``forged``, where
    it is not null, else ``leaf`` gives with these siblings).  Repeated rows are leaves of their
    own; those equal in all columns take neighbouring places.  No rows, no manifest.

    Plan: leaves are ranked in sorted ranges and dealt in aligned blocks of ``BLOCK_LEAVES``; a
    task hashes the part of the tree within a block, blocks meet in the rounds of
    :func:`butterfly`, and each block then writes its leaves' proofs.  Only ids and digests are
    moved, never the rows' other columns.  A ``lang`` of any size is spread over its blocks.
    """
    nodes = written(in_blocks(rows.select("id", "lang", "leaf", "forged"), "lang", ["id", "leaf", "forged"], fanout).drop("lang"))
    above = roots(nodes, fanout)
    subroots = above.where("block = 0").select(F.lit(0).alias("top"), F.col("grp").alias("of"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("forged"))
    tops = written(in_blocks(subroots, "top", ["of"], fanout).drop("top"))
    tops = proofs(tops, roots(tops, fanout), fanout).select(F.col("of").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("upper"))
    above = above.drop("root").join(small(written(tops)), "grp").withColumn("steps", F.concat("steps", "upper")).drop("upper")
    return proofs(nodes, above, fanout).select("id", "leaf", "subroot", "root", "steps", "folded")


def dataset_manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """Manifest of documents, with what tampering with some of them does to the root.

    A leaf is :func:`leaf_hash` of doc_id, source, lang, n_chars and text.  Where 7 divides the
    CRC-32 of the decimal doc_id, the copy that is verified has ``n_chars`` one larger; a null
    ``n_chars`` stays and so does a document without id.  ``proof_sha256`` is the SHA-256 of the
    siblings of the path, level by level upwards, left to right in a level.  Documents with equal
    ids are leaves of their own.  Null, empty and very long texts are hashed like others, columns
    beside these five are not looked at, and an empty table gives an empty result.
    """
    fields = lambda n: (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    forged = F.when(tampered, leaf_hash(*fields(F.col("n_chars").cast("decimal(20,0)") + 1)))
    rows = written(docs.select(F.col("doc_id").alias("id"), "lang", leaf_hash(*fields(F.col("n_chars"))).alias("leaf"), forged.alias("forged")))
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["left"], s["right"])))
    return manifest(rows, fanout).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )
