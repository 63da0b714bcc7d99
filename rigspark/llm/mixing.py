"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_prefix, word_count, written

#: Rows of the per-source tables up to which they are broadcast (under 100 bytes a row).
BROADCAST_ROWS = 500_000
#: Rows that one bucket of the ranking should hold.
BUCKET_ROWS = 8192


def _bounded(df: DataFrame) -> DataFrame:
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def water_fill(rows: DataFrame, keys: list[str], cap: str, weight: str, total: str) -> DataFrame:
    """Adds ``level``: the share of ``total`` that falls on a unit of ``weight``.

    Within ``keys`` each row gets ``least(cap, level * weight)`` and these sum to ``total``, or
    to all caps where they are less.  This is where resharing the excess over the caps by weight
    ends: the rows with the least cap for their weight are full, the others share the rest.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(cap) / F.col(weight), cap, weight)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*keys)
    rest = F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    share = F.sum(weight).over(everyone) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    rows = rows.withColumn("__level", rest / share)
    open_ = F.when(F.col("__level") * F.col(weight) <= F.col(cap), F.col("__level"))
    return rows.withColumn("level", F.coalesce(F.max(open_).over(everyone), F.lit(float("inf")))).drop("__level")


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that these columns and the seed decide."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double")
    return (h + 0.5) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, tilt: float = 0.1, seed: int = 20) -> DataFrame:
    """How often each document goes into a mix of the sources by weight.

    Adds ``size`` (words of the text, null: 0), ``source_size``, ``target`` (the words that the
    source is to give), ``copies`` and ``taken`` (``copies * size``) to the input's columns,
    replacing columns of these names.

    Sources in code point order, null last and a source of its own, weigh ``weights``, repeated,
    and share the words of all documents; no target exceeds ``most`` times its source's words.
    Within a source the expected copies of a document grow with its length, by ``tilt`` for each
    doubling, and stop at ``most``; they are scaled to meet the target.  The whole part is
    certain.  The rest is the document's inclusion probability p: documents are ranked by
    ``u / (1 - u)`` over ``p / (1 - p)``, u being a number that seed, id and text decide, and taken
    in this order up to the rank whose sum of words is nearest to what is missing.  So every
    source's words meet its target but for half of one document at most.

    Documents without words (null, empty or blank texts) add none and get no copies.  Rows with
    equal id and text, null ids included, are ranked as one and chosen together.  Texts of any
    length are counted whole.  An empty table gives an empty result.  Other columns of any name
    stay.  Reruns agree.

    Plan: two aggregations by source and length class, one by source and rank range, and a window
    over the ranges in which the order is cut; the documents themselves are never shuffled.
    """
    mark = fresh_prefix(docs)
    text, key = F.col(f"`{text_col}`"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("t"))
    size = word_count(text)
    # The class of a length: its number of binary digits.
    row = {"__key": key, "__size": size, "__class": F.when(size > 0, F.floor(F.log2(size.cast("double")))).cast("int"), "__u": _uniform(seed, F.col(f"`{id_col}`"), text)}
    narrow = written(docs.select(*(c.alias(n) for n, c in row.items())))

    classes = narrow.groupBy("__key", "__class").agg(F.sum("__size").cast("double").alias("words"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes)
    sources = classes.groupBy("__key").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    nth = F.row_number().over(Window.orderBy("__key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    total = sources.agg(F.sum("source_size").alias("total"))
    sources = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).crossJoin(F.broadcast(total))
    sources = water_fill(sources, [], "cap", "weight", "total")
    sources = sources.select("__key", "source_size", "rows", F.least("cap", F.col("level") * F.col("weight")).alias("target"))

    # Expected copies of each length class, scaled to the source's target.
    likes = classes.where("words > 0").drop("rows").withColumn("pull", F.col("words") * (1 + tilt * F.col("__class"))).withColumn("full", most * F.col("words"))
    likes = water_fill(likes.join(sources, "__key"), ["__key"], "full", "pull", "target")
    likes = likes.withColumn("copies", F.least(F.lit(float(most)), F.col("level") * F.col("pull") / F.col("words")))
    # Within rounding a whole number of copies is certain.
    likes = likes.withColumn("sure", F.floor(F.col("copies") + 1e-9)).withColumn("p", F.greatest(F.col("copies") - F.col("sure"), F.lit(0.0)))
    likes = likes.withColumn("p", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(0.0))
    by = Window.partitionBy("__key")
    likes = likes.withColumn("missing", F.sum(F.col("p") * F.col("words")).over(by)).withColumn("mean_p", F.col("missing") / F.sum(F.when(F.col("p") > 0, F.col("words"))).over(by))
    likes = _bounded(likes.select("__key", "__class", F.col("sure").cast("int").alias("sure"), "p", "missing", "mean_p", F.ceil(F.col("rows") / BUCKET_ROWS).alias("ranges")))
    sources = _bounded(sources.select("__key", F.col("source_size").cast("long").alias("source_size"), "target"))

    # The ranking, its sums over ranges, and the range in which each source is cut.
    odds = F.col("__u") / (1 - F.col("__u")) / (F.col("p") / (1 - F.col("p")))
    middle = (1 - F.col("mean_p")) / F.col("mean_p")
    ranked = narrow.where("__size > 0").join(likes, ["__key", "__class"]).where("p > 0").withColumn("__q", odds)
    ranked = ranked.withColumn("range", F.least(F.floor(F.col("__q") / (F.col("__q") + middle) * F.col("ranges")), F.col("ranges") - 1))
    sums = ranked.groupBy("__key", "range").agg(F.sum("__size").alias("words"), F.first("missing").alias("missing"))
    until = F.sum("words").over(Window.partitionBy("__key").orderBy("range"))
    sums = sums.withColumn("until", until).where("until >= missing or until is null")
    cut = sums.groupBy("__key").agg(F.min_by(F.struct("range", (F.col("until") - F.col("words")).alias("sum")), "range").alias("c")).select("__key", F.col("c.range").alias("cut_range"), F.col("c.sum").alias("before"))
    inside = ranked.join(_bounded(cut), "__key").where("range = cut_range").groupBy("__key", "__q").agg(F.sum("__size").alias("words"), F.first("missing").alias("missing"), F.first("before").alias("before"))
    so_far = F.col("before") + F.sum("words").over(Window.partitionBy("__key").orderBy("__q"))
    inside = inside.withColumn("over", so_far - F.col("missing"))
    # Take the rank whose sum is nearest: one that stays below, or the first above if it is nearer.
    inside = inside.withColumn("take", (F.col("over") <= 0) | ((F.col("over") - F.col("words") < 0) & (F.col("over") < F.col("words") / 2)))
    last = inside.groupBy("__key").agg(F.max(F.when(F.col("take"), F.col("__q"))).alias("top"), F.min("__q").alias("low"))
    last = _bounded(last.select("__key", F.coalesce("top", F.col("low") * (1 - 1e-12)).alias("last_q")))

    # Beside the input's columns all others stand under names that it does not have.
    own = lambda df, *names: df.select(*(F.col(c).alias(f"{mark}{c}") for c in names))
    mine = lambda c: F.col(f"{mark}{c}")
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    out = docs.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(f"{mark}{n}") for n, c in row.items()))
    for table, keys in ((own(likes, "__key", "__class", "sure", "p"), ["__key", "__class"]), (own(last, "__key", "last_q"), ["__key"]), (own(sources, "__key", "source_size", "target"), ["__key"])):
        out = out.join(table, [f"{mark}{k}" for k in keys], "left")
    odds = mine("__u") / (1 - mine("__u")) / (mine("p") / (1 - mine("p")))
    chosen = (mine("p") > 0) & (odds <= F.coalesce(mine("last_q"), F.lit(float("inf"))))
    copies = F.coalesce(mine("sure") + F.when(chosen, 1).otherwise(0), F.lit(0)).cast("int")
    return out.select(*(F.col(f"`{c}`") for c in kept), mine("__size").alias("size"), mine("source_size").alias("source_size"), mine("target").alias("target"), copies.alias("copies"), (mine("__size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the input's columns.

    An input column that :func:`mix_sources` would replace stays as it is.
    """
    mark = fresh_prefix(docs)
    held = docs.select(*(F.col(f"`{c}`").alias(f"{mark}{i}") for i, c in enumerate(docs.columns)))
    at = {c: f"{mark}{i}" for i, c in enumerate(docs.columns)}
    names = {k: at[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    took = mix_sources(held, **names, **options)
    rows = took.where("copies > 0").select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return rows.select(*(F.col(n).alias(c) for c, n in at.items()))
