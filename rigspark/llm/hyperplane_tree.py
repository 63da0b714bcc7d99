"""Hard negatives: exact score windows searched in multiway hyperplane trees with range tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_names, written
from rigspark.scratch import small

#: Rows of one tree, anchors that meet a tree in one task, rows of a leaf, children of a node.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, SPLITS = 16_384, 8_192, 256, 12
#: Split points of the topmost node, whose children are sets of trees, and groups of labels; the
#: table of its ranges has at most TOP_POINTS ** 2 * LABEL_GROUPS entries.
TOP_POINTS, LABEL_GROUPS = 64, 16

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_QUERY = "anchor long, id long, label long, vec array<bigint>, nth array<int>, lo array<bigint>, hi array<bigint>"
_FOUND = "anchor long, nth int, id long, score long"


def matrix(vectors) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(width, 1)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits stand at the limit."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    bound = np.abs(q.astype(float)).max(initial=0) * np.abs(x.astype(float)).max(initial=0) * width
    if bound < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(q.astype(object) @ x.astype(object).T, _LEAST, _MOST).astype(np.int64)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(float), x.astype(float))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = squares(q)[:, None] + squares(x) - 2.0 * inner(q, x)
    return np.sqrt(np.maximum(d, 0))


def possible(norm: np.ndarray, apart: np.ndarray, lo: np.ndarray, hi: np.ndarray, ranges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which sibling sets may hold a row whose score with a query lies within its window.

    ``norm``: squared length of each query; ``apart``: its distance to each split point; ``ranges``:
    least and largest distance of each split point (row) to each set (column), least and largest
    squared length in each set.  As ``|q - x|^2 = |q|^2 + |x|^2 - 2 q.x``, a window of scores and
    the lengths of a set give an annulus round the query.  A set stays if for every split point
    the ring in which the set lies and the annulus can meet.
    """
    near, far, short, long = ranges
    slack = 1e-6 * (1 + np.sqrt(norm)[:, None] + np.sqrt(long))
    inside = np.sqrt(np.maximum(norm[:, None] + short - 2.0 * hi[:, None], 0)) - slack
    outer = norm[:, None] + long - 2.0 * lo[:, None]
    keep = outer >= -(slack**2)
    outer = np.sqrt(np.maximum(outer, 0)) + slack
    for i in range(len(near)):
        d = apart[:, i : i + 1]
        keep &= (d + far[i] >= inside) & (d - far[i] <= outer) & (near[i] - d <= outer)
    return keep


class Found:
    """The ``most`` best rows of each query: largest score first, ties by smaller id."""

    def __init__(self, queries: int, most: int) -> None:
        self.score = np.full((queries, most), _LEAST)
        self.id = np.full((queries, most), _MOST)

    def least(self) -> np.ndarray:
        """The score that a further row has to reach."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        met = np.unique(query)
        most = self.score.shape[1]
        query = np.r_[query, np.repeat(met, most)]
        score, ids = np.r_[score, self.score[met].ravel()], np.r_[ids, self.id[met].ravel()]
        order = np.lexsort((ids, ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < most
        self.score[query[best], place[best]] = score[best]
        self.id[query[best], place[best]] = ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.id < _MOST)
        return query, self.score[query, place], self.id[query, place]


class Tree:
    """Multiway hyperplane tree over rows of whole numbers, in flat arrays.

    A node picks split points far from each other and gives each row to its nearest one.  For
    each split point and each child it keeps the least and largest distance between them, and for
    each child the least and largest squared length.  A leaf's rows are read in full.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        order, norm = np.arange(len(x)), squares(x)
        bounds, first, children, splits, at, tables = [(0, len(x))], [], [], [], [], []
        i = 0
        while i < len(bounds):
            start, stop = bounds[i]
            rows, i = order[start:stop], i + 1
            points = self._split_points(x[rows]) if stop - start > LEAF_ROWS else np.zeros(0, int)
            first.append(len(bounds))
            at.append(sum(map(len, tables[-1:])) + (at[-1] if at else 0))
            if len(points) < 2:
                children.append(0)
                tables.append(np.zeros(0))
                continue
            points = rows[points]
            apart = distances(x[rows], x[points])
            child = apart.argmin(1)
            by = np.argsort(child, kind="stable")
            order[start:stop], apart, child = rows[by], apart[by], child[by]
            own, begin = np.unique(child, return_index=True)
            lengths = norm[order[start:stop]]
            table = [np.minimum.reduceat(apart, begin).T[own], np.maximum.reduceat(apart, begin).T[own]]
            table += [np.minimum.reduceat(lengths, begin)[None], np.maximum.reduceat(lengths, begin)[None]]
            tables.append(np.concatenate(table).ravel())
            children.append(len(own))
            splits.append(points[own])
            bounds += [(start + a, start + b) for a, b in zip(begin, [*begin[1:], stop - start], strict=True)]
        place = np.empty(len(x), int)
        place[order] = np.arange(len(x))
        self.bounds, self.first, self.children = np.array(bounds), np.array(first), np.array(children)
        self.splits = place[np.concatenate(splits)] if splits else np.zeros(0, int)
        self.at, self.tables = np.array(at), np.concatenate(tables)
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]

    @staticmethod
    def _split_points(x: np.ndarray) -> np.ndarray:
        """Rows of a spread sample, each as far as can be from those before it."""
        sample = np.unique(np.linspace(0, len(x) - 1, 3 * SPLITS).astype(int))
        apart = distances(x[sample], x[sample])
        chosen, nearest = [0], apart[0].copy()
        while len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, apart[chosen[-1]])
        return sample[chosen]

    def search(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int, same: bool) -> Found:
        """For each query the ``most`` best rows of scores in ``lo`` to ``hi``, of its label or (``same`` false) of others."""
        found, norm = Found(len(q), most), squares(q)
        stack = [(0, np.arange(len(q)))]
        begin = np.r_[0, np.cumsum(self.children)]
        while stack:
            node, who = stack.pop()
            start, stop = self.bounds[node]
            least = np.maximum(lo[who], found.least()[who])
            if not self.children[node]:
                score = inner(q[who], self.x[start:stop])
                fits = (score >= least[:, None]) & (score <= hi[who, None])
                fits &= ((labels[who, None] == self.labels[start:stop]) == same) & (ids[who, None] != self.ids[start:stop])
                query, row = np.nonzero(fits)
                found.add(who[query], score[query, row], self.ids[start + row])
                continue
            n = self.children[node]
            table = self.tables[self.at[node] : self.at[node] + (2 * n + 2) * n].reshape(2 * n + 2, n)
            apart = distances(q[who], self.x[self.splits[begin[node] : begin[node] + n]])
            keep = possible(norm[who], apart, least, hi[who], (table[:n], table[n : 2 * n], table[2 * n], table[2 * n + 1]))
            for child in np.argsort(-apart.mean(0)):  # the nearest is taken first
                if keep[:, child].any():
                    stack.append((self.first[node] + child, who[keep[:, child]]))
        return found

    def to_bytes(self) -> bytes:
        """All arrays, the rows in the smallest type that holds them."""
        out, arrays = io.BytesIO(), vars(self).copy()
        arrays["x"] = next((self.x.astype(t) for t in (np.int16, np.int32) if (self.x == self.x.astype(t)).all()), self.x)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def of(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as arrays:
            tree.__dict__.update(arrays)
        return tree


class Forest:
    """Trees by label group, domain (nearest split point of the topmost node) and bucket of a domain."""

    def __init__(self, points: DataFrame) -> None:
        n = points.count()
        self.groups = max(min(LABEL_GROUPS, -(-n // SHARD_ROWS)), 1)
        most = max(min(TOP_POINTS, -(-n // SHARD_ROWS)), 1)
        chosen = points.select("vec").orderBy(F.xxhash64("vec"), "id").limit(most).collect()
        self.tops = np.unique(matrix([r.vec for r in chosen] or [[0]]), axis=0)
        tops = self.tops

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                frame["domain"] = distances(matrix(frame["vec"]), tops).argmin(1).astype("int32")
                yield frame

        placed = written(points.mapInPandas(place, "id long, label long, vec array<bigint>, domain int").withColumn("grp", self.group("label")))
        sizes = placed.groupBy("grp", "domain").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts"))
        dealt = placed.join(F.broadcast(written(sizes)), ["grp", "domain"]).withColumn("part", F.pmod(F.xxhash64("id", "vec"), "parts").cast("int"))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            x = matrix(frame["vec"])
            tree, apart, norm = Tree(x, frame["id"].to_numpy(), frame["label"].to_numpy()), distances(tops, x), squares(x)
            row = {c: frame[c][:1] for c in ("grp", "domain", "part")}
            row |= {"tree": [tree.to_bytes()], "near": [apart.min(1)], "far": [apart.max(1)], "short": [norm.min()], "long": [norm.max()]}
            return pd.DataFrame(row)

        self.trees = written(dealt.groupBy("grp", "domain", "part").applyInPandas(build, "grp int, domain int, part int, tree binary, near array<double>, far array<double>, short double, long double"))
        self.parts = small(written(self.trees.select("grp", "domain", "part")))
        ranges = self.trees.select("grp", "domain", "short", "long", F.posexplode(F.arrays_zip("near", "far")).alias("i", "r"))
        ranges = ranges.groupBy("grp", "domain", "i").agg(F.min("r.near").alias("near"), F.max("r.far").alias("far"), F.min("short").alias("short"), F.max("long").alias("long"))
        found = ranges.toPandas().sort_values(["grp", "domain", "i"])
        each = found[found["i"] == 0]
        table = lambda c: found[c].to_numpy().reshape(len(each), len(tops)).T
        self.sets = each[["grp", "domain"]].to_numpy()
        self.ranges = (table("near"), table("far"), each["short"].to_numpy(), each["long"].to_numpy())

    def group(self, label: str) -> Column:
        return F.pmod(F.hash(label), F.lit(self.groups)).cast("int")

    def search(self, queries: DataFrame, most: int, same: bool, own: bool | None = None) -> DataFrame:
        """For each query and window the ``most`` best rows of each tree that the ranges do not exclude.

        ``queries``: ``anchor``, ``id``, ``label``, ``vec`` and, as arrays, ``nth``, ``lo``, ``hi``
        of its windows, and ``grp`` of its label.  ``own``: only in the query's own domain, or
        only in the others.
        """
        tops, sets, ranges = self.tops, self.sets, self.ranges

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for first in range(0, len(frame), 1024):
                    part = frame[first : first + 1024].reset_index(drop=True)
                    q = matrix(part["vec"])
                    apart = distances(q, tops)
                    lo, hi = np.array([min(v) for v in part["lo"]]), np.array([max(v) for v in part["hi"]])
                    keep = possible(squares(q), apart, lo, hi, ranges)
                    if same:
                        keep &= part["grp"].to_numpy()[:, None] == sets[:, 0]
                    if own is not None:
                        keep &= (apart.argmin(1)[:, None] == sets[:, 1]) == own
                    query, to = np.nonzero(keep)
                    sent = part.iloc[query].copy()
                    sent["grp"], sent["domain"] = sets[to, 0], sets[to, 1]
                    yield sent

        blocks = max(-(-queries.count() // QUERY_ROWS), 1)
        sent = queries.mapInPandas(route, f"{_QUERY}, grp int, domain int").join(self.parts, ["grp", "domain"])
        sent = sent.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
        trees = self.trees.select("grp", "domain", "part", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        keys = ["grp", "domain", "part", "block"]

        def meet(frame: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame({"anchor": [], "nth": [], "id": [], "score": []}, dtype="int64")
            times = frame["nth"].map(len).to_numpy()
            flat = lambda c: np.concatenate(frame[c].to_numpy())
            wide = lambda c: np.repeat(frame[c].to_numpy(), times)
            q, nth = np.repeat(matrix(frame["vec"]), times, axis=0), flat("nth")
            found = Tree.of(tree["tree"][0]).search(q, wide("id"), wide("label"), flat("lo"), flat("hi"), most, same)
            query, score, ids = found.rows()
            return pd.DataFrame({"anchor": wide("anchor")[query], "nth": nth[query], "id": ids, "score": score})

        return sent.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(meet, _FOUND)


def _best(found: DataFrame, most: int, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Near rows of another label, but not too near, for each anchor and each of its positives.

    ``rows``: ``id`` and ``label`` (whole numbers), ``vec`` (array<bigint>), none null; other
    columns are not looked at.  A row's score is its exact inner product with the anchor; higher
    scores come first, ties by smaller id.  The positives of an anchor are its first ``positives``
    other rows of the same label; for each, the first ``negatives`` rows of other labels with
    ``low * positive <= 100 * negative <= high * positive`` are returned: ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows equal in id, label and vector count once; rows with the anchor's id are never its
    positives or negatives; an id with several vectors or labels is as many rows, and as many
    anchors.  Vectors of different lengths are compared as if the shorter ended in zeros.  Scores
    beyond 64 bits stand at the limit.  An anchor without positives, or none in a window, returns
    nothing; so does an empty table.

    Plan: of rows equal in label and vector only as many smallest ids as can be returned are
    kept (all anchors stay), so a group of copies is small.  Split points of a topmost node, a
    sample of at most ``TOP_POINTS``, part the rest into domains; domains and groups of labels are
    dealt to trees of about ``SHARD_ROWS`` rows, a hot one to several.  Anchors look for positives
    in their own domain first, which gives the annulus for the others; the ranges of the topmost
    node decide which trees an anchor is sent to, those of the nodes which leaves are read.  All
    is exact: ranges only exclude.
    """
    rows = written(rows.select("id", "label", "vec").distinct().withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))))
    same_vector = Window.partitionBy("label", "vec").orderBy("id")
    points = rows.withColumn("nth", F.row_number().over(same_vector)).where(F.col("nth") <= max(positives + 1, negatives))
    forest = Forest(written(points.select("id", "label", "vec")))
    anchors = rows.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vec", forest.group("label").alias("grp"))
    anchors = written(anchors)
    window = lambda lo, hi: (F.array(F.lit(0)).alias("nth"), F.array(lo).alias("lo"), F.array(hi).alias("hi"), "grp")
    every, least, most = ("anchor", "id", "label", "vec"), F.lit(_LEAST), F.lit(_MOST)

    first = written(forest.search(anchors.select(*every, *window(least, most)), positives, True, True))
    reach = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list("score")).alias("scores"))
    bound = F.when(F.size("scores") >= positives, F.element_at("scores", -positives)).otherwise(least)
    reach = anchors.join(reach, "anchor", "left").select(*every, *window(F.coalesce(bound, least), most))
    rest = forest.search(written(reach), positives, True, False)
    chosen = written(_best(first.unionByName(rest), positives, "anchor").select("anchor", F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # The window in whole numbers that do not overflow: ceil(low * s / 100) and floor(high * s / 100).
    score = F.col("positive_score").cast("decimal(24,0)")
    lo, hi = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    windows = chosen.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    windows = windows.groupBy("anchor").agg(F.collect_list(F.struct("nth", "lo", "hi")).alias("w"))
    asked = anchors.join(windows, "anchor").select(*every, *(F.col(f"w.{c}").alias(c) for c in ("nth", "lo", "hi")), "grp")
    found = _best(forest.search(written(asked), negatives, False), negatives, "anchor", "nth")
    found = found.select("anchor", "nth", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(chosen, ["anchor", "nth"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``label`` and ``vec`` = floor(256 x) of rows whose parts are all there and finite.

    Where 7 divides the id the label first becomes ``(label + 1) % 10``.  Rows without id, label
    or vector, or with a null or non-finite component, take no part; an empty vector is a zero.
    """
    c = fresh_names(df, "id", "label", "vec")
    df = df.select(F.col(f"`{id_col}`").cast("long").alias(c["id"]), F.col(f"`{label_col}`").cast("long").alias(c["label"]), F.col(f"`{vector_col}`").cast("array<double>").alias(c["vec"]))
    finite = F.forall(c["vec"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col(c["id"]) % 7 == 0, (F.col(c["label"]) + 1) % 10).otherwise(F.col(c["label"]))
    df = df.where(F.col(c["id"]).isNotNull() & F.col(c["label"]).isNotNull() & finite)
    return df.select(F.col(c["id"]).alias("id"), label.alias("label"), F.transform(c["vec"], lambda x: F.floor(x * 256)).alias("vec"))


def negatives_of_every_fiftieth(df: DataFrame) -> DataFrame:
    """Hard negatives for rows whose id is divisible by 50, against all rows."""
    return hard_negatives(whole_rows(df), F.col("id") % 50 == 0)
