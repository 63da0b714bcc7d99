"""Lookup, pair, temporal and gather joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.scratch import small, written


def with_camera(df: DataFrame, cameras: DataFrame, key: str = "id") -> DataFrame:
    return df.join(small(cameras), key)


def known_only(matches: DataFrame, cameras: DataFrame, left: str, right: str, key: str = "id") -> DataFrame:
    """Pairs of which both sides are known."""
    for i, side in enumerate((left, right)):
        known = cameras.select(F.col(key).alias(f"__known{i}"))
        matches = matches.join(small(known), F.col(side) == F.col(f"__known{i}"), "left_semi")
    return matches


def invalid_inputs(inputs: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Inputs that gave no result."""
    return inputs.join(results, on, "left_anti")


def pairs_within(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Unordered pairs of the members of each key: ``(*keys, i, j)`` with i < j.

    For keys with few members by nature (cameras of a rig, lines of an order); the result grows
    with the square of a key's members.
    """
    a = df.select(*keys, F.col(ident).alias("i"))
    b = df.select(*keys, F.col(ident).alias("j"))
    return a.join(b, keys).where("i < j")


def ring_pairs(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Each member and the next one in order, the last with the first."""
    w = Window.partitionBy(*keys).orderBy(ident)
    first = F.min(ident).over(Window.partitionBy(*keys))
    return df.select(*keys, F.col(ident).alias("i"), F.coalesce(F.lead(ident).over(w), first).alias("j"))


def resolve_matches(matches: DataFrame, left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Both ends of each match with their own columns."""
    return matches.join(left, left_on).join(right, right_on)


def with_previous(df: DataFrame, keys: list[str], frame: str, cols: list[str]) -> DataFrame:
    """The columns of the frame before, as ``prev_*``; null where there is none."""
    before = df.select(*keys, (F.col(frame) + 1).alias(frame), *(F.col(c).alias(f"prev_{c}") for c in cols))
    return df.join(before, [*keys, frame], "left")


#: Rows of the right side of each key whose distances rule out the others.
PIVOTS = 32


#: Rows of a block of either side.
BLOCK_ROWS = 8192
#: Left rows of a block that are compared at a time.
STRIP_ROWS = 256


def _nearest(left: pd.DataFrame, right: pd.DataFrame, keys: list[str], most: int) -> pd.DataFrame:
    """The ``most`` nearest rows of the right block for each of the left.

    Products of matrices rule out what lies beyond the rounding error of the nearest; the rest is
    measured component by component, in order.
    """
    found = []
    if len(left) and len(right):
        right = right.sort_values("right_id", ignore_index=True)
        x, y = (np.stack(s.to_list()).astype(float) for s in (left["__a"], right["__b"]))
        middle = y.mean(0)
        x0, y0 = x - middle, y - middle
        xx, yy = (x0 * x0).sum(1), (y0 * y0).sum(1)
        most = min(most, len(y))
        for at in range(0, len(x), STRIP_ROWS):
            own = slice(at, at + STRIP_ROWS)
            rough = xx[own, None] + yy - 2 * (x0[own] @ y0.T)
            slack = 1e-10 * (xx[own, None] + yy.max()) + 1e-300
            near = ~(rough > np.partition(rough, most - 1, 1)[:, most - 1 : most] + slack)
            i, j = np.nonzero(near)
            square = np.zeros(len(i))
            for c in range(x.shape[1]):
                d = x[i + at, c] - y[j, c]
                square += d * d
            distance = np.sqrt(square)
            order = np.lexsort((j, distance, i))
            i, j, distance = i[order], j[order], distance[order]
            first = np.r_[True, i[1:] != i[:-1]]
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            kept = place < most
            found.append((i[kept] + at, j[kept], distance[kept]))
    i, j, distance = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    out = {k: left[k].iloc[i].to_numpy() for k in keys}
    return pd.DataFrame(out | {"left_id": left["left_id"].iloc[i].to_numpy(), "right_id": right["right_id"].iloc[j].to_numpy(), "distance": distance})


def match_descriptors(left: DataFrame, right: DataFrame, keys: list[str], ident: str, vector: str, mode: str = "floor", factor: float = 3.0, floor: float = 0.02, ratio: float = 0.75, pivots: int = PIVOTS) -> DataFrame:
    """Nearest descriptor of the right side for each of the left within the keys (exact search).

    ``floor``: accept a distance up to the greater of ``factor`` times the key's least and
    ``floor``.  ``ratio``: accept where the best is below ``ratio`` times the second best; a key
    with one descriptor on the right gives none.  Ties go to the smaller id.  Vectors that are
    null or hold null or NaN take no part.

    Plan: each right descriptor belongs to the nearest of its key's ``pivots`` (a sample by hash).
    A left one is held only against the cells that the triangle inequality does not rule out,
    given that the pivots themselves are candidates.  Cells are compared in blocks of both sides by
    products of matrices, and what these leave is measured exactly; only the best of a block go
    on.  The two best are kept by a rank limit.
    """
    from rigspark.functions.scalars import dist_l2sq

    fit = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")), F.lit(False)))
    a = left.where(fit).select(*keys, F.col(ident).alias("left_id"), F.col(vector).alias("__a"))
    b = right.where(fit).select(*keys, F.col(ident).alias("right_id"), F.col(vector).alias("__b"))
    drawn = Window.partitionBy(*keys).orderBy(F.xxhash64("right_id"), "right_id")
    sample = b.withColumn("__rn", F.row_number().over(drawn)).where(F.col("__rn") <= pivots)
    table = small(written(sample.groupBy(*keys).agg(F.collect_list("__b").alias("__pivots"))))

    def to_pivots(rows: DataFrame, v: str) -> DataFrame:
        return rows.join(table, keys).withColumn("__to", F.transform("__pivots", lambda p: F.sqrt(dist_l2sq(F.col(v), p)))).drop("__pivots")

    b = written(to_pivots(b, "__b").withColumn("__cell", F.array_position("__to", F.array_min("__to")).cast("int")).withColumn("__r", F.array_min("__to")).drop("__to"))
    cells = small(b.groupBy(*keys, "__cell").agg(F.max("__r").alias("__r")).groupBy(*keys).agg(F.collect_list(F.struct("__cell", "__r")).alias("__cells")))
    nearest = F.array_sort("__to")
    # As many of the pivots as are wanted are this near, so farther cells hold nothing better.
    bound = F.coalesce(F.get(nearest, F.lit(int(mode == "ratio"))), F.lit(float("inf")))

    def reached(c: Column) -> Column:
        to = F.get(F.col("__to"), c["__cell"] - 1)
        return to - c["__r"] <= F.col("__bound") + (to + c["__r"]) * 1e-9

    a = to_pivots(a, "__a").withColumn("__bound", bound).join(cells, keys)
    a = a.withColumn("__cell", F.explode(F.transform(F.filter("__cells", reached), lambda c: c["__cell"]))).drop("__cells", "__to", "__bound")
    # Cells are held against the left side in blocks of both; each gives a left descriptor its best ones.
    parts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(n))
    blocks = small(written(parts(left.where(fit), "__m").join(parts(b, "__n"), keys)))
    a, b = a.join(blocks, keys), b.drop("__r").join(blocks, keys)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    group = [*keys, "__cell", "__i", "__j"]
    a = a.withColumn("__i", part("left_id", "__m")).withColumn("__j", every("__n")).select(*group, "left_id", "__a")
    b = b.withColumn("__j", part("right_id", "__n")).withColumn("__i", every("__m")).select(*group, "right_id", "__b")
    kinds = "".join(f"`{k}` {a.schema[k].dataType.simpleString()}, " for k in keys)
    kinds += f"left_id {a.schema['left_id'].dataType.simpleString()}, right_id {b.schema['right_id'].dataType.simpleString()}, distance double"
    most = 1 + (mode == "ratio")
    rows = a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(lambda x, y: _nearest(x, y, keys, most), kinds)
    if mode == "ratio":
        ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "left_id").orderBy("distance", "right_id"))).where("__rn <= 2")
        best = ranked.groupBy(*keys, "left_id").agg(F.min(F.struct("distance", "right_id")).alias("b"), F.max(F.when(F.col("__rn") == 2, F.col("distance"))).alias("__second"))
        return best.where(F.col("b.distance") < ratio * F.col("__second")).select(*keys, "left_id", "b.right_id", "b.distance")
    best = written(rows.groupBy(*keys, "left_id").agg(F.min(F.struct("distance", "right_id")).alias("b")).select(*keys, "left_id", "b.right_id", "b.distance"))
    least = small(best.groupBy(*keys).agg(F.greatest(factor * F.min("distance"), F.lit(floor)).alias("__most")))
    return best.join(least, keys).where("distance <= __most").select(*best.columns)


def _cubic(t: Column, a: float = -0.75) -> list[Column]:
    """Weights of the four taps around a fraction (Keys' kernel)."""
    near = lambda d: (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = lambda d: a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def gather(src: DataFrame, warp: DataFrame, keys: list[str], rows: int, cols: int, mode: str = "bilinear", border: str = "constant", out: str = "v", values: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Backward warp: for each destination cell the weighted source cells around (sx, sy).

    ``warp``: ``(*keys, dy, dx, sx, sy)``; ``src``: ``(*keys, y, x, v)``.  ``mode``: nearest,
    bilinear or bicubic.  ``border``: cells outside are 0 (constant), taken from the edge
    (replicate), or from the other side in x and the edge in y (wrap).
    ``values``: columns of the source that are all sampled, under their own names, instead of ``v``.
    ``keep``: columns of the warp that come with its cells.  Taps are exploded and fetched by an
    equi join on (key, y, x), those without weight left out; the join is from the warp, so that
    every destination cell comes out.
    """
    named, keep = {c: c for c in values} if values else {out: "v"}, keep or []
    sx, sy = F.col("sx"), F.col("sy")
    if mode == "nearest":
        taps = [(F.floor(sy + 0.5), F.floor(sx + 0.5), F.lit(1.0))]
    else:
        y0, x0 = F.floor(sy), F.floor(sx)
        ty, tx = sy - y0, sx - x0
        wy, wx, first = (_cubic(ty), _cubic(tx), -1) if mode == "bicubic" else ([1 - ty, ty], [1 - tx, tx], 0)
        taps = [(y0 + (first + i), x0 + (first + j), a * b) for i, a in enumerate(wy) for j, b in enumerate(wx)]
    taps = F.explode(F.array(*(F.struct(a.cast("long").alias("y"), b.cast("long").alias("x"), w.cast("double").alias("w")) for a, b, w in taps)))
    cells = warp.withColumn("__t", taps).where(~F.col("__t.w").eqNullSafe(0.0)).select(*keys, "dy", "dx", *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col("__t.y").alias("y"), F.col("__t.x").alias("x"), F.col("__t.w").alias("__w"))
    inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)).cast("long")
    if border != "constant":
        cells = cells.withColumn("y", inside("y", rows)).withColumn("x", F.pmod("x", F.lit(cols)).cast("long") if border == "wrap" else inside("x", cols))
    got = cells.join(src, [*keys, "y", "x"], "left")
    kept = [F.first(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return got.groupBy(*keys, "dy", "dx").agg(*(F.sum(F.col("__w") * F.coalesce(c, F.lit(0.0))).alias(n) for n, c in named.items()), *kept)


def lut_join(df: DataFrame, lut: DataFrame, bin_of: Column) -> DataFrame:
    return df.withColumn("bin", bin_of.cast("long")).join(small(lut), "bin")


#: Columns of a tile, at least.
TILE_COLS = 16


def search_box(hint: str, percent: float) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last row and column offset of a directional search box."""
    dist = int(24 * percent + 50) // 100
    ortho = (dist + 4) // 8
    along = (-dist, 0) if hint in ("left", "up") else (0, dist)
    return ((-ortho, ortho), along) if hint in ("left", "right") else (along, (-ortho, ortho))


def search_box_candidates(grid: DataFrame, src: DataFrame, keys: list[str], hint: str, percent: float) -> DataFrame:
    """Candidate cells of a directional search box around each cell, by an equi join of tiles.

    ``dist = (24 * percent + 50) // 100`` cells along the hint (left, right, up, down) and
    ``(dist + 4) // 8`` to either side.  A tile is a run of cells of one row; the source's has those
    that the box reaches beyond it as well, and goes to each row that reaches its own.  Tiles are
    shuffled, and pairs of cells are formed after the join only.
    """
    (top, bottom), (first, last) = search_box(hint, percent)
    cols = max(TILE_COLS, last - first)
    tile = lambda x: F.floor(x / cols).cast("long")
    cells = F.collect_list(F.struct(F.col("x").cast("long").alias("x"), "v"))
    a = grid.groupBy(*keys, F.col("y").cast("long").alias("y0"), tile(F.col("x")).alias("__t")).agg(cells.alias("__a"))
    b = src.withColumn("__t", F.explode(F.sequence(tile(F.col("x") - last), tile(F.col("x") - first))))
    b = b.groupBy(*keys, F.col("y").cast("long").alias("y"), "__t").agg(cells.alias("__b"))
    b = b.withColumn("oy", F.explode(F.sequence(F.lit(top).cast("long"), F.lit(bottom).cast("long")))).withColumn("y0", F.col("y") - F.col("oy")).drop("y")
    rows = a.join(b, [*keys, "y0", "__t"]).withColumn("__c", F.explode("__a"))
    x0 = F.col("__c.x")
    rows = rows.withColumn("__d", F.explode(F.filter("__b", lambda d: d["x"].between(x0 + first, x0 + last))))
    return rows.select(*keys, "y0", x0.alias("x0"), "oy", (F.col("__d.x") - x0).alias("ox"), F.col("__c.v").alias("v0"), F.col("__d.v").alias("v1"))


def with_reference(patches: DataFrame, reference: DataFrame, illuminant: str, on: str = "patch") -> DataFrame:
    return patches.join(small(reference.where(F.col("illuminant") == illuminant)), on)


def with_isp_config(frames: DataFrame, isp: DataFrame, key: str = "serial") -> DataFrame:
    """Each frame with its sensor's settings; a sensor without any leaves the frame raw."""
    return frames.join(small(isp), key, "left")


def union_keys(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def union_matches(*tables: DataFrame) -> DataFrame:
    """All rows of all matchers, repeated ones included."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
