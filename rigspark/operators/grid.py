"""Stencils, filters and components on long-form grids ``(keys, y, x, v)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.functions.scalars import lerp
from rigspark.scratch import small, written


def _axis(keys: list[str], line: str, pos: str) -> Window:
    return Window.partitionBy(*keys, line).orderBy(pos)


def box(df: DataFrame, keys: list[str], r: int, f, v: str = "v", out: str | None = None) -> DataFrame:
    """``f`` over the (2r+1) square around each cell, first along x, then along y."""
    out = out or v
    wx = _axis(keys, "y", "x").rangeBetween(-r, r)
    wy = _axis(keys, "x", "y").rangeBetween(-r, r)
    return df.withColumn("__h", f(v).over(wx)).withColumn(out, f("__h").over(wy)).drop("__h")


def dilate(df: DataFrame, keys: list[str], r: int, v: str = "v", cross: bool = False) -> DataFrame:
    """Largest value of the square, or of the cross, around each cell."""
    if cross:
        return df.withColumn(v, F.greatest(F.max(v).over(_axis(keys, "y", "x").rangeBetween(-r, r)), F.max(v).over(_axis(keys, "x", "y").rangeBetween(-r, r))))
    return box(df, keys, r, F.max, v)


def erode(df: DataFrame, keys: list[str], r: int, v: str = "v", cross: bool = False) -> DataFrame:
    if cross:
        return df.withColumn(v, F.least(F.min(v).over(_axis(keys, "y", "x").rangeBetween(-r, r)), F.min(v).over(_axis(keys, "x", "y").rangeBetween(-r, r))))
    return box(df, keys, r, F.min, v)


def close_gaps(df: DataFrame, keys: list[str], r: int, v: str = "v") -> DataFrame:
    return erode(dilate(df, keys, r, v), keys, r, v)


def gaussian_weights(k: int, sigma: float) -> list[float]:
    w = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [x / sum(w) for x in w]


def _reflected_tap(v: str, w, pos: str, n: Column, offset: int) -> Column:
    """The value ``offset`` cells away on the line, mirrored at the border cells (reflect-101)."""
    direct = F.lag(v, -offset).over(w) if offset < 0 else F.lead(v, offset).over(w)
    if offset == 0:
        return F.col(v)
    # Mirrored place minus own place depends on the place only near the border.
    out = direct
    for edge in range(abs(offset)):
        if offset < 0:
            shift = (-offset) - 2 * edge
            tap = F.lead(v, shift).over(w) if shift > 0 else F.lag(v, -shift).over(w) if shift < 0 else F.col(v)
            out = F.when(F.col(pos) == edge, tap).otherwise(out)
        else:
            shift = offset - 2 * edge
            tap = F.lag(v, shift).over(w) if shift > 0 else F.lead(v, -shift).over(w) if shift < 0 else F.col(v)
            out = F.when(F.col(pos) == n - 1 - edge, tap).otherwise(out)
    return out


def gaussian(df: DataFrame, keys: list[str], k: int, sigma: float, v: str = "v", out: str | None = None) -> DataFrame:
    """Separable blur with mirrored borders; lines must be longer than half the kernel."""
    weights, out = gaussian_weights(k, sigma), out or v
    for line, pos, source, target in (("y", "x", v, "__h"), ("x", "y", "__h", out)):
        w = _axis(keys, line, pos)
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys, line))
        taps = [weight * _reflected_tap(source, w, pos, n, i - k // 2) for i, weight in enumerate(weights)]
        df = df.withColumn(target, sum(taps[1:], taps[0]))
    return df.drop("__h")


def feather(df: DataFrame, keys: list[str], n: int, v: str = "v") -> DataFrame:
    """Alpha drawn in by a cross and blurred."""
    return gaussian(erode(df, keys, n, v, cross=True), keys, 2 * n + 1, n / 2, v)


def adaptive_threshold(df: DataFrame, keys: list[str], block: int = 19, c: float = 2.0, v: str = "v") -> DataFrame:
    """1 where a cell is not above its neighbourhood's mean less ``c``; the square is cut at borders."""
    r = block // 2
    out = box(box(df.withColumn("__one", F.lit(1.0)), keys, r, F.sum, v, "__sum"), keys, r, F.sum, "__one", "__n")
    return out.withColumn("mask", F.when(F.col(v) > F.col("__sum") / F.col("__n") - c, 0).otherwise(1)).drop("__one", "__sum", "__n")


def gradients(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Central differences gx, gy with replicated borders."""
    for name, line, pos in (("gx", "y", "x"), ("gy", "x", "y")):
        w = _axis(keys, line, pos)
        df = df.withColumn(name, F.coalesce(F.lead(v).over(w), F.col(v)) - F.coalesce(F.lag(v).over(w), F.col(v)))
    return df


def iir_lowpass(df: DataFrame, keys: list[str], line: str, pos: str, v: str, amount: float, boundary: str = "reflect", limit: tuple[float, float] | None = None) -> DataFrame:
    """Recursive low-pass along an axis, forward then backward, in time linear in a line's length.

    ``alpha = amount ** 0.25``.  The border is mirrored or wrapped by one cell; a line of one cell stays.
    """
    alpha = amount**0.25
    rows = df.groupBy(*keys, line).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(v).cast("double").alias("v")))), lambda s: s["v"]).alias("a"))

    def run(frames):
        for frame in frames:
            out = [None] * len(frame)
            for n, at in frame.groupby(frame["a"].map(len)).indices.items():
                for i, smooth in zip(at, lowpass(np.stack(frame["a"].iloc[at].to_list()), alpha, boundary), strict=True):
                    out[i] = smooth
            frame["a"] = out
            yield frame

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, line])
    out = rows.mapInPandas(run, f"{kinds}, a array<double>").select(*keys, line, F.posexplode("a").alias(pos, "lp"))
    if limit:
        out = out.withColumn("lp", F.least(F.greatest(F.col("lp"), F.lit(limit[0])), F.lit(limit[1])))
    return out.withColumn(pos, F.col(pos).cast(df.schema[pos].dataType))


#: Cells of a line that one run of the recursion passes over one by one.
SCAN_CELLS = 512


def scanned(x: np.ndarray, seed: np.ndarray, alpha: float) -> np.ndarray:
    """``s[i] = alpha * s[i - 1] + x[i]`` along each row, ``s[-1]`` being its seed, in linear time.

    What a block of cells does to the state is a factor and an offset: blocks run side by side
    from zero, the same recursion over their offsets gives the state before each, and this is
    added with its factor.
    """
    rows, n = x.shape
    if n <= SCAN_CELLS:
        out, state = np.empty_like(x), seed
        for i in range(n):
            state = alpha * state + x[:, i]
            out[:, i] = state
        return out
    blocks = -(-n // SCAN_CELLS)
    padded = np.zeros((rows, blocks * SCAN_CELLS))
    padded[:, :n] = x
    local = scanned(padded.reshape(rows * blocks, SCAN_CELLS), np.zeros(rows * blocks), alpha).reshape(rows, blocks, SCAN_CELLS)
    ends = scanned(local[:, :, -1], seed, alpha**SCAN_CELLS)
    before = np.concatenate([seed[:, None], ends[:, :-1]], 1)
    return (local + before[:, :, None] * alpha ** np.arange(1, SCAN_CELLS + 1)).reshape(rows, -1)[:, :n]


def lowpass(a: np.ndarray, alpha: float, boundary: str) -> np.ndarray:
    """Recursive low-pass of rows, forward then backward, mirrored or wrapped by one cell."""
    n = a.shape[1]
    if n < 2:
        return a.copy()
    after = a[:, :1] if boundary == "wrap" else a[:, -2:-1]
    buffer = scanned((1 - alpha) * np.concatenate([a[:, 1:], after], 1), a[:, 0], alpha)
    before = buffer[:, -1:] if boundary == "wrap" else buffer[:, 1:2]
    back = np.concatenate([buffer[:, -2::-1], before], 1)
    return scanned((1 - alpha) * back, buffer[:, -1], alpha)[:, ::-1]


def sharpen(df: DataFrame, lp: DataFrame, on: list[str], amount: float, core: float = 100.0, v: str = "v", limit: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Low-pass plus cored high-pass times the gain."""
    rows = df.join(lp, on)
    hp = F.col(v) - F.col("lp")
    return rows.withColumn(v, F.least(F.greatest(F.col("lp") + hp * (1 - F.exp(-hp * hp * core)) * amount, F.lit(limit[0])), F.lit(limit[1]))).drop("lp")


def neighbours(df: DataFrame, keys: list[str], r: int | Column, v: str = "v", step: int = 1) -> DataFrame:
    """Each cell with the cells of its square that exist: ``(*keys, y, x, nv)``.

    The radius may be a column, the same for all cells of a key.
    """
    r = r if isinstance(r, Column) else F.lit(r)
    off = F.explode(F.sequence(-F.col("__r"), F.col("__r"), F.lit(step)))
    moved = df.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(v).alias("nv"), r.alias("__r")).withColumn("__dy", off).withColumn("__dx", off)
    moved = moved.select(*keys, (F.col("ny") - F.col("__dy")).alias("y"), (F.col("nx") - F.col("__dx")).alias("x"), "nv")
    return moved.join(df.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def median_filter(df: DataFrame, keys: list[str], r: int = 2, v: str = "v") -> DataFrame:
    """Floor-index median of the square around each cell, cut at the borders."""
    got = neighbours(df, keys, r, v).groupBy(*keys, "y", "x").agg(F.sort_array(F.collect_list("nv")).alias("a"))
    return got.select(*keys, "y", "x", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias(v))


def repair_stuck(df: DataFrame, keys: list[str], threshold: int | Column = 1, darkness: float | Column = 0.2, r: int | Column = 2, v: str = "v") -> DataFrame:
    """Pixels among the top ``threshold`` of a dark same-color neighbourhood become its median.

    Cells two apart share their color in the mosaic.  The settings may be columns, so that each
    key has its own.
    """
    near = neighbours(df, keys, r, v, step=2).groupBy(*keys, "y", "x").agg(F.sort_array(F.collect_list("nv")).alias("a"), F.avg("nv").alias("m"))
    rows = df.join(near, [*keys, "y", "x"])
    rank = F.size(F.filter("a", lambda q: q > F.col(v)))
    median = F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int"))
    return rows.withColumn(v, F.when((F.col("m") < darkness) & (rank < threshold), median).otherwise(F.col(v))).drop("a", "m")


def demosaic_bilinear(df: DataFrame, keys: list[str], pattern: str | Column = "GBRG", v: str = "v") -> DataFrame:
    """Red, green and blue of each mosaic cell: the mean of that color's cells in the 3 x 3 square.

    Own values stay; cells at the border use the neighbours they have.
    """
    from rigspark.functions.scalars import bayer_channel

    cells = df.withColumn("ch", bayer_channel("y", "x", pattern))
    off = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    moved = cells.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("ch").alias("nch"), F.col(v).alias("nv")).withColumn("__dy", off).withColumn("__dx", off)
    moved = moved.select(*keys, (F.col("ny") - F.col("__dy")).alias("y"), (F.col("nx") - F.col("__dx")).alias("x"), "nch", "nv", (F.abs("__dy") + F.abs("__dx")).alias("d"))
    near = moved.join(cells.select(*keys, "y", "x", "ch"), [*keys, "y", "x"])
    # Green at a red or blue cell takes the four beside it, not the corners.
    usable = (F.col("nch") != 1) | (F.col("d") <= 1)
    def color(c: int) -> Column:
        mean = F.avg(F.when((F.col("nch") == c) & usable & (F.col("d") > 0), F.col("nv")))
        own = F.max(F.when((F.col("d") == 0) & (F.col("nch") == c), F.col("nv")))
        return F.coalesce(own, mean)
    return near.groupBy(*keys, "y", "x").agg(*(color(c).alias(n) for c, n in enumerate("rgb")))


def bin_down(df: DataFrame, keys: list[str], r: int, v: str = "v") -> DataFrame:
    """Mosaic made r times smaller: the mean of the r x r cells of the same color phase."""
    y, x = F.col("y"), F.col("x")
    by, bx = F.floor(F.floor(y / 2) / r), F.floor(F.floor(x / 2) / r)
    return df.groupBy(*keys, (by * 2 + y % 2).cast("long").alias("y"), (bx * 2 + x % 2).cast("long").alias("x")).agg(F.avg(v).alias(v))


def diffuse_low_confidence(df: DataFrame, keys: list[str], a0: str, a1: str, k: int = 5, sigma: float = 1.0, v: str = "v") -> DataFrame:
    """The value drawn to its blur where the alphas are low."""
    rows = gaussian(df, keys, k, sigma, v, "__blur")
    return rows.withColumn(v, lerp(v, "__blur", 1 - F.col(a0) * F.col(a1))).drop("__blur")


def pyramid_sizes(rows: int, cols: int, scale: float = 0.9, least: int = 24) -> list[tuple[int, int]]:
    """Sizes of the levels, largest first."""
    out = [(rows, cols)]
    while min(size := tuple(int(n * scale + 0.5) for n in out[-1])) > least:
        out.append(size)
    return out


def resize(df: DataFrame, keys: list[str], rows: int, cols: int, new_rows: int, new_cols: int, v: str = "v") -> DataFrame:
    """Bilinear samples at the centres of the new cells, edges replicated."""
    from rigspark.operators.joins import gather

    cells = df.select(*keys).distinct().withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(new_rows - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(new_cols - 1))))
    warp = cells.withColumn("sy", (F.col("dy") + 0.5) * (rows / new_rows) - 0.5).withColumn("sx", (F.col("dx") + 0.5) * (cols / new_cols) - 0.5)
    src = df.select(*keys, "y", "x", F.col(v).alias("v"))
    return gather(src, warp, keys, rows, cols, "bilinear", "replicate").select(*keys, F.col("dy").cast("long").alias("y"), F.col("dx").cast("long").alias("x"), F.col("v").alias(v))


def splat(df: DataFrame, keys: list[str], x: str, v: str) -> DataFrame:
    """Values given to the two cells around a place by weight, and summed: ``(*keys, cell, v)``."""
    x0 = F.floor(x)
    t = F.col(x) - x0
    taps = F.explode(F.array(F.struct(x0.alias("cell"), (F.col(v) * (1 - t)).alias("w")), F.struct((x0 + 1).alias("cell"), (F.col(v) * t).alias("w"))))
    return df.withColumn("__t", taps).groupBy(*keys, F.col("__t.cell").cast("long").alias("cell")).agg(F.sum("__t.w").alias("v"))


def bisplat(df: DataFrame, keys: list[str], y: str, x: str, v: str) -> DataFrame:
    """The same in two dimensions, over four cells."""
    y0, x0 = F.floor(y), F.floor(x)
    ty, tx = F.col(y) - y0, F.col(x) - x0
    taps = [(y0 + i, x0 + j, (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i in (0, 1) for j in (0, 1)]
    e = F.explode(F.array(*(F.struct(a.cast("long").alias("y"), b.cast("long").alias("x"), (w * F.col(v)).alias("w")) for a, b, w in taps)))
    return df.select(*keys, e.alias("__t")).groupBy(*keys, F.col("__t.y").alias("y"), F.col("__t.x").alias("x")).agg(F.sum("__t.w").alias("v"))


def wrap_shift(df: DataFrame, cols: int, offset: int, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.pmod(F.col(x) + offset, F.lit(cols)).cast("long"))


def wrap_extend(df: DataFrame, cols: int, share: float, x: str = "x") -> DataFrame:
    """Rows continued past their end by a share of themselves."""
    more = int(cols * share)
    return df.unionByName(df.where(F.col(x) < more).withColumn(x, F.col(x) + cols))


def flip(df: DataFrame, n: int, axis: str) -> DataFrame:
    return df.withColumn(axis, n - 1 - F.col(axis))


def pad_rows(df: DataFrame, keys: list[str], rows: int, height: int, cols: int) -> DataFrame:
    """The image in the middle of ``height`` rows, 0 above and below."""
    top = (height - rows) // 2
    cells = df.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    cells = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    moved = df.withColumn("y", F.col("y") + top)
    return cells.join(moved, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def stack(df: DataFrame, group: list[str], order: str, sizes: DataFrame, axis: str = "x") -> DataFrame:
    """Images of a group side by side (x) or one below the other (y).

    ``sizes``: ``(*group, order, size)``; the running sum of the sizes before gives the offset.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("__at", F.coalesce(F.sum("size").over(w), F.lit(0))).drop("size")
    return df.join(small(at), [*group, order]).withColumn(axis, F.col(axis) + F.col("__at")).drop("__at", order)


#: Place (row, column) of each face in the video layout, and order in the photo one.
CUBE_VIDEO = {"left": (0, 0), "right": (0, 1), "top": (0, 2), "bottom": (1, 0), "back": (1, 1), "front": (1, 2)}
CUBE_PHOTO = ("right", "left", "top", "bottom", "back", "front")


def cube_layout(faces: DataFrame, size: int, layout: str = "video", face: str = "face") -> DataFrame:
    """One image of the six faces: 2 x 3 and mirrored for video, one below the other for photos."""
    f = F.col(face)
    if layout == "photo":
        at = sum((F.when(f == name, i).otherwise(0) for i, name in enumerate(CUBE_PHOTO)), F.lit(0))
        return faces.withColumn("y", F.col("y") + at * size).drop(face)
    row = sum((F.when(f == name, r).otherwise(0) for name, (r, _) in CUBE_VIDEO.items()), F.lit(0))
    col = sum((F.when(f == name, c).otherwise(0) for name, (_, c) in CUBE_VIDEO.items()), F.lit(0))
    return faces.withColumn("x", size - 1 - F.col("x") + col * size).withColumn("y", F.col("y") + row * size).drop(face)


#: Rows and columns of a tile of cells that one task labels at a time.
LABEL_TILE = 256


def _first_cells(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a tile row and column of the first cell, in reading order, that it hangs together with in the tile."""
    from rigspark.operators.graph import roots

    y, x = tile["y"].to_numpy(np.int64), tile["x"].to_numpy(np.int64)
    wide = LABEL_TILE + 2
    spots, own = np.unique((y % LABEL_TILE + 1) * wide + x % LABEL_TILE + 1, return_inverse=True)
    at = np.full(wide * wide, -1)
    at[spots] = np.arange(len(spots))
    ahead = [(i, at[spots + step]) for step in (1, wide - 1, wide, wide + 1) for i in [np.arange(len(spots))]]
    u, v = (np.concatenate(part) for part in zip(*((j[j >= 0], i[j >= 0]) for i, j in ahead), strict=True))
    first = spots[roots(len(spots), u, v)][own]
    return first // wide - 1 + y // LABEL_TILE * LABEL_TILE, first % wide - 1 + x // LABEL_TILE * LABEL_TILE


def label_grid(mask: DataFrame, keys: list[str]) -> DataFrame:
    """8-neighbour components of the cells with mask 1: ``(*keys, y, x, label)``.

    Tiles of cells are labelled each by itself; only cells on the edges of tiles meet those beyond
    by an equi join, and the components of the labels that they link are those of the graph.  A
    label is the number of the component's first cell in reading order.  Cells without a row, a
    column or a key go.
    """
    from rigspark.operators.bands import schema_of
    from rigspark.operators.graph import connected_components

    names = [*keys, "y", "x"]
    cells = mask.where("mask = 1").select(*names).dropna()
    tile = lambda c: F.floor(F.col(c) / LABEL_TILE)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first_y, first_x = _first_cells(frame)
        return frame[names].assign(__fy=first_y, __fx=first_x)

    dealt = cells.groupBy(*keys, tile("y").alias("__ty"), tile("x").alias("__tx"))
    found = written(dealt.applyInPandas(run, f"{schema_of(cells, names)}, __fy long, __fx long"))
    node = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lpad(F.col("__fy").cast("string"), 8, "0"), F.lpad(F.col("__fx").cast("string"), 8, "0"))
    on_edge = sum((F.pmod(c, F.lit(LABEL_TILE)).isin(0, LABEL_TILE - 1).cast("int") for c in ("y", "x")), F.lit(0)) > 0
    edge = found.where(on_edge).select(*names, node.alias("dst"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    moved = edge.withColumnsRenamed({"y": "__y", "x": "__x", "dst": "src"}).withColumn("s", F.explode(steps)).withColumns({"y": F.col("__y") + F.col("s.a"), "x": F.col("__x") + F.col("s.b")})
    beyond = moved.where((tile("y") != tile("__y")) | (tile("x") != tile("__x"))).select(*names, "src")
    joined = small(written(connected_components(beyond.join(edge, names).select("src", "dst").distinct()))).withColumnsRenamed({"component": "label"})
    return found.withColumn("node", node).join(joined, "node", "left").select(*names, F.coalesce("label", "node").alias("label"))


def drop_small(labels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Cells of components with at least ``least`` cells."""
    kept = labels.groupBy(*keys, "label").count().where(F.col("count") >= least).drop("count")
    return labels.join(kept, [*keys, "label"], "left_semi")


#: Rows and columns of a tile of cells that are matched in one task, at least.
MATCH_TILE = 64


def block_match(a: DataFrame, b: DataFrame, keys: list[str], hint: str, percent: float, patch: int = 2, affinity: float = 0.8) -> DataFrame:
    """First displacement of each cell: the candidate whose 5 x 5 squares differ least.

    The sum of absolute differences is divided by the cells compared and grows with the length
    by ``1 + length / dist``; zero displacement has its error times ``affinity``.  Of equals the
    shortest along y, then along x.  A null value is compared with nothing; a cell has one row.

    Plan: cells are dealt in tiles with those that their squares and moves reach, and a task
    compares a tile for one move after the other, so what is shuffled is little more than both images.
    """
    from rigspark.operators.joins import search_box

    dist = max(1, int(24 * percent + 50) // 100)
    (top, bottom), (first, last) = search_box(hint, percent)
    moves = [(oy, ox) for oy in range(top, bottom + 1) for ox in range(first, last + 1)]
    # Least error, then least abs(oy), abs(ox), oy, ox: the first of equals in this order.
    moves.sort(key=lambda m: (abs(m[0]), abs(m[1]), m))
    reach_y, reach_x = max(-top, bottom), max(-first, last)
    rows, cols = max(MATCH_TILE, reach_y), max(MATCH_TILE, reach_x)
    kinds = "".join(f"`{k}` {a.schema[k].dataType.simpleString()}, " for k in keys)

    def dealt(df: DataFrame, side: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
        """Copies of the cells for all tiles that they lie in or are reached from."""
        tiles = lambda c, n, up, down: F.explode(F.sequence(F.floor((F.col(c) - up) / n), F.floor((F.col(c) - down) / n)))
        df = df.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), F.lit(side).alias("side"), F.col("v").isNotNull().alias("known")).dropna(subset=[*keys, "y", "x"])
        return df.withColumn("ty", tiles("y", rows, high[0], low[0])).withColumn("tx", tiles("x", cols, high[1], low[1]))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(frame["ty"].iloc[0]) * rows - reach_y - patch, int(frame["tx"].iloc[0]) * cols - reach_x - patch
        side, y, x, v = (frame[c].to_numpy() for c in ("side", "y", "x", "v"))
        shape = 2, rows + 2 * (reach_y + patch), cols + 2 * (reach_x + patch)
        there, value = np.zeros(shape, bool), np.zeros(shape)
        there[side, y - y0, x - x0], value[side, y - y0, x - x0] = frame["known"].to_numpy(bool), v
        own = (side == 0) & (y // rows == frame["ty"].iloc[0]) & (x // cols == frame["tx"].iloc[0])
        y, x = y[own], x[own]
        at = y - y0 - reach_y - patch, x - x0 - reach_x - patch
        best, error, move = np.full(len(y), np.inf), np.full(len(y), np.nan), np.full(len(y), -1)
        high, wide = rows + 2 * patch, cols + 2 * patch
        for i, (oy, ox) in enumerate(moves):
            one, two = ((s, slice(reach_y + dy, reach_y + dy + high), slice(reach_x + dx, reach_x + dx + wide)) for s, dy, dx in ((0, 0, 0), (1, oy, ox)))
            known = there[one] & there[two]
            d = np.where(known, np.abs(value[one] - value[two]), 0.0)
            square = [(slice(dy, dy + rows), slice(dx, dx + cols)) for dy in range(2 * patch + 1) for dx in range(2 * patch + 1)]
            total, n = sum(d[s] for s in square)[at], sum(known[s].astype(int) for s in square)[at]
            length = math.hypot(oy, ox)
            own = np.round(total / np.maximum(n, 1) * (1 + length / dist) * (affinity if length == 0 else 1.0), 9)
            better = (n > 0) & ((own < best) | (move < 0))
            best, error, move = np.where(better & (own == own), own, best), np.where(better, own, error), np.where(better, i, move)
        found = move >= 0
        taken = np.array(moves, np.int64).reshape(-1, 2)[move[found]]
        out = {k: [frame[k].iloc[0]] * int(found.sum()) for k in keys}
        return pd.DataFrame(out | {"y": y[found], "x": x[found], "fx": taken[:, 1], "fy": taken[:, 0], "error": error[found]})

    both = dealt(a, 0, (-patch, -patch), (patch, patch)).unionByName(dealt(b, 1, (top - patch, first - patch), (bottom + patch, last + patch)))
    return both.groupBy(*keys, "ty", "tx").applyInPandas(run, f"{kinds}y long, x long, fx long, fy long, error double")


#: Rows of the vote's square, and the votes from which a cell is filled along its row.
VOTE_REACH, VOTES = 4, 40
#: Where a color's differences to green are taken from, ``(dy, dx)``, each with equal
#: weight: at its own cells, at those of the other color, and at green cells beside and below it
#: (there one tap counts twice and its mirror image not at all).
OWN_TAPS = ((0, 0), (-2, 0), (2, 0), (0, -2), (0, 2))
CORNER_TAPS = ((-1, -1), (1, -1), (-1, 1), (1, 1))
BESIDE_TAPS = ((-2, -1), (0, -1), (2, -1), (-2, 1), (0, 1), (2, 1))
ABOVE_TAPS = ((-1, -2), (-1, 0), (-1, 2), (1, -2), (1, 2), (1, 2))


def _edge_aware(mosaic, channel):
    """Red, green and blue of a mosaic: green along the direction that most of the square finds calmer.

    ``channel``: the color of each cell.  Borders are mirrored, so colors keep their places.
    """
    def at(a, dy, dx, n=2):
        p = np.pad(a, n, mode="reflect")
        return p[n + dy : n + dy + a.shape[0], n + dx : n + dx + a.shape[1]]

    green = channel == 1
    fills, changes = [], []
    for dy, dx in ((1, 0), (0, 1)):
        one, two = (at(mosaic, -dy, -dx), at(mosaic, dy, dx)), (at(mosaic, -2 * dy, -2 * dx), at(mosaic, 2 * dy, 2 * dx))
        bend = 2 * mosaic - two[0] - two[1]
        fills.append(np.where(green, mosaic, (one[0] + one[1]) / 2 + bend / 4))
        own = (np.abs(two[1] - mosaic) + np.abs(mosaic - two[0])) / 2
        changes.append(np.where(green, own, np.abs(one[0] - one[1]) / 2 + np.abs(bend) / 2))
    # At least as calm along the row, counted in the square.
    calm = np.pad((changes[1] <= changes[0]).astype(int), VOTE_REACH, mode="reflect")
    sums, k = np.pad(np.cumsum(np.cumsum(calm, 0), 1), ((1, 0), (1, 0))), 2 * VOTE_REACH + 1
    votes = sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]
    g = np.where(votes < VOTES, fills[0], fills[1])

    out = []
    for color, other in ((0, 2), (2, 0)):
        diff = np.where(channel == color, mosaic - g, 0.0)
        mean = lambda taps: sum(at(diff, dy, dx) for dy, dx in taps) / len(taps)
        beside = (at(channel, 0, -1) == color) | (at(channel, 0, 1) == color)
        at_green = np.where(beside, mean(BESIDE_TAPS), mean(ABOVE_TAPS))
        out.append(g + np.where(channel == color, mean(OWN_TAPS), np.where(channel == other, mean(CORNER_TAPS), at_green)))
    return out[0], g, out[1]


def complete(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Images with a 0 for each missing cell."""
    sizes = df.groupBy(*keys).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"), F.count(F.lit(1)).alias("__n"))
    holes = written(sizes.where("__n <> __h * __w"))
    if not holes.limit(1).count():
        return df
    cells = holes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__h") - 1)).alias("y"), "__w").select(*keys, "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__w") - 1)).alias("x"))
    missing = cells.join(df.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    return df.select(*keys, "y", "x", v).unionByName(missing.withColumn(v, F.lit(0.0)))


def demosaic_edge_aware(df: DataFrame, keys: list[str], pattern: str = "GBRG") -> DataFrame:
    """Red, green and blue of mosaics ``(*keys, y, x, v)``, green along the calmer direction.

    Each cell's change along its column and row is that of green and of the bend of its own color;
    the direction is the row unless fewer than :data:`VOTES` cells of the 9 x 9 square are as calm
    along it.  Red and blue follow the mean of their differences to green.  Missing cells count as
    0, borders are mirrored.

    Plan: images are dealt in bands of rows with a halo of eight, so no task holds an image.
    """
    from rigspark.functions.scalars import BAYER
    from rigspark.operators import bands as BD

    table = np.array(BAYER[pattern]).reshape(2, 2)

    def run(band: BD.Band) -> dict:
        v = band["v"]
        yy, xx = np.indices(v.shape)
        colors = _edge_aware(v, table[(yy + band.first) % 2, xx % 2])
        return {n: c[band.own] for n, c in zip("rgb", colors, strict=True)}

    rows = BD.lines(complete(df.select(*keys, "y", "x", "v"), keys), keys, ["v"])
    return BD.cells(BD.banded(rows, keys, ["v"], 8, run, list("rgb")), keys, list("rgb"))
