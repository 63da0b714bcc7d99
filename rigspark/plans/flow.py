"""Dense displacement fields: block match at the coarsest level, refined level by level.

Images are tables of lines, and every step works on bands of rows with halos, which are exchanged
between the steps; the height of an image does not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigspark.operators import bands as BD
from rigspark.scratch import small, spread, written

#: Weights of the error, the step and the difference of the refinement.
SMOOTH, VERTICAL, HORIZONTAL, STEP, PROBE = 0.001, 0.01, 0.01, 0.5, 0.001
#: Factor and least size of the levels; alpha from which a cell is updated.
LEVEL, LEAST, OPAQUE = 0.9, 24, 0.9
#: Width and sigma of the blurs of images, gradients, the field and the end.
IMAGE_BLUR, GRADIENT_BLUR, FIELD_BLUR, END_BLUR = (5, 0.25), (3, 0.5), (15, 8.0), (3, 1.0)
#: Rows of a halo beside those that displacements reach over: all stencils of a level together.
HALO = 16
#: Cells of the bands that a task refines together, about.
RUN_CELLS = 1 << 17

_IMAGES = ["v0", "v1", "a0", "a1"]
_BEFORE = ["motion", "px", "py"]


def blur(a: np.ndarray, kernel: tuple[int, float]) -> np.ndarray:
    """Separable Gaussian, mirrored at the edges without repeating them."""
    k, sigma = kernel
    w = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    for axis in (-2, -1):
        n = a.shape[axis]
        r = min(k // 2, n - 1)
        pad = [(r, r) if i == axis else (0, 0) for i in range(-a.ndim, 0)]
        p = np.pad(a, pad, mode="reflect")
        used = w[k // 2 - r : k // 2 + r + 1]
        a = sum(wt * (p[..., i : i + n, :] if axis == -2 else p[..., i : i + n]) for i, wt in enumerate(used / used.sum()))
    return a


def _rimmed(a: np.ndarray, r: int) -> np.ndarray:
    """Images, alone or in a stack, with ``r`` copies of their edges around them."""
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r)] * 2, mode="edge")


def median5(a: np.ndarray) -> np.ndarray:
    p, (rows, cols) = _rimmed(a, 2), a.shape[-2:]
    squares = np.stack([p[..., i : i + rows, j : j + cols] for i in range(5) for j in range(5)], -1)
    if np.isnan(a).any():
        return np.median(squares, axis=-1)
    squares.partition(12, axis=-1)
    return squares[..., 12]


def box5(a: np.ndarray) -> np.ndarray:
    """Sums over 5 x 5 squares, cut at the edges."""
    c = np.pad(np.cumsum(np.cumsum(np.pad(a, 2), 0), 1), ((1, 0), (1, 0)))
    return c[5:, 5:] - c[:-5, 5:] - c[5:, :-5] + c[:-5, :-5]


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _rimmed(a, 1)
    return blur(p[..., 1:-1, 2:] - p[..., 1:-1, :-2], GRADIENT_BLUR), blur(p[..., 2:, 1:-1] - p[..., :-2, 1:-1], GRADIENT_BLUR)


class Level:
    """What the error of a displacement needs, for bands of one image that have as many rows each, at one level."""

    def __init__(self, bands: list[BD.Band], fx: np.ndarray, fy: np.ndarray) -> None:
        of = lambda c: np.stack([b[c] for b in bands])
        self.first, self.height = np.array([b.first for b in bands])[:, None], bands[0].height
        self.gx0, self.gy0 = gradients(of("v0"))
        self.count, self.rows, self.cols = self.gx0.shape
        self.ahead = [g.ravel() for g in gradients(of("v1"))]
        self.bx, self.by = blur(fx, FIELD_BLUR), blur(fy, FIELD_BLUR)
        self.open = (of("a0") > OPAQUE) & (of("a1") > OPAQUE)
        self.x = np.arange(self.cols, dtype=float)
        self.begin = np.arange(self.count)[:, None] * (self.rows * self.cols)

    def error(self, row: int, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
        """Error of displacements of a row of each band; infinite where they lead beyond the band's halo."""
        x = np.clip(self.x + fx, 0, max(self.cols - 2, 0))
        at = np.clip(row + self.first + fy, 0, max(self.height - 2, 0)) - self.first
        x0, y0 = x.astype(int), np.floor(at).astype(int)
        inside = (y0 >= 0) & (y0 <= self.rows - 2)
        y0 = np.clip(y0, 0, max(self.rows - 2, 0))
        tx, ty = x - x0, at - y0
        right, below = np.minimum(x0 + 1, self.cols - 1) - x0, (np.minimum(y0 + 1, self.rows - 1) - y0) * self.cols
        w00, w01, w10, w11 = (1 - ty) * (1 - tx), (1 - ty) * tx, ty * (1 - tx), ty * tx
        p = self.begin + y0 * self.cols + x0
        q = p + below
        p1, q1 = p + right, q + right
        take = lambda g: g[p] * w00 + g[p1] * w01 + g[q] * w10 + g[q1] * w11
        gx1, gy1 = map(take, self.ahead)
        e = np.hypot(self.gx0[:, row] - gx1, self.gy0[:, row] - gy1) + SMOOTH * np.hypot(self.bx[:, row] - fx, self.by[:, row] - fy)
        return np.where(inside, e + VERTICAL * np.abs(fy) / self.cols + HORIZONTAL * np.abs(fx) / self.height, np.inf)

    def sweep(self, fx: np.ndarray, fy: np.ndarray, forward: bool) -> None:
        """Row by row, each cell takes a neighbour's displacement where that errs less, then a step downhill.

        The row before has its new values already; along a row good values spread by doubling.
        All bands go on by a row at a time.
        """
        rows, back = range(self.rows) if forward else range(self.rows - 1, -1, -1), -1 if forward else 1
        for i in rows:
            open_ = self.open[:, i]
            if not open_.any():
                continue
            u, v = fx[:, i].copy(), fy[:, i].copy()
            e = self.error(i, u, v)

            def propose(pu: np.ndarray, pv: np.ndarray) -> None:
                pe = self.error(i, pu, pv)
                better = open_ & (pe < e)
                u[better], v[better], e[better] = pu[better], pv[better], pe[better]

            if 0 <= i + back < self.rows:
                propose(fx[:, i + back], fy[:, i + back])
            for shift in (1, 2, 4, 8):
                if shift < self.cols:
                    ahead, behind = (slice(shift, None), slice(None, -shift)) if forward else (slice(None, -shift), slice(shift, None))
                    pu, pv = u.copy(), v.copy()
                    pu[:, ahead], pv[:, ahead] = u[:, behind], v[:, behind]
                    propose(pu, pv)
            down = open_ & np.isfinite(e)
            du = (self.error(i, u + PROBE, v) - e)[down] / PROBE
            dv = (self.error(i, u, v + PROBE) - e)[down] / PROBE
            u[down] -= STEP * np.where(np.isfinite(du), du, 0)
            v[down] -= STEP * np.where(np.isfinite(dv), dv, 0)
            fx[:, i], fy[:, i] = u, v


def refined(bands: list[BD.Band], fx: np.ndarray, fy: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of bands after sweeps down and up, each smoothed by a median; faint cells take the blur."""
    level = Level(bands, fx, fy)
    fx, fy = fx.copy(), fy.copy()
    for turn in range(sweeps):
        level.sweep(fx, fy, turn % 2 == 0)
        fx, fy = median5(fx), median5(fy)
    faint = np.stack([1 - b["a0"] * b["a1"] for b in bands])
    return tuple(faint * blur(f, FIELD_BLUR) + (1 - faint) * f for f in (fx, fy))


def search_box(hint: str, percent: float) -> tuple[int, list[tuple[int, int]]]:
    """How far the first search looks, and its displacements ``(dy, dx)``."""
    dist = int(LEAST * percent + 50) // 100
    ortho = (dist + 4) // 8
    along = range(-dist, 1) if hint in ("left", "up") else range(dist + 1)
    across = range(-ortho, ortho + 1)
    return dist, [(c, a) for c in across for a in along] if hint in ("left", "right") else [(a, c) for a in along for c in across]


def first_match(band: BD.Band, ratio: float, hint: str | None, percent: float) -> tuple[np.ndarray, np.ndarray]:
    """First displacements: of the hinted box the one whose 5 x 5 squares differ least; short ones are favoured."""
    fx, fy = np.zeros(band["v0"].shape), np.zeros(band["v0"].shape)
    dist, box = search_box(hint, percent) if hint and percent > 0 else (0, [])
    if not dist:
        return fx, fy
    rows, cols = fx.shape
    y, x = np.arange(rows) + band.first, np.arange(cols)

    def cost(dy: int, dx: int) -> np.ndarray:
        to_y = np.clip(np.clip(y + dy, 0, band.height - 1) - band.first, 0, rows - 1)
        to_x = np.clip(x + dx, 0, cols - 1)
        at = np.ix_(to_y, to_x)
        with np.errstate(divide="ignore", invalid="ignore"):
            sad = box5(np.abs(band["v0"] - ratio * band["v1"][at])) / box5(band["a0"] * band["a1"][at])
        return np.nan_to_num(sad, nan=np.inf) * (1 + np.hypot(dx, dy) / dist)

    best = 0.8 * cost(0, 0)
    for dy, dx in box:
        inside = ((y + dy >= 0) & (y + dy < band.height))[:, None] & ((x + dx >= 0) & (x + dx < cols))
        e = np.where(inside, cost(dy, dx), np.inf)
        better = (e < best) & (band["a0"] > OPAQUE)
        best, fx, fy = np.where(better, e, best), np.where(better, dx, fx), np.where(better, dy, fy)
    return fx, fy


def _next(n: Column) -> Column:
    return F.floor(n * LEVEL + 0.5)


def _is_top() -> Column:
    return F.least(_next(F.col("h")), _next(F.size("v0"))) <= LEAST


def pyramid(rows: DataFrame, keys: list[str], channels: list[str]) -> list[DataFrame]:
    """The levels of image pyramids, largest first: each line table resized from the one before.

    Images may differ in size; a small one is missing from the later levels.
    """
    out, width = [rows], F.size(channels[0])
    while True:
        wide = out[-1].where((_next(F.col("h")) > LEAST) & (_next(width) > LEAST))
        level = written(BD.resized(wide, keys, channels, _next(F.col("h")), _next(width)))
        if not level.limit(1).count():
            return out
        out.append(level)


def _ratio(level: DataFrame, keys: list[str]) -> DataFrame:
    """Intensity of the first image over the second's where both are opaque, by image."""
    total = lambda v: F.sum(F.aggregate(F.zip_with(F.zip_with("a0", "a1", lambda p, q: p * q), v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t))
    sums = level.groupBy(*keys).agg(total("v0").alias("n"), total("v1").alias("d"))
    return sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(F.col("n") / F.nullif("d", F.lit(0.0)), F.lit(1.0)).alias("ratio"))


def step(level: DataFrame, field: DataFrame | None, keys: list[str], hint: str | None, percent: float, sweeps: int = 2) -> DataFrame:
    """Displacements at one level, ``(*keys, y, h, fx, fy)``, from those of the coarser one.

    An image that has no coarser level starts with the block match.  Bands get as many rows
    beyond them as displacements reach, and refinement does not lead a cell beyond these.  A task
    gets a run of bands, of about ``RUN_CELLS`` cells, and refines those of one height together.
    """
    channels = [c for c in (*_IMAGES, *_BEFORE) if c in level.columns]
    reach = 0
    if field is not None:
        most = field.agg(F.max(F.array_max(F.transform("fy", F.abs)))).first()[0]
        reach = int(np.ceil((most or 0.0) / LEVEL)) + 1
    dist = search_box(hint, percent)[0] if hint and percent > 0 else 0
    halo = HALO + max(reach, dist)
    size = max(BD.BAND_ROWS, 2 * halo)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    images = level.join(small(written(_ratio(level.where(_is_top()), keys))), same, "left").select(*keys, "y", "h", *channels, "ratio")
    wide = level.agg(F.max(F.size("v0"))).first()[0] or 1
    most_rows = size * max(1, RUN_CELLS // (size * wide))
    images = BD.to_bands(images, F.col("y") - halo, F.col("y") + halo, "h", most_rows)

    if field is None:
        field = level.sparkSession.createDataFrame([], f"{BD.schema_of(level, keys)}, y long, h_from long, h long, fx array<double>, fy array<double>")
    else:
        sizes = small(level.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.first("h").alias("__h")))
        field = field.join(sizes, same).select(*keys, "y", F.col("h").alias("h_from"), F.col("__h").alias("h"), "fx", "fy")
    low, high = BD.reach(F.col("y"), F.col("h_from"), F.col("h"))
    field = BD.to_bands(field, low - halo, high + halo, "h", most_rows)

    def run(frame: pd.DataFrame, coarse: pd.DataFrame) -> pd.DataFrame:
        whole = BD.band_of(frame, channels, most_rows)
        bands = BD.cut(whole, size, halo)
        if len(coarse):
            coarse = coarse.sort_values("y", ignore_index=True)
            old, y, cols = int(coarse["h_from"][0]), np.arange(len(frame)) + whole.first, whole["v0"].shape[1]
            wide = np.stack(coarse["fx"].to_list())
            grow_x, grow_y = cols / wide.shape[1], whole.height / old
            up = lambda c, by: by * BD.stretched(np.stack(coarse[c].to_list()), int(coarse["y"][0]), old, y, whole.height, cols)
            fx, fy = up("fx", grow_x), up("fy", grow_y)
            begin = [b.first - whole.first for b in bands]
            fields = [(fx[at : at + len(b["v0"])], fy[at : at + len(b["v0"])]) for at, b in zip(begin, bands, strict=True)]
        else:
            ratio = frame["ratio"].iloc[0]
            fields = [first_match(b, 1.0 if pd.isna(ratio) else float(ratio), hint, percent) for b in bands]
        out = [None] * len(bands)
        for rows in {len(b["v0"]) for b in bands}:
            some = [i for i, b in enumerate(bands) if len(b["v0"]) == rows]
            fx, fy = refined([bands[i] for i in some], *(np.stack([fields[i][axis] for i in some]) for axis in (0, 1)), sweeps)
            for i, x, y in zip(some, fx, fy, strict=True):
                band = bands[i]
                if "motion" in band.channels:  # a cell that did not move keeps the last frame's displacement
                    still = 1 - band["motion"]
                    x, y = x * (1 - still) + band["px"] * still, y * (1 - still) + band["py"] * still
                out[i] = x[band.own], y[band.own]
        fx, fy = (np.concatenate(parts) for parts in zip(*out, strict=True))
        return BD.lines_frame(frame, keys, whole.y, {"h": whole.height}, {"fx": fx, "fy": fy})

    kinds = f"{BD.schema_of(level, keys)}, "
    images, field = (spread(rows, *keys, "band") for rows in (images, field))
    return written(images.groupBy(*keys, "band").cogroup(field.groupBy(*keys, "band")).applyInPandas(run, f"{kinds}y long, h long, fx array<double>, fy array<double>"))


def field_levels(rows: DataFrame, keys: list[str], hint: str | None = "right", percent: float = 20.0) -> list[DataFrame]:
    """Displacements at each level of the images' pyramids, the coarsest first.

    ``rows``: lines with ``v0``, ``v1`` and their alphas ``a0``, ``a1``; with ``motion``, ``px`` and
    ``py`` each level is drawn to the last frame's field, ``px, py``, where little moved.
    """
    channels = [c for c in (*_IMAGES, *_BEFORE) if c in rows.columns]
    out: list[DataFrame] = []
    for level in reversed(pyramid(rows, keys, channels)):
        if "px" in channels:  # the last field in cells of this level
            tall = F.first("h").alias("__t")
            full = small(rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(tall, F.first(F.size("v0")).alias("__u")))
            level = level.join(full, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            level = level.withColumns({"px": F.transform("px", lambda v: v * F.size("v0") / F.col("__u")), "py": F.transform("py", lambda v: v * F.col("h") / F.col("__t"))})
            level = level.select(*keys, "y", "h", *channels)
        out.append(step(level, out[-1] if out else None, keys, hint, percent))
    return out


def _blurred(rows: DataFrame, keys: list[str], channels: list[str], kernel: tuple[int, float]) -> DataFrame:
    return BD.banded(rows, keys, channels, kernel[0] // 2, lambda b: {c: blur(b[c], kernel)[b.own] for c in channels}, channels)


def image_lines(a: DataFrame, b: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Lines of two images' cells ``(*keys, y, x, v)``, with an alpha ``a`` or opaque, made smaller and blurred."""
    alpha = lambda df: F.col("a") if "a" in df.columns else F.lit(1.0)
    one = a.select(*keys, "y", "x", F.col("v").alias("v0"), alpha(a).alias("a0"))
    both = one.join(b.select(*keys, "y", "x", F.col("v").alias("v1"), alpha(b).alias("a1")), [*keys, "y", "x"])
    rows = BD.lines(both, keys, _IMAGES)
    if scale != 1:
        rows = BD.resized(rows, keys, _IMAGES, F.greatest(F.floor(F.col("h") * scale), F.lit(1)), F.greatest(F.floor(F.size("v0") * scale), F.lit(1)))
    rows = written(rows.select(*keys, "y", "h", *_IMAGES))
    smooth = _blurred(rows, keys, ["v0", "v1"], IMAGE_BLUR)
    return written(smooth.join(rows.select(*keys, "y", "a0", "a1"), [*keys, "y"]))


def refine_flow(flow: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], sweeps: int = 2) -> DataFrame:
    """Displacements ``(*keys, y, x, fx, fy)`` from ``a`` to ``b`` refined at full size."""
    return BD.cells(step(image_lines(a, b, keys), BD.lines(flow, keys, ["fx", "fy"]), keys, None, 0.0, sweeps), keys, ["fx", "fy"])


def dense_flow(a: DataFrame, b: DataFrame, keys: list[str], hint: str | None = "right", percent: float = 20.0, scale: float = 0.5, previous: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Displacement from ``a`` to ``b``: ``(*keys, y, x, fx, fy)``.

    Images ``(*keys, y, x, v)``, with an alpha ``a`` if they have one, of any sizes; ``keys`` are not
    null and both have the same cells.  They are made smaller by ``scale``; a block match at the
    coarsest level of their pyramids, which looks along ``hint`` (left, right, up, down or None:
    not at all), is refined level by level.  ``previous`` is the last frame's field and ``before``
    its ``b``: where ``b`` did not change, the field stays near the last one.
    """
    rows = image_lines(a, b, keys, scale)
    if previous is not None and before is not None:
        moved = b.select(*keys, "y", "x", "v").join(before.select(*keys, "y", "x", F.col("v").alias("__v")), [*keys, "y", "x"])
        moved = moved.join(previous.select(*keys, "y", "x", "fx", "fy"), [*keys, "y", "x"])
        moved = moved.select(*keys, "y", "x", F.least(F.abs(F.col("v") - F.col("__v")), F.lit(1.0)).alias("motion"), (F.col("fx") * scale).alias("px"), (F.col("fy") * scale).alias("py"))
        last = BD.resized(BD.lines(moved, keys, _BEFORE), keys, _BEFORE, F.greatest(F.floor(F.col("h") * scale), F.lit(1)), F.greatest(F.floor(F.size("px") * scale), F.lit(1)))
        rows = written(rows.join(last.select(*keys, "y", *_BEFORE), [*keys, "y"]))
    field = field_levels(rows, keys, hint, percent)[-1]
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    full = small(a.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w")))
    field = field.join(full, same)
    grow = {"fx": F.transform("fx", lambda v: v * F.col("__w") / F.size("fx")), "fy": F.transform("fy", lambda v: v * F.col("__h") / F.col("h"))}
    field = written(BD.resized(field.withColumns(grow), keys, ["fx", "fy"], F.col("__h"), F.col("__w")).drop("h_from"))
    return BD.cells(_blurred(field, keys, ["fx", "fy"], END_BLUR), keys, ["fx", "fy"])


def warp_error(a: DataFrame, b: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square difference of ``a`` and of ``b`` fetched along the field, by image: ``(*keys, rmse, rmse_still)``.

    ``rmse_still`` is that without displacement.  Cells whose displacement leads outside do not count.
    """
    at = flow.withColumns({"sx": F.col("x") + F.col("fx"), "sy": F.col("y") + F.col("fy")})
    y0, x0 = F.floor("sy"), F.floor("sx")
    ty, tx = F.col("sy") - y0, F.col("sx") - x0
    taps = F.array(*(F.struct((y0 + i).alias("y"), (x0 + j).alias("x"), ((ty if i else 1 - ty) * (tx if j else 1 - tx)).alias("w")) for i in (0, 1) for j in (0, 1)))
    taps = F.filter(taps, lambda t: t["w"] > 0)
    rows = at.select(*keys, F.col("y").alias("cy"), F.col("x").alias("cx"), F.size(taps).alias("n"), F.explode(taps).alias("t"))
    rows = rows.select(*keys, "cy", "cx", "n", F.col("t.y").cast("long").alias("y"), F.col("t.x").cast("long").alias("x"), "t.w")
    got = rows.join(b.select(*keys, "y", "x", "v"), [*keys, "y", "x"]).groupBy(*keys, "cy", "cx", "n").agg(F.sum(F.col("w") * F.col("v")).alias("w1"), F.count(F.lit(1)).alias("m")).where("m = n")
    both = got.select(*keys, F.col("cy").alias("y"), F.col("cx").alias("x"), "w1").join(a.select(*keys, "y", "x", F.col("v").alias("v0")), [*keys, "y", "x"]).join(b.select(*keys, "y", "x", F.col("v").alias("v1")), [*keys, "y", "x"])
    return both.groupBy(*keys).agg(F.sqrt(F.avg((F.col("v0") - F.col("w1")) ** 2)).alias("rmse"), F.sqrt(F.avg((F.col("v0") - F.col("v1")) ** 2)).alias("rmse_still"))
