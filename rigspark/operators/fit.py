"""Least-squares fits whose sums are Spark aggregations and whose small systems are solved apart."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigspark.functions import camera as C
from rigspark.scratch import small, written


def normal_sums(df: DataFrame, keys: list[str], xs: list[Column], ys: list[Column]) -> DataFrame:
    """Per group ``n``, ``xx`` (upper triangle of X'X, row by row) and ``xy`` (X'Y, row by row)."""
    xx = [F.sum(xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]
    xy = [F.sum(x * y) for x in xs for y in ys]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))


def _square(xx: list[float], d: int) -> np.ndarray:
    a = np.zeros((d, d))
    a[np.triu_indices(d)] = xx
    return a + np.triu(a, 1).T


def linreg_gd(df: DataFrame, xs: list[str], ys: list[str], iters: int = 1000, step: float = 0.1) -> np.ndarray:
    """Linear regression by descent from zero with a fixed step; rows of the result: xs, intercept.

    One pass gives X'X, X'Y and n; every step uses these alone, so the iterates are those of a
    pass over the data per step.  No rows give zeros.
    """
    cols = [F.col(c).cast("double") for c in xs] + [F.lit(1.0)]
    got = normal_sums(df, [], cols, [F.col(c).cast("double") for c in ys]).first()
    m = np.zeros((len(cols), len(ys)))
    if not got or not got.n:
        return m
    xx, xy = _square(got.xx, len(cols)) / got.n, np.array(got.xy).reshape(len(cols), len(ys)) / got.n
    for _ in range(iters):
        m -= step * (xx @ m - xy)
    return m


def linreg_apply(df: DataFrame, xs: list[str], m: np.ndarray, names: list[str]) -> DataFrame:
    for j, name in enumerate(names):
        df = df.withColumn(name, sum((F.col(c) * float(m[i, j]) for i, c in enumerate(xs)), F.lit(float(m[-1, j]))))
    return df


def _inverse3(m) -> list[list[Column]]:
    """Inverse of a 3 x 3 matrix of columns; null where it is singular."""
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = F.nullif(m[0][0] * cof(0, 0) + m[0][1] * cof(0, 1) + m[0][2] * cof(0, 2), F.lit(0.0))
    return [[cof(j, i) / det for j in range(3)] for i in range(3)]


def decompose_color(m) -> tuple[list[Column], list[list[Column]]]:
    """A fitted 3 x 3 as white balance gains and a matrix whose first row sums to 1.

    ``b`` solves m b = 1; gain i is max(b) / b_i; column i of m is divided by its gain.
    """
    inv = _inverse3(m)
    b = [inv[i][0] + inv[i][1] + inv[i][2] for i in range(3)]
    gains = [F.greatest(*b) / x for x in b]
    ccm = [[m[i][j] / gains[j] for j in range(3)] for i in range(3)]
    total = ccm[0][0] + ccm[0][1] + ccm[0][2]
    return gains, [[v / total for v in row] for row in ccm]


#: Observations of a point that one row holds; points with more are fitted by sums over their rows.
MOST_SEEN = 1024
#: A system whose determinant is below this share of its mean diagonal's cube is not solvable: what
#: is left of it, as where one camera sees a point, is rounding.
SINGULAR = 1e-13
#: Observations that a task works on at a time.
SEEN_AT_ONCE = 100_000
#: A camera's columns and how many numbers each holds.
_CAMERA = (("origin", 3), ("right", 3), ("up", 3), ("forward", 3), ("principal", 2), ("focal", 2), ("distortion", 2))


def _packed() -> Column:
    """An observation as one array: pixel, whether the lens is flat, the camera's numbers; NaN for null."""
    own = F.array(F.col("px").cast("double"), F.col("py").cast("double"), F.when(F.col("type") == "FTHETA", 0.0).otherwise(1.0))
    width = 3 + sum(n for _, n in _CAMERA)
    return F.coalesce(F.concat(own, *(F.col(c).cast("array<double>") for c, _ in _CAMERA)), F.array_repeat(F.lit(float("nan")), width))


def _in_camera(o: np.ndarray, world: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the axes of the cameras of packed observations: right, up, backward."""
    d = world - o[:, 3:6]
    return tuple(sign * (o[:, at : at + 3] * d).sum(1) for at, sign in ((6, 1), (9, 1), (12, -1)))


def _seen(o: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Pixels of points in the cameras of packed observations, NaN where there is no image."""
    x, y, z = _in_camera(o, world)
    n, d0, d1 = np.hypot(x, y), o[:, 19], o[:, 20]
    r = np.where(o[:, 2] > 0, n / np.where(z == 0, np.nan, -z), np.arctan2(n, -z))
    r2 = r * r
    bent = 1 + r2 * (d0 + r2 * d1)
    scale = np.where(o[:, 2] > 0, bent / np.where(z == 0, np.nan, -z), np.where(n == 0, 0.0, r * bent / np.where(n == 0, 1.0, n)))
    return np.stack([x * scale * o[:, 17] + o[:, 15], y * scale * o[:, 18] + o[:, 16]], 1)


def _settled(o: np.ndarray, begin: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """Gauss-Newton for points whose packed observations begin at ``begin``, all at once."""
    times = np.diff(np.r_[begin, len(o)])
    total = lambda v: np.add.reduceat(v, begin, axis=0)
    world = start.copy()
    with np.errstate(all="ignore"):
        for _ in range(steps):
            h = 1e-4 * np.maximum(1.0, np.sqrt((world * world).sum(1)) * 1e-2)
            each, wide = np.repeat(world, times, axis=0), np.repeat(h, times)
            at = _seen(o, each)
            by = np.stack([(_seen(o, each + wide[:, None] * (np.arange(3) == i)) - at) / wide[:, None] for i in range(3)], 2)
            error = o[:, :2] - at
            usable = np.isfinite(by).all((1, 2)) & np.isfinite(error).all(1)
            by, error = np.where(usable[:, None, None], by, 0.0), np.where(usable[:, None], error, 0.0)
            m, g = total(np.einsum("kij,kil->kjl", by, by)), total(np.einsum("kij,ki->kj", by, error))
            cof = lambda i, j: m[:, (i + 1) % 3, (j + 1) % 3] * m[:, (i + 2) % 3, (j + 2) % 3] - m[:, (i + 1) % 3, (j + 2) % 3] * m[:, (i + 2) % 3, (j + 1) % 3]
            det = m[:, 0, 0] * cof(0, 0) + m[:, 0, 1] * cof(0, 1) + m[:, 0, 2] * cof(0, 2)
            det = np.where(det > SINGULAR * (np.trace(m, axis1=1, axis2=2) / 3) ** 3, det, np.nan)
            inverse = np.stack([np.stack([cof(j, i) / det for j in range(3)], 1) for i in range(3)], 1)
            step = np.einsum("pij,pj->pi", inverse, g)
            world = world + np.where(np.isfinite(step).all(1)[:, None], step, 0.0)
    behind = np.maximum.reduceat(_in_camera(o, np.repeat(world, times, axis=0))[2] >= 0, begin)
    return np.where(behind[:, None], start, world)


def triangulate(obs: DataFrame, keys: list[str], start: DataFrame, steps: int = 8) -> DataFrame:
    """Points that many rays see, by Gauss-Newton on the pixel error, all at once.

    ``obs``: keys, pixel ``px, py`` and the camera's columns; ``start``: keys, x, y, z.  A point
    without a solvable system, as one that a single camera sees, stays; one that falls behind a
    camera ends at its start.

    Plan: one row holds a point with all its observations, so all steps are one shuffle.  Points
    with more than :data:`MOST_SEEN` observations are fitted by aggregations instead, one a step.
    """
    first = start.select(*keys, *(F.col(c).cast("double").alias(c) for c in "xyz"))
    rows = written(obs.select(*keys, _packed().alias("__o")))
    many = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MOST_SEEN).select(*keys))
    crowded = many.limit(1).count() > 0
    few = rows.join(small(many), keys, "left_anti") if crowded else rows
    points = few.groupBy(*keys).agg(F.flatten(F.collect_list("__o")).alias("__o")).join(first, keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = 3 + sum(n for _, n in _CAMERA)
        for frame in frames:
            ends = np.cumsum(frame["__o"].map(len).to_numpy() // width)
            low = 0
            while low < len(frame):
                before = ends[low - 1] if low else 0
                high = max(int(np.searchsorted(ends, before + SEEN_AT_ONCE, "right")), low + 1)
                part = frame.iloc[low:high]
                o = np.concatenate(part["__o"].to_list()).reshape(-1, width)
                world = _settled(o, np.r_[before, ends[low : high - 1]] - before, part[list("xyz")].to_numpy(float), steps)
                yield part[keys].assign(x=world[:, 0], y=world[:, 1], z=world[:, 2])
                low = high

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields)
    out = points.mapInPandas(run, kinds)
    if not crowded:
        return out
    return out.unionByName(_triangulate_by_sums(obs.join(small(many), keys, "left_semi"), keys, first.join(small(many), keys, "left_semi"), steps))


def _triangulate_by_sums(obs: DataFrame, keys: list[str], start: DataFrame, steps: int) -> DataFrame:
    """:func:`triangulate` where a point has too many observations for one row.

    Each step is one aggregation of the normal sums per point and a 3 x 3 solve in expressions.
    """
    cur = written(start.select(*keys, "x", "y", "z"))
    names = ["xx", "xyy", "xz", "yy", "yz", "zz", "gx", "gy", "gz"]
    for _ in range(steps):
        rows = obs.join(cur, keys)
        p = tuple(F.col(c).cast("double") for c in "xyz")
        h = F.lit(1e-4) * F.greatest(F.lit(1.0), F.sqrt(C.dot(p, p)) * 1e-2)
        rows = rows.withColumn("__h", h)
        probes = [p, *(tuple(c + F.col("__h") if j == i else c for j, c in enumerate(p)) for i in range(3))]
        rows = rows.select(*keys, "px", "py", "__h", *(C.projected(q).alias(f"__p{i}") for i, q in enumerate(probes)))
        du, dv = ([(F.col(f"__p{i}.{a}") - F.col(f"__p0.{a}")) / F.col("__h") for i in (1, 2, 3)] for a in "uv")
        eu, ev = F.col("px") - F.col("__p0.u"), F.col("py") - F.col("__p0.v")
        jj = [du[i] * du[j] + dv[i] * dv[j] for i in range(3) for j in range(i, 3)]
        g = [du[i] * eu + dv[i] * ev for i in range(3)]
        sums = rows.select(*keys, *(c.alias(n) for c, n in zip([*jj, *g], names, strict=True))).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
        c = {n: F.col(n) for n in names}
        inv = _inverse3([[c["xx"], c["xyy"], c["xz"]], [c["xyy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]])
        det = c["xx"] * (c["yy"] * c["zz"] - c["yz"] * c["yz"]) - c["xyy"] * (c["xyy"] * c["zz"] - c["yz"] * c["xz"]) + c["xz"] * (c["xyy"] * c["yz"] - c["yy"] * c["xz"])
        solvable = det > SINGULAR * F.pow((c["xx"] + c["yy"] + c["zz"]) / 3, F.lit(3.0))
        step = [F.when(solvable, sum((inv[i][j] * c[n] for j, n in enumerate(("gx", "gy", "gz"))), F.lit(0.0))).alias(f"d{a}") for i, a in enumerate("xyz")]
        moved = cur.join(sums.select(*keys, *step), keys, "left")
        cur = written(moved.select(*keys, *((F.col(a) + F.coalesce(F.when(F.isnan(f"d{a}"), 0.0).otherwise(F.col(f"d{a}")), F.lit(0.0))).alias(a) for a in "xyz")))
    behind = obs.join(cur, keys).groupBy(*keys).agg(F.max(C.is_behind(tuple(F.col(c) for c in "xyz"))).alias("behind"))
    first = start.select(*keys, *(F.col(c).alias(f"s{c}") for c in "xyz"))
    out = cur.join(behind, keys).join(first, keys)
    return out.select(*keys, *(F.when(F.col("behind"), F.col(f"s{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"))


def reprojection_error(obs: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel error of each observation, null where its camera does not see the point."""
    rows = obs.join(points, keys)
    p = tuple(F.col(c) for c in "xyz")
    rows = C.with_projected(rows, p, "__u", "__v")
    u, v = F.col("__u"), F.col("__v")
    seen = ~C.outside_fov(p) & C.in_frame(u, v)
    return rows.withColumn("error", F.when(seen, F.sqrt((u - F.col("px")) ** 2 + (v - F.col("py")) ** 2))).drop("__u", "__v")


def fit_vignetting(samples: DataFrame, keys: list[str], x: str, y: str, target: str, order: int = 4, rounds: int = 20) -> DataFrame:
    """Separable Bezier surface ``H(x) V(y)`` per group by alternating least squares.

    Each half step is one aggregation of 5 x 5 normal sums for all groups and a grouped solve.
    Coordinates run from 0 to 1.  Of the scale that the two curves share, the mean of the
    horizontal control points is fixed at 1.  Returns keys, ``h`` and ``v`` (control points).
    """
    basis = lambda c: [math.comb(order, i) * F.pow(1 - F.col(c), F.lit(float(order - i))) * F.pow(F.col(c), F.lit(float(i))) for i in range(order + 1)]
    ones = F.array(*[F.lit(1.0)] * (order + 1))
    samples = samples.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(target).alias("__t"))
    cur = written(samples.select(*keys).distinct().withColumn("h", ones).withColumn("v", ones))
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frames: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [np.linalg.lstsq(_square(list(a), order + 1), np.array(b), rcond=None)[0].tolist() for a, b in zip(f["xx"], f["xy"], strict=True)]
            yield f[keys].assign(**{name: out})

    for _ in range(rounds):
        for own, other, at, along in (("h", "v", "__x", "__y"), ("v", "h", "__y", "__x")):
            fixed = sum((F.col(other)[i] * b for i, b in enumerate(basis(along))), F.lit(0.0))
            rows = samples.join(small(cur), keys)
            sums = normal_sums(rows, keys, [b * fixed for b in basis(at)], [F.col("__t")])
            new = sums.select(*keys, "xx", "xy").mapInPandas(lambda it, own=own: solve(it, own), f"{kinds}, {own} array<double>")
            cur = written(new.join(cur.select(*keys, other), keys))
    scale = F.aggregate("h", F.lit(0.0), lambda a, b: a + b) / (order + 1)
    cur = cur.withColumn("s", scale)
    return cur.select(*keys, F.transform("h", lambda c: c / F.col("s")).alias("h"), F.transform("v", lambda c: c * F.col("s")).alias("v"))


def _lab(p: np.ndarray, rgb: np.ndarray, illuminant: str, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Lab of colors under black levels ``p[:3]`` and the matrix ``p[3:12]``, by rows, each first times its ``scale``."""
    from rigspark.functions.scalars import RGB_TO_XYZ, WHITE

    lin = (rgb * np.reshape(scale, (-1, 1)) - p[:3]) / (1 - p[:3]) @ p[3:12].reshape(3, 3).T
    x = lin @ (np.array(RGB_TO_XYZ[illuminant]) / np.array(WHITE[illuminant])[:, None]).T
    f = np.where(x > 0.008856, np.cbrt(np.maximum(x, 0)), 7.787 * x + 16 / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


#: Order of the illumination's Bezier curves.
LIGHT_ORDER = 4


def _bernstein(t: np.ndarray) -> np.ndarray:
    i = np.arange(LIGHT_ORDER + 1)
    return np.array([math.comb(LIGHT_ORDER, k) for k in i]) * (1 - t[:, None]) ** (LIGHT_ORDER - i) * t[:, None] ** i


def _light(p: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Illumination at places in the chart: two curves multiplied, each with its first control point at 1."""
    x, y = np.r_[1.0, p[12 : 12 + LIGHT_ORDER]], np.r_[1.0, p[12 + LIGHT_ORDER :]]
    return (_bernstein(place[:, 0]) @ x) * (_bernstein(place[:, 1]) @ y)


def fit_color(patches: DataFrame, keys: list[str], illuminant: str = "D50", steps: int = 15, place: tuple[str, str] | None = None, black: str | None = None) -> DataFrame:
    """Black level and 3 x 3 matrix per group that bring the patches' Lab nearest to the reference.

    ``patches``: keys, r, g, b and the reference l0, a0, b0.  ``place``: two columns with where a
    patch lies in the chart; then an uneven illumination, a Bezier surface over the chart from its
    first corner (the least place, scale 1) to its last, is fitted together with the rest.
    ``black``: a column with the three black levels, the same in a group, that are held; else they
    are fitted within [0, 0.9].

    In each Levenberg-Marquardt step the tasks sum J'J and J'r of their rows per group, Spark adds
    these up, and each group's system is solved.  Returns keys, ``params`` (three black levels,
    then the matrix by rows), ``error`` (mean distance in Lab) and, with ``place``, the control
    points ``light_x`` and ``light_y``.
    """
    n = 12 + (2 * LIGHT_ORDER if place else 0)
    kinds = ", ".join(f"`{k}` {patches.schema[k].dataType.simpleString()}" for k in keys)
    cols = ["r", "g", "b", "l0", "a0", "b0"]
    if place:
        box = patches.groupBy(*keys).agg(*(f(c).alias(f"__{m}{i}") for i, c in enumerate(place) for m, f in (("lo", F.min), ("hi", F.max))))
        patches = patches.join(small(written(box)), keys)
        patches = patches.withColumns({f"__p{i}": F.coalesce((F.col(c) - F.col(f"__lo{i}")) / F.nullif(F.col(f"__hi{i}") - F.col(f"__lo{i}"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(place)})
        cols += ["__p0", "__p1"]
    start = F.array(*map(F.lit, [0.01] * 3 + [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] + [1.0] * (n - 12)))
    first = patches.groupBy(*keys).agg(F.first(black).alias("__black") if black else F.lit(None).alias("__black"))
    first = first.select(*keys, F.concat(F.col("__black"), F.slice(start, 4, n - 3)).alias("params") if black else start.alias("params"))
    cur = written(first.withColumn("tried", F.col("params")).withColumn("damp", F.lit(1e-2)).withColumn("best", F.lit(float("inf"))))
    patches = written(patches.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)))

    def lab(p: np.ndarray, part: np.ndarray) -> np.ndarray:
        return _lab(p, part[:, :3], illuminant, _light(p, part[:, 6:]) if place else 1.0)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, group in f.groupby(keys, dropna=False):
                p, part = np.array(group["tried"].iloc[0]), group[cols].to_numpy(float)
                base = lab(p, part)
                e = part[:, 3:6] - base
                jac = np.stack([(lab(p + 1e-6 * (np.arange(n) == i), part) - base) / 1e-6 for i in range(n)], -1)
                if black:
                    jac[:, :, :3] = 0
                s = np.r_[np.einsum("rki,rkj->ij", jac, jac).ravel(), np.einsum("rki,rk->i", jac, e), (e**2).sum(), np.sqrt((e**2).sum(1)).sum(), len(part)]
                yield group[keys].iloc[:1].assign(s=[s.tolist()])

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, best, params, tried, damp in zip(f["s"], f["best"], f["params"], f["tried"], f["damp"], strict=True):
                s = np.array(s)
                a, g, cost = s[: n * n].reshape(n, n), s[n * n : n * n + n], s[n * n + n]
                if cost < best:  # go on from here, else halfway back
                    move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-9), g, rcond=None)[0]
                    params, best, damp, new = list(tried), float(cost), max(damp / 4, 1e-9), np.array(tried) + move
                else:
                    damp, new = damp * 6, (np.array(params) + np.array(tried)) / 2
                if not black:
                    new[:3] = np.clip(new[:3], 0.0, 0.9)
                out.append((list(params), best, damp, new.tolist()))
            yield f[keys].assign(params=[o[0] for o in out], best=[o[1] for o in out], damp=[o[2] for o in out], tried=[o[3] for o in out])

    def sums(cur: DataFrame, name: str) -> DataFrame:
        rows = patches.join(small(cur.select(*keys, F.col(name).alias("tried"))), keys)
        parts = rows.mapInPandas(partial, f"{kinds}, s array<double>").select(*keys, F.posexplode("s").alias("i", "v"))
        each = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))

    for _ in range(steps):
        cur = written(sums(cur, "tried").join(cur, keys).mapInPandas(advance, f"{kinds}, params array<double>, best double, damp double, tried array<double>"))
    last = sums(cur, "params").select(*keys, (F.element_at("s", -2) / F.element_at("s", -1)).alias("error"))
    light = [F.concat(F.array(F.lit(1.0)), F.slice("params", at, LIGHT_ORDER)).alias(name) for name, at in (("light_x", 13), ("light_y", 13 + LIGHT_ORDER))] if place else []
    return cur.select(*keys, F.slice("params", 1, 12).alias("params"), *light).join(last, keys)


def _homography(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Homography of point pairs by the direct linear transform."""
    rows = []
    for (x, y), (u, v) in zip(p, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


#: Matches that a task scores at a time, under all trials.
SCORED_AT_ONCE = 2_000


def ransac_inliers(matches: DataFrame, threshold: float = 3.0, trials: int = 200, seed: int = 14) -> DataFrame:
    """Matches (x0, y0, x1, y1) within ``threshold`` pixels of the best homography of random quads.

    The quads come from the ``4 * trials`` matches with the smallest hashes, a bounded sample;
    every trial is scored on all matches.  Fewer than four matches have no inliers.
    """
    pts = ["x0", "y0", "x1", "y1"]
    sample = matches.select(*pts).orderBy(F.xxhash64(F.lit(seed), *pts), *pts).limit(4 * trials).toPandas().to_numpy(float)
    if len(sample) < 4:
        return matches.limit(0)
    rng = np.random.default_rng(seed)
    models = []
    for t in range(trials):
        quad = sample[rng.choice(len(sample), 4, replace=False)]
        models.append((t, *_homography(quad[:, :2], quad[:, 2:]).ravel().tolist()))
    spark = matches.sparkSession
    names = [f"h{i}" for i in range(9)]
    table = spark.createDataFrame(models, "trial int, " + ", ".join(f"{n} double" for n in names))

    def error(h: list[Column]) -> Column:
        w = h[6] * F.col("x0") + h[7] * F.col("y0") + h[8]
        u, v = F.try_divide(h[0] * F.col("x0") + h[1] * F.col("y0") + h[2], w), F.try_divide(h[3] * F.col("x0") + h[4] * F.col("y0") + h[5], w)
        return F.sqrt((u - F.col("x1")) ** 2 + (v - F.col("y1")) ** 2)

    h = np.array([m[1:] for m in models])

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each trial the number of a task's matches that it fits."""
        total = np.zeros(trials, int)
        for frame in frames:
            for low in range(0, len(frame), SCORED_AT_ONCE):
                x0, y0, x1, y1 = frame.iloc[low : low + SCORED_AT_ONCE].to_numpy(float).T[:, :, None]
                with np.errstate(all="ignore"):
                    w = h[:, 6] * x0 + h[:, 7] * y0 + h[:, 8]
                    u, v = (h[:, 0] * x0 + h[:, 1] * y0 + h[:, 2]) / w, (h[:, 3] * x0 + h[:, 4] * y0 + h[:, 5]) / w
                    total += (np.sqrt((u - x1) ** 2 + (v - y1) ** 2) < threshold).sum(0)
        yield pd.DataFrame({"trial": np.arange(trials), "hit": total})

    score = matches.select(*(F.col(c).cast("double").alias(c) for c in pts)).mapInPandas(hits, "trial int, hit long").groupBy("trial").agg(F.sum("hit").alias("hits"))
    best = score.join(small(table), "trial").orderBy(F.desc("hits"), "trial").first()
    return matches.where(error([F.lit(best[n]) for n in names]) < threshold)
