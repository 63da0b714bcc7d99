"""Geometric calibration: all parameters of a rig adjusted together with the points that it sees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark.bindings import RIG_SCHEMA
from rigspark.functions.camera import NEAR_INFINITY
from rigspark.operators.graph import trace_members
from rigspark.operators.stats import rejection_counts, reject_outliers
from rigspark.scratch import small, spread, written

#: Cameras of a rig, whose system is solved on the driver; a larger table is refused.
MOST_CAMERAS = 128
#: Observations of one point in one row; a trace with more is adjusted as several points.
MOST_SEEN = 1024
#: Numbers of the dense blocks that a task holds at a time.
BLOCK_NUMBERS = 2_000_000

ALL = ("rotation", "principal", "focal", "distortion", "position")
FIRST_PASS = ("rotation", "principal")

_COLUMNS = [f.split()[0] for f in RIG_SCHEMA.split(", ")]


@dataclass
class Rig:
    """The cameras of a rig as arrays, in the order of their ordinals."""

    rows: list[dict]
    origin: np.ndarray
    axes: np.ndarray  # right, up, backward
    principal: np.ndarray
    focal: np.ndarray
    distortion: np.ndarray

    @classmethod
    def of(cls, cameras: DataFrame) -> Rig:
        rows = [r.asDict() for r in cameras.orderBy("ordinal").limit(MOST_CAMERAS + 1).collect()]
        if len(rows) > MOST_CAMERAS:
            raise ValueError(f"a rig has at most {MOST_CAMERAS} cameras")
        get = lambda c, n: np.array([r[c] for r in rows], float).reshape(-1, n)
        axes = np.stack([get("right", 3), get("up", 3), -get("forward", 3)], 1)
        return cls(rows, get("origin", 3), axes, get("principal", 2), get("focal", 2), get("distortion", 2))

    @property
    def flat(self) -> np.ndarray:
        return np.array([r["type"] != "FTHETA" for r in self.rows])

    def table(self, spark: SparkSession) -> DataFrame:
        own = {"origin": self.origin, "right": self.axes[:, 0], "up": self.axes[:, 1], "forward": -self.axes[:, 2], "principal": self.principal, "focal": self.focal, "distortion": self.distortion}
        return spark.createDataFrame([tuple(own[c][i].tolist() if c in own else r[c] for c in _COLUMNS) for i, r in enumerate(self.rows)], RIG_SCHEMA)

    def numbers(self, spark: SparkSession) -> DataFrame:
        """``id`` and ``cam``, its place in the arrays."""
        return F.broadcast(spark.createDataFrame([(r["id"], i) for i, r in enumerate(self.rows)], "id string, cam int"))


def _lens(rig: Rig, cam: np.ndarray, world: np.ndarray):
    """Place in the camera's axes, and of the lens: radius, factor, slope and the partials of the angle."""
    away = world - rig.origin[cam]
    at = np.einsum("kij,kj->ki", rig.axes[cam], away)
    n, z, flat = np.hypot(at[:, 0], at[:, 1]), at[:, 2], rig.flat[cam]
    depth = np.where(z == 0, 1e-300, -z)
    square = np.maximum(n * n + z * z, 1e-300)
    rho = np.where(flat, n / depth, np.arctan2(n, -z))
    by_n, by_z = np.where(flat, 1 / depth, -z / square), np.where(flat, n / depth**2, n / square)
    d0, d1 = rig.distortion[cam].T
    r2 = rho * rho
    radius, slope = rho * (1 + r2 * (d0 + r2 * d1)), 1 + r2 * (3 * d0 + 5 * r2 * d1)
    factor = np.where(n > 1e-12, radius / np.maximum(n, 1e-12), by_n)
    return away, at, n, rho, radius, slope, factor, by_n, by_z


def pixel(rig: Rig, cam: np.ndarray, world: np.ndarray) -> np.ndarray:
    _, at, *_, factor, _, _ = _lens(rig, cam, world)
    return at[:, :2] * factor[:, None] * rig.focal[cam] + rig.principal[cam]


def _by_world(rig: Rig, cam: np.ndarray, lens: tuple) -> np.ndarray:
    """Derivatives of the pixel by the world point."""
    _, at, n, _, radius, slope, factor, by_n, by_z = lens
    m, focal, safe = at[:, :2], rig.focal[cam], np.maximum(n, 1e-12)
    bend = np.where(n > 1e-12, (slope * by_n * safe - radius) / safe**3, 0.0)
    by_at = np.empty((len(cam), 2, 3))
    by_at[:, :, :2] = m[:, :, None] * m[:, None, :] * bend[:, None, None]
    by_at[:, 0, 0] += factor
    by_at[:, 1, 1] += factor
    by_at[:, :, 2] = m * (slope * by_z / safe)[:, None]
    by_at *= focal[:, :, None]
    return by_at @ rig.axes[cam]


def slopes(rig: Rig, cam: np.ndarray, world: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the pixel: by the world point and by each parameter (``focal``: relative)."""
    lens = _lens(rig, cam, world)
    away, at, n, rho, _, _, factor, _, _ = lens
    m, focal, safe = at[:, :2], rig.focal[cam], np.maximum(n, 1e-12)
    by_world = _by_world(rig, cam, lens)
    cross = np.zeros((len(cam), 3, 3))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        cross[:, j, i], cross[:, i, j] = away[:, k], -away[:, k]
    unit = (m / safe[:, None] * focal)[:, :, None]
    return {
        "world": by_world,
        "rotation": by_world @ cross,
        "position": -by_world,
        "principal": np.broadcast_to(np.eye(2), (len(cam), 2, 2)),
        "focal": (m * factor[:, None] * focal)[:, :, None],
        "distortion": unit * np.stack([rho**3, rho**5], 1)[:, None, :],
    }


def rays(rig: Rig, cam: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Direction of the world ray through each pixel; Newton's method undoes the distortion."""
    s = (seen - rig.principal[cam]) / rig.focal[cam]
    n = np.hypot(s[:, 0], s[:, 1])
    d0, d1 = rig.distortion[cam].T
    r = n.copy()
    for _ in range(10):
        r2 = r * r
        slope = 1 + r2 * (3 * d0 + 5 * r2 * d1)
        r -= (r * (1 + r2 * (d0 + r2 * d1)) - n) / np.where(np.abs(slope) < 1e-9, 1.0, slope)
    angle = np.where(rig.flat[cam], np.arctan(r), r)
    k = np.sin(angle) / np.maximum(n, 1e-300)
    return np.einsum("kij,ki->kj", rig.axes[cam], np.c_[s * k[:, None], -np.cos(angle)])


def sees(rig: Rig, cam: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Whether the point lies within the camera's field of view and its image."""
    away, at, *_ = _lens(rig, cam, world)
    fov = np.array([r["fov"] if r["fov"] is not None else (np.pi if r["type"] == "FTHETA" else np.pi / 2) for r in rig.rows])
    size, p = np.array([r["resolution"] for r in rig.rows], float), pixel(rig, cam, world)
    inside = -at[:, 2] > np.cos(fov[cam]) * np.linalg.norm(away, axis=1)
    return inside & (p >= 0).all(1) & (p < size[cam]).all(1)


def _weights(error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huber's loss at one pixel: weight of each residual and its cost."""
    s = (error**2).sum(1)
    norm = np.sqrt(s)
    return np.where(norm > 1, 1 / np.maximum(norm, 1e-300), 1.0), np.where(norm > 1, 2 * norm - 1, s)


def settle(rig: Rig, cam: np.ndarray, seen: np.ndarray, begin: np.ndarray, world: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Points that least misplace their pixels, all at once, by damped steps: points and their costs.

    ``begin``: where the observations of each point begin.  A point that would fall behind a
    flat camera that sees it stays in front.
    """
    if not len(begin):
        return world, np.zeros(0)
    placed, costs = world.copy(), np.zeros(len(world))
    mine, times = np.arange(len(world)), np.diff(np.r_[begin, len(cam)])

    def cost(world: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = np.repeat(world, times, axis=0)
        error = seen - pixel(rig, cam, each)
        weight, own = _weights(error)
        behind = np.einsum("kj,kj->k", rig.axes[cam, 2], each - rig.origin[cam]) >= 0
        own = np.where((behind & rig.flat[cam]) | ~np.isfinite(own), np.inf, own)
        return error, weight, np.add.reduceat(own, begin, axis=0)

    error, weight, now = cost(world)
    damp = np.full(len(world), 1e-3)
    for _ in range(steps):
        total = lambda v: np.add.reduceat(v, begin, axis=0)  # noqa: B023, E731
        by = _by_world(rig, cam, _lens(rig, cam, np.repeat(world, times, axis=0)))
        heavy, right = by * weight[:, None, None], np.where(np.isfinite(error), error, 0)
        v = total(heavy[:, 0, :, None] * by[:, 0, None, :] + heavy[:, 1, :, None] * by[:, 1, None, :])
        g = total(heavy[:, 0] * right[:, :1] + heavy[:, 1] * right[:, 1:])
        v[:, range(3), range(3)] *= 1 + damp[:, None]
        v += (1e-14 * np.trace(v, axis1=1, axis2=2) + 1e-300)[:, None, None] * np.eye(3)
        with np.errstate(all="ignore"):
            try:
                move = np.linalg.solve(v, g[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                move = np.einsum("pij,pj->pi", np.linalg.pinv(v, hermitian=True), g)
        moved = world + np.where(np.isfinite(move), move, 0)
        e, w, then = cost(moved)
        better = then < now
        gain = np.where(better, np.minimum(now, 1e300) - np.minimum(then, 1e300), 0)
        world = np.where(better[:, None], moved, world)
        own = np.repeat(better, times)
        error, weight = np.where(own[:, None], e, error), np.where(own, w, weight)
        now, damp = np.where(better, then, now), np.where(better, damp / 10, damp * 10)
        placed[mine], costs[mine] = world, now
        # A point that gains no more is left where it is; the others go on without it.
        on = (gain > 1e-12 * (1 + now)) | ~(better | (damp > 1e3))
        if not on.any():
            break
        if not on.all():
            own = np.repeat(on, times)
            mine, world, now, damp, times = mine[on], world[on], now[on], damp[on], times[on]
            cam, seen, error, weight = cam[own], seen[own], error[own], weight[own]
            begin = np.r_[0, np.cumsum(times)[:-1]]
    if not steps:
        costs = now
    return placed, costs


def place(rig: Rig, cam: np.ndarray, seen: np.ndarray, begin: np.ndarray, world: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Points that least misplace their pixels, and their costs.

    Each is looked for from where it is (a point without a place is NaN), from the place nearest
    to all its rays or from the mean of the places at a distance along them, whichever misplaces
    least: a point once thrown far away is flat in depth and would not come back by itself.
    """
    if not len(begin):
        return world, np.zeros(0)
    toward, times = rays(rig, cam, seen), np.diff(np.r_[begin, len(cam)])
    total = lambda v: np.add.reduceat(v, begin, axis=0)
    far = total(rig.origin[cam] + distance * toward) / times[:, None]
    across = np.eye(3) - toward[:, :, None] * toward[:, None, :]
    near = np.einsum("pij,pj->pi", np.linalg.pinv(total(across), rcond=1e-12, hermitian=True), total(np.einsum("kij,kj->ki", across, rig.origin[cam])))

    def cost(world: np.ndarray) -> np.ndarray:
        each = np.repeat(world, times, axis=0)
        ahead = np.einsum("kj,kj->k", each - rig.origin[cam], toward) > 0
        own = _weights(seen - pixel(rig, cam, each))[1]
        return total(np.where(ahead & np.isfinite(own), own, np.inf))

    costs = np.stack([cost(np.where(np.isfinite(world), world, far)), cost(near), cost(far)])
    best = costs.argmin(0)
    world = np.where(np.isfinite(world), world, far)
    return settle(rig, cam, seen, begin, np.where((best == 0)[:, None], world, np.where((best == 1)[:, None], near, far)))


def _flat(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Camera numbers and pixels of all rows' observations, and where each row begins."""
    times = rows.column("cam").value_lengths().to_numpy(zero_copy_only=False)
    cat = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False)
    return cat("cam").astype(int), np.stack([cat("px"), cat("py")], 1), np.r_[0, np.cumsum(times)[:-1]].astype(int)


def _places(rows: pa.RecordBatch) -> np.ndarray:
    """The rows' points, NaN where they have none."""
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)


def _with(rows: pa.RecordBatch, **own: np.ndarray) -> pa.RecordBatch:
    """The rows with some columns, which stand for those of the same name or come last; NaN is null."""
    columns = dict(zip(rows.schema.names, rows.columns, strict=True)) | {c: pa.array(v, pa.float64(), mask=np.isnan(v)) for c, v in own.items()}
    return pa.RecordBatch.from_pydict(columns)


def tracks(obs: DataFrame, rig: Rig, key: str, points: DataFrame | None = None, distance: float = 1000.0) -> DataFrame:
    """One row for each point, with all its observations: key, ``part``, ``cam``, ``px``, ``py``, ``x``, ``y``, ``z``, ``cost``.

    ``obs``: key, camera ``id``, ``px``, ``py``; rows without one of them, or of a camera that the
    rig does not have, do not count.  Points start at ``points`` (key, x, y, z) or at a distance
    along their rays, and are triangulated.
    """
    spark = obs.sparkSession
    rows = obs.select(key, "id", "px", "py").dropna().join(rig.numbers(spark), "id")
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_SEEN)
    many = written(many)
    part = F.lit(0)
    if many.limit(1).count():
        rows = rows.join(small(many), key, "left")
        part = F.pmod(F.xxhash64("id", "px", "py"), F.ceil(F.coalesce("n", F.lit(1)) / MOST_SEEN)).cast("int")
    rows = spread(rows.withColumn("part", part), key).groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("cam", "px", "py"))).alias("s"))
    if points is not None:
        rows = rows.join(points.select(key, *(F.col(c).cast("double").alias(c) for c in "xyz")), key, "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in "xyz"})
    rows = rows.select(key, "part", F.col("s.cam").alias("cam"), F.col("s.px").alias("px"), F.col("s.py").alias("py"), "x", "y", "z", F.lit(0.0).alias("cost"), F.lit(0.0).alias("robust"), F.lit(0.0).alias("square"))
    return settled(rows, rig, distance)


def settled(rows: DataFrame, rig: Rig, distance: float = 1000.0) -> DataFrame:
    """Tracks triangulated against a rig, and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cam, seen, begin = _flat(batch)
                world, cost = place(rig, cam, seen, begin, _places(batch), distance)
                error = seen - pixel(rig, cam, np.repeat(world, np.diff(np.r_[begin, len(cam)]), axis=0))
                robust, square = (np.add.reduceat(v, begin) for v in (_weights(error)[1], (error**2).sum(1)))
                yield _with(batch, **dict(zip("xyz", world.T, strict=True)), cost=cost, robust=robust, square=square)

    return written(rows.mapInArrow(run, rows.schema))


def unknowns(rig: Rig, free: tuple[str, ...], shared: bool) -> tuple[dict[str, np.ndarray], int]:
    """The column of each camera's parameters in the system, -1 where they are locked, and the number of columns.

    The pose of the first camera is locked.  Distortion stands last, the border of the system: a
    group of cameras shares its columns (``shared``) or each camera has its own.
    """
    n, out, at = len(rig.rows), {}, 0
    for name, width in (("rotation", 3), ("position", 3), ("principal", 2), ("focal", 1)):
        columns = np.full((n, width), -1)
        first = 1 if name in ("rotation", "position") else 0
        if name in free and n > first:
            columns[first:] = at + np.arange((n - first) * width).reshape(-1, width)
            at = int(columns.max()) + 1
        out[name] = columns
    out["distortion"] = np.full((n, 2), -1)
    if "distortion" in free:
        group = np.unique([r["grp"] or "" for r in rig.rows], return_inverse=True)[1] if shared else np.arange(n)
        out["distortion"] = at + 2 * group[:, None] + np.arange(2)
        at = int(out["distortion"].max()) + 1 if n else at
    return out, at


def _eliminate(a: np.ndarray, g: np.ndarray, rig: Rig, columns: dict[str, np.ndarray], cam: np.ndarray, seen: np.ndarray, begin: np.ndarray, world: np.ndarray) -> None:
    """Adds to the system what some points give, their own unknowns eliminated."""
    size = len(g)
    each = np.repeat(world, np.diff(np.r_[begin, len(cam)]), axis=0)
    error = seen - pixel(rig, cam, each)
    root = np.sqrt(_weights(error)[0])
    by = slopes(rig, cam, each)
    jac, obs = np.zeros((len(cam), 2, size)), np.arange(len(cam))
    for name, column in columns.items():
        for i in range(column.shape[1]):
            open_ = column[cam, i] >= 0
            jac[obs[open_], :, column[cam[open_], i]] = by[name][open_, :, i]
    jac, error, point = jac * root[:, None, None], error * root[:, None], by["world"] * root[:, None, None]
    wide = jac.reshape(-1, size)
    a += wide.T @ wide
    g += wide.T @ error.ravel()
    v = np.add.reduceat(np.einsum("kij,kil->kjl", point, point), begin, axis=0)
    v += (1e-12 * np.trace(v, axis1=1, axis2=2) + 1e-300)[:, None, None] * np.eye(3)
    inverse = np.linalg.pinv(v, rcond=1e-14, hermitian=True)
    cross = np.add.reduceat(np.einsum("kid,kij->kdj", jac, point), begin, axis=0)
    gp = np.add.reduceat(np.einsum("kij,ki->kj", point, error), begin, axis=0)
    half = cross @ inverse
    a -= np.einsum("pdj,pej->de", half, cross, optimize=True)
    g -= np.einsum("pdj,pj->d", half, gp)


def reduced_system(rows: DataFrame, rig: Rig, columns: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side for the rig's unknowns, the points eliminated.

    Each task sums the parts of its points in one dense matrix, whose size is the rig's; Spark
    adds the tasks' matrices row by row.
    """
    chunk = max(BLOCK_NUMBERS // (3 * max(size, 1)), 2 * MOST_SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, g = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if not len(batch):
                continue
            cam, seen, begin = _flat(batch)
            world, ends = _places(batch), np.r_[begin[1:], len(cam)]
            first = 0
            while first < len(batch):
                last = max(int(np.searchsorted(ends, begin[first] + chunk, "right")), first + 1)
                at = slice(begin[first], ends[last - 1])
                _eliminate(a, g, rig, columns, cam[at], seen[at], begin[first:last] - begin[first], world[first:last])
                first = last
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size + 1), pa.int32()), "v": pa.array([*a, g], pa.list_(pa.float64()))})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"][:1], "v": [np.sum(np.stack(frame["v"].to_list()), axis=0)]})

    sums = rows.mapInArrow(run, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    a, g = np.zeros((size, size)), np.zeros(size)
    for r in sums:
        if r.i < size:
            a[r.i] = r.v
        else:
            g[:] = r.v
    return a, g


def moved(rig: Rig, columns: dict[str, np.ndarray], step: np.ndarray) -> Rig:
    """The rig after a step of its unknowns: small rotations of the axes, relative changes of the focal length."""
    take = {name: np.where(c >= 0, step[np.maximum(c, 0)] if len(step) else 0.0, 0.0) for name, c in columns.items()}
    axes = rig.axes.copy()
    for i, w in enumerate(take["rotation"]):
        angle = np.linalg.norm(w)
        if angle > 0:
            k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / angle
            turn = np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
            axes[i] = rig.axes[i] @ turn.T
    return replace(rig, axes=axes, origin=rig.origin + take["position"], principal=rig.principal + take["principal"], focal=rig.focal * (1 + take["focal"]), distortion=rig.distortion + take["distortion"])


class Adjusted(NamedTuple):
    cameras: DataFrame
    points: DataFrame
    #: Root mean square pixel error before the first and after each step that was taken.
    rmse: list[float]


def _cost(rows: DataFrame) -> tuple[float, float]:
    """Sum of the robust costs, and the root mean square pixel error, of settled tracks."""
    got = rows.agg(F.sum("robust"), F.sum("square"), F.sum(F.size("cam"))).first()
    return (float(got[0] or 0.0), float(np.sqrt((got[1] or 0.0) / got[2])) if got[2] else 0.0)


def bundle_adjust(obs: DataFrame, cameras: DataFrame, points: DataFrame | None = None, key: str = "trace_id", free: tuple[str, ...] = ALL, shared: bool = True, steps: int = 20, tolerance: float = 1e-4) -> Adjusted:
    """Cameras and points that least misplace the pixels, under Huber's loss at one pixel.

    ``obs``: key, camera ``id``, ``px``, ``py``.  ``free`` of :data:`ALL` are adjusted for every
    camera, but for the first one's pose; distortion is one for each group of cameras, or with
    ``shared`` false each camera's own.  Damped steps: the points are eliminated, so a step solves
    a system of the rig's unknowns only, and the points are triangulated anew against the moved
    rig.  A step that does not lower the cost is repeated with more damping.  It ends after
    ``steps``, when a step lowers the cost by less than ``tolerance`` of it, or at an error below a
    millionth of a pixel.  Without
    observations the rig stays.

    Plan: one row holds a point with all its observations, so a step is two passes over the
    points without a shuffle, and the sums of the tasks' matrices.  The driver holds the system of
    the rig, at most :data:`MOST_CAMERAS` cameras.
    """
    spark, rig = obs.sparkSession, Rig.of(cameras)
    rows = tracks(obs, rig, key, points)
    columns, size = unknowns(rig, free, shared)
    damp, (now, rmse) = 1e-4, _cost(rows)
    history = [rmse]
    for _ in range(steps if size else 0):
        a, g = reduced_system(rows, rig, columns, size)
        gain = 0.0
        for _ in range(8):
            scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
            step = np.linalg.lstsq(a / np.outer(scale, scale) + damp * np.eye(size), g / scale, rcond=1e-13)[0] / scale
            trial = moved(rig, columns, step)
            tried = settled(rows, trial)
            then, rmse = _cost(tried)
            if then < now:
                gain, rig, rows, now, damp = now - then, trial, tried, then, max(damp / 10, 1e-12)
                history.append(rmse)
                break
            damp *= 10
        if gain <= tolerance * now or history[-1] < 1e-6:
            break
    return Adjusted(rig.table(spark), rows.select(key, "part", "x", "y", "z"), history)


class Calibration(NamedTuple):
    cameras: DataFrame
    points: DataFrame
    #: One dict for each pass: matches, invisible, outliers, rmse_before, rmse_after.
    passes: list[dict]


def camera_of(image: str | Column) -> Column:
    """The camera's id, an image's parent folder."""
    return F.element_at(F.split(image, "/"), -2)


def frame_of(image: str | Column) -> Column:
    """The frame, an image's stem."""
    return F.regexp_extract(image, r"([^/]*?)(\.[^./]*)?$", 1)


def match_pixels(matches: DataFrame, keypoints: DataFrame, rig: Rig) -> DataFrame:
    """Matches with both keypoints' places ``px``, ``py`` and camera numbers ``cam`` as arrays of two."""
    places = keypoints.select("image", F.col("kp_idx").alias("idx"), F.struct(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).alias("at")).dropDuplicates(["image", "idx"])
    rows = matches.select("image0", "idx0", "image1", "idx1").distinct()
    for side in "01":
        own = places.select(F.col("image").alias(f"image{side}"), F.col("idx").alias(f"idx{side}"), F.col("at").alias(f"at{side}"))
        rows = rows.join(own, [f"image{side}", f"idx{side}"])
        number = rig.numbers(matches.sparkSession).select(F.col("id").alias(f"id{side}"), F.col("cam").alias(f"cam{side}"))
        rows = rows.withColumn(f"id{side}", camera_of(f"image{side}")).join(number, f"id{side}")
    pair = lambda f: F.array(f("0"), f("1"))
    return rows.select("image0", "idx0", "image1", "idx1", pair(lambda s: F.col(f"cam{s}")).alias("cam"), pair(lambda s: F.col(f"at{s}.px")).alias("px"), pair(lambda s: F.col(f"at{s}.py")).alias("py"))


def match_errors(rows: DataFrame, rig: Rig, distance: float = 1000.0) -> DataFrame:
    """Adds ``error`` to matches: root mean square of both pixel errors, null where a camera does
    not see what the other one looks at.

    ``rows``: :func:`match_pixels`, and ``x``, ``y``, ``z`` of the match's point; where these are
    null the match is triangulated by itself, and the columns then hold that point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cam, seen, begin = _flat(batch)
                other = np.arange(len(cam)) ^ 1
                far = rig.origin[cam] + NEAR_INFINITY * rays(rig, cam, seen)
                visible = sees(rig, cam[other], far).reshape(-1, 2).all(1)
                world = _places(batch)
                new = ~np.isfinite(world).all(1)
                if new.any():
                    both = np.repeat(new, 2)
                    own = np.arange(new.sum()) * 2
                    world[new] = place(rig, cam[both], seen[both], own, world[new], distance)[0]
                square = ((seen - pixel(rig, cam, np.repeat(world, 2, axis=0))) ** 2).sum(1)
                error = np.where(visible, np.sqrt(square.reshape(-1, 2).sum(1) / 2), np.nan)
                yield _with(batch, **dict(zip("xyz", world.T, strict=True)), error=error)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread(rows).mapInArrow(run, f"{fields}, error double")


def _good(rows: DataFrame, factor: float) -> tuple[DataFrame, tuple]:
    """Matches below ``factor`` times the median of their image pair; those across frames all stay."""
    pair, across = ["image0", "image1"], frame_of("image0") != frame_of("image1")
    rows = written(rows.withColumn("pair", F.concat_ws("|", *pair)))
    kept = written(reject_outliers(rows, ["pair"], "error", factor, across).select("image0", "idx0", "image1", "idx1", "cam", "px", "py"))
    counts = rejection_counts(rows, ["pair"], "error", F.lit(float("inf"))).agg(F.sum("total"), F.sum("invisible")).first()
    return kept, (counts[0] or 0, counts[1] or 0, kept.count())


def calibrate_geometry(matches: DataFrame, keypoints: DataFrame, cameras: DataFrame, passes: int = 10, factor: float = 5.0, distance: float = 1000.0, lock_positions: bool = True, shared: bool = True, tolerance: float = 1e-3) -> Calibration:
    """Rig and points from matched keypoints; each pass starts from all matches.

    ``matches``: ``image0``, ``idx0``, ``image1``, ``idx1``; ``keypoints``: ``image``, ``kp_idx``,
    ``x``, ``y``.  In a pass every match is triangulated by itself and those above ``factor`` times
    their image pair's median error go; the rest are assembled to traces, triangulated, rejected
    once more, and rig and points are adjusted.  The first pass turns cameras and moves principal
    points only; later ones free focal lengths and distortion too, and positions unless
    ``lock_positions``.  Passes end early when one
    lowers its error by less than ``tolerance`` of it, or below a thousandth of a pixel.
    Matches of unknown keypoints or cameras do not count, repeated ones count once.
    """
    spark, rig, report, points = matches.sparkSession, Rig.of(cameras), [], None
    pixels = written(match_pixels(matches, keypoints, rig))
    places = written(keypoints.select("image", "kp_idx", F.col("x").alias("px"), F.col("y").alias("py")).dropDuplicates(["image", "kp_idx"]))
    for turn in range(passes):
        alone = match_errors(pixels.withColumns({c: F.lit(None).cast("double") for c in "xyz"}), rig, distance)
        kept, (total, invisible, first) = _good(alone, factor)
        for again in (True, False):
            members = written(trace_members(kept).withColumn("id", camera_of("image")))
            obs = written(members.join(places, ["image", "kp_idx"]).select("trace_id", "id", "px", "py"))
            if again:
                found = tracks(obs, rig, "trace_id", distance=distance).groupBy("trace_id").agg(*(F.min_by(c, "part").alias(c) for c in "xyz"))
                trace = members.select(F.col("image").alias("image0"), F.col("kp_idx").alias("idx0"), "trace_id")
                rows = kept.join(trace, ["image0", "idx0"]).join(found, "trace_id").drop("trace_id")
                kept, (_, _, second) = _good(match_errors(rows, rig, distance), factor)
        free = FIRST_PASS if turn == 0 else tuple(p for p in ALL if p != "position" or not lock_positions)
        done = bundle_adjust(obs, rig.table(spark), None, "trace_id", free, shared, tolerance=1e-2 if turn == 0 else 1e-4)
        rig, points = Rig.of(done.cameras), done.points
        report.append({"matches": int(total), "invisible": int(invisible), "outliers": int(total - invisible - second), "rmse_before": done.rmse[0], "rmse_after": done.rmse[-1]})
        after = report[-1]["rmse_after"]
        if turn and (after < 1e-3 or (turn > 1 and after >= report[-2]["rmse_after"] * (1 - tolerance))):
            break
    if points is None:
        points = spark.createDataFrame([], "trace_id string, part int, x double, y double, z double")
    return Calibration(rig.table(spark), points, report)
