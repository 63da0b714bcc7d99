"""Rig reports, geometric calibration, chart detection, color and vignetting calibration."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigspark.functions import camera as C
from rigspark.functions.scalars import black_level
from rigspark.operators import bands as BD
from rigspark.operators import fit as FT
from rigspark.operators import grid as GD
from rigspark.operators import stats as D
from rigspark.scratch import small, spread, written


def visible_observations(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each point with each camera that sees it, and its pixel ``px, py``.

    A rig has few cameras: they are broadcast after a check of their number.
    """
    p = tuple(F.col(c) for c in "xyz")
    rows = points.crossJoin(small(C.unfold(cameras))).where(~C.outside_fov(p, C.unfolded))
    rows = C.with_projected(rows, p, get=C.unfolded).where(C.in_frame(F.col("px"), F.col("py"), C.unfolded))
    return rows.select(*points.columns, *cameras.columns, "px", "py")


def camera_by_direction(directions: DataFrame, cameras: DataFrame, keys: list[str], farthest: float = 1.0) -> DataFrame:
    """The camera that looks most along (dx, dy, dz); of equals the first in the rig.

    Only cameras whose axis passes within ``farthest`` of the centre count.
    """
    rows = directions.crossJoin(small(cameras.where(C.axis_distance() <= farthest)))
    score = F.round(F.col("dx") * F.col("forward")[0] + F.col("dy") * F.col("forward")[1] + F.col("dz") * F.col("forward")[2], 9)
    return D.best_by(rows.withColumn("score", score), keys, F.col("score"), ["ordinal"])


def rig_summary(cameras: DataFrame) -> DataFrame:
    """Of the side cameras: ring radius and largest half field of view; least usable radius of all."""
    side = F.col("grp").contains("side")
    o = F.col("origin")
    radius = F.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])
    one = cameras.agg(F.max(F.when(side, radius)).alias("radius"), F.max(F.when(side, C.approx_fov(True))).alias("half_fov"))
    return one.crossJoin(usable_radius(cameras).agg(F.min("usable").alias("usable")))


def usable_radius(cameras: DataFrame, samples: int = 10) -> DataFrame:
    """Per camera the least distance from the image centre at which its field of view ends.

    Samples directions on the cone of the half field of view; at a right angle a flat camera has
    no image of the cone's edge, so the image's diagonal caps the result.
    """
    rows = cameras.withColumn("__a", F.explode(F.array(*(F.lit(2 * math.pi * k / samples) for k in range(samples))))).withColumn("__h", C.fov_of(C.fov_threshold()))
    f, u, r = (tuple(F.col(a)[i] for i in range(3)) for a in ("forward", "up", "right"))
    ray = [F.cos("__h") * f[i] + F.sin("__h") * (F.cos("__a") * r[i] + F.sin("__a") * u[i]) for i in range(3)]
    rows = rows.withColumns({f"__{n}": F.col("origin")[i] + C.NEAR_INFINITY * ray[i] for i, n in enumerate("xyz")})
    rows = rows.withColumn("__p", C.projected(tuple(F.col(f"__{n}") for n in "xyz")))
    px, py = F.col("__p.u"), F.col("__p.v")
    rows = rows.withColumn("__d", F.sqrt((px - F.col("resolution")[0] / 2) ** 2 + (py - F.col("resolution")[1] / 2) ** 2))
    diagonal = F.sqrt(F.col("resolution")[0] ** 2 + F.col("resolution")[1] ** 2)
    return rows.groupBy("id").agg(F.min(F.when(F.isnan("__d"), diagonal).otherwise(F.least("__d", diagonal))).alias("usable"))


def overlap_fraction(cameras: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """For each pair of cameras of a rig the share of an n x n grid of the first's pixels that the second sees.

    ``keys``: columns that name the rig, where there are several.
    """
    keys = keys or []
    probes = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = cameras.withColumn("i", probes).withColumn("j", probes)
    far = C.near_infinity(F.col("i") / (n - 1) * F.col("resolution")[0], F.col("j") / (n - 1) * F.col("resolution")[1])
    a = a.select(*keys, F.col("id").alias("first"), *(c.alias(x) for x, c in zip("xyz", far, strict=True)))
    b = C.unfold(cameras)
    b = b.select(*keys, F.col("id").alias("second"), "type", *(c for c in b.columns if c not in cameras.columns))
    if keys:
        # A pair costs far more than its bytes, so partitions are not put together by size.
        a, b = spread(a, *keys), spread(b, *keys)
    rows = (a.join(b, keys) if keys else a.crossJoin(small(b))).where(F.col("first") != F.col("second"))
    p = tuple(F.col(c) for c in "xyz")
    rows = rows.withColumn("__in", ~C.outside_fov(p, C.unfolded))
    rows = C.with_projected(rows, p, "__u", "__v", C.unfolded)
    seen = F.coalesce(F.col("__in") & C.in_frame(F.col("__u"), F.col("__v"), C.unfolded), F.lit(False))
    return rows.groupBy(*keys, "first", "second").agg(F.avg(seen.cast("double")).alias("overlap"))


def rig_rmse(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Root mean square differences of two rigs by camera id, and of the angles between axes.

    Angles count for pairs of cameras whose axes are less than a radian apart.  ``keys``: columns
    that name the rig, where there are several; without them all cameras are one rig.
    """
    keys = keys or []

    def sq(col: str, n: int) -> Column:
        return sum(((F.col(f"a.{col}")[i] - F.col(f"b.{col}")[i]) ** 2 for i in range(n)), F.lit(0.0))

    rows = a.alias("a").join((b if keys else small(b)).alias("b"), [*keys, "id"])
    sizes = {"origin": 3, "forward": 3, "up": 3, "right": 3, "principal": 2, "distortion": 2, "focal": 2}
    one = rows.groupBy(*keys).agg(*(F.sqrt(F.avg(sq(c, n))).alias(c) for c, n in sizes.items()))
    axis = lambda df, n: df.select(*keys, F.col("id").alias(n), F.col("forward").alias(f"f{n}"))
    angle = lambda p: F.acos(F.least(F.greatest(C.dot(tuple(F.col(f"{p}.fi")[k] for k in range(3)), tuple(F.col(f"{p}.fj")[k] for k in range(3))), F.lit(-1.0)), F.lit(1.0)))
    pairs = [axis(r, "i").join(axis(r, "j"), keys).where("i < j") if keys else axis(r, "i").join(small(axis(r, "j")), F.col("i") < F.col("j")) for r in (a, b)]
    both = pairs[0].alias("p").join((pairs[1] if keys else small(pairs[1])).alias("q"), [*keys, "i", "j"]).where(angle("p") < 1)
    angles = both.groupBy(*keys).agg(F.sqrt(F.avg((angle("p") - angle("q")) ** 2)).alias("angles"))
    return one.join(angles, keys, "left") if keys else one.crossJoin(angles)


def match_report(matches: DataFrame, keypoints: DataFrame, cameras: DataFrame, points: DataFrame, camera_of, least: float = 0.1) -> DataFrame:
    """Matches of camera pairs that overlap enough, with both keypoints and the triangulated point."""
    obs = matches.join(points, "trace_id")
    for side in (0, 1):
        kp = keypoints.select(F.col("image").alias(f"image{side}"), F.col("kp_idx").alias(f"idx{side}"), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
        obs = obs.join(kp, [f"image{side}", f"idx{side}"])
    pairs = overlap_fraction(cameras).where(F.col("overlap") >= least)
    obs = obs.withColumn("first", camera_of("image0")).withColumn("second", camera_of("image1"))
    return obs.join(small(pairs), ["first", "second"])


# Charts.
#: The blur before a chart is looked for, and how far gaps are closed.
CHART_BLUR, CHART_GAP = (5, 1.0), 1
#: Rows of a band in which it is looked for.
CHART_ROWS = 256


def _dark_parts(v: np.ndarray, block: int, c: float) -> np.ndarray:
    """1 where a cell, blurred, is above its neighbourhood's mean less ``c`` and no gap of what is not."""

    def along(a: np.ndarray, axis: int, r: int, edge: dict) -> list[np.ndarray]:
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], **edge)
        return [p[i : i + len(a)] if axis == 0 else p[:, i : i + a.shape[1]] for i in range(2 * r + 1)]

    def box(a: np.ndarray, r: int, f, outside: float) -> np.ndarray:
        for axis in (1, 0):
            a = functools.reduce(f, along(a, axis, r, {"constant_values": outside}))
        return a

    # Terms are added in the order of their places, so a cell's sum is the same in any band.
    weights = GD.gaussian_weights(*CHART_BLUR)
    for axis in (1, 0):
        v = functools.reduce(np.add, [w * t for w, t in zip(weights, along(v, axis, CHART_BLUR[0] // 2, {"mode": "reflect"}), strict=True)])
    mean = box(v, block // 2, np.add, 0.0) / box(np.ones_like(v), block // 2, np.add, 0.0)
    mask = np.where(v > mean - c, 0.0, 1.0)
    closed = box(box(mask, CHART_GAP, np.maximum, 0.0), CHART_GAP, np.minimum, 1.0)
    return np.where(closed < 0.5, 1.0, 0.0)


def detect_patches(images: DataFrame, keys: list[str], least: float, most: float, per_row: int, block: int = 19, c: float = 0.02) -> DataFrame:
    """Chart patches of gray images ``(keys, y, x, v)``: ``(keys, place, cy, cx, area, label)``.

    Brightened, blurred, compared with the local mean, gaps closed, labelled, filtered by size,
    shape and isolation, and put in reading order.  An image has all cells of its rows and columns;
    its lines are dealt in bands up to the labels.
    """
    bright = BD.lines(images.withColumn("v", F.least(F.col("v") * 2, F.lit(1.0))), keys, ["v"])
    halo = CHART_BLUR[0] // 2 + block // 2 + 2 * CHART_GAP
    dark = BD.banded(bright, keys, ["v"], halo, lambda b: {"mask": _dark_parts(b["v"], block, c)[b.own]}, ["mask"], CHART_ROWS)
    labels = GD.label_grid(BD.cells(dark, keys, ["mask"]), keys)
    stats = written(D.filter_patches(D.component_stats(labels, [*keys, "label"]), least, most))
    near = D.remove_isolated(stats, keys, "label", "cx", "cy")
    from rigspark.operators.sequence import raster_order

    return raster_order(near, keys, per_row, "cx", "cy").select(*keys, "place", "cy", "cx", "area", "label")


def black_hole_level(pixels: DataFrame, keys: list[str], bins: int = 256, share: float = 0.02, least: int = 9) -> DataFrame:
    """Median of the darkest round blob of each image: its black level."""
    total = pixels.groupBy(*keys).count()
    need = int((total.agg(F.min("count")).first()[0] or 0) * share)
    limit = D.cumulative_threshold(D.histogram(pixels, keys, "v", bins, 0.0, 1.0), keys, need, 0)
    dark = pixels.join(small(limit.withColumnRenamed("bin", "__bin")), keys).withColumn("mask", F.when(F.col("v") * bins <= F.col("__bin") + 1, 1).otherwise(0))
    labels = GD.label_grid(dark, keys)
    blobs = D.filter_round(D.component_stats(labels, [*keys, "label"]), least)
    best = D.best_by(blobs, keys, F.col("area"), ["label"])
    cells = labels.join(small(best.select(*keys, "label")), [*keys, "label"])
    return D.patch_medians(pixels, cells.select(*keys, "y", "x"), [*keys, "y", "x"], keys, "v").withColumnRenamed("value", "black_level")


def chart_reference(spark) -> DataFrame:
    """Lab colors of the 24 patches under D50: ``(illuminant, patch, l, a, b)``."""
    return spark.createDataFrame([("D50", i, *map(float, v)) for i, v in enumerate(CHART_D50)], "illuminant string, patch int, l double, a double, b double")


#: The chart's patches in Lab under D50.
CHART_D50 = (
    (37.99, 13.56, 14.06), (65.71, 18.13, 17.81), (49.93, -4.88, -21.93), (43.14, -13.10, 21.91), (55.11, 8.84, -25.40), (70.72, -33.40, -0.199),
    (62.66, 36.07, 57.10), (40.02, 10.41, -45.96), (51.12, 48.24, 16.25), (30.33, 22.98, -21.59), (72.53, -23.71, 57.26), (71.94, 19.36, 67.86),
    (28.78, 14.18, -50.30), (55.26, -38.34, 31.37), (42.10, 53.38, 28.19), (81.73, 4.04, 79.82), (51.94, 49.99, -14.57), (51.04, -28.63, -28.64),
    (96.54, -0.425, 1.186), (81.26, -0.638, -0.335), (66.77, -0.734, -0.504), (50.87, -0.153, -0.270), (35.66, -0.421, -1.231), (20.46, -0.079, -0.973),
)


def patch_colors(images: DataFrame, keys: list[str], patches: DataFrame) -> DataFrame:
    """Median ``r, g, b`` of the middle of each patch: ``(keys, patch, cx, cy, r, g, b)``.

    ``images``: ``(keys, y, x, r, g, b)``; ``patches``: :func:`detect_patches`, whose reading order
    numbers them.  The middle is a square of half the patch's side.
    """
    half = F.greatest(F.floor(F.sqrt("area") / 4), F.lit(0))
    around = patches.select(*keys, F.col("place").cast("int").alias("patch"), "cx", "cy", F.explode(F.sequence(-half, half)).alias("__dy"), half.alias("__half"))
    around = around.select(*keys, "patch", "cx", "cy", "__dy", F.explode(F.sequence(-F.col("__half"), F.col("__half"))).alias("__dx"))
    cells = around.select(*keys, "patch", "cx", "cy", (F.round("cy") + F.col("__dy")).cast("long").alias("y"), (F.round("cx") + F.col("__dx")).cast("long").alias("x"))
    rows = cells.join(images.select(*keys, "y", "x", "r", "g", "b"), [*keys, "y", "x"])
    return D.median_vector(rows, [*keys, "patch", "cx", "cy"], ["r", "g", "b"])


def chart_colors(images: DataFrame, keys: list[str], least: float, most: float, per_row: int = 6, block: int = 19, c: float = 0.02) -> DataFrame:
    """:func:`patch_colors` of the charts found in color images ``(keys, y, x, r, g, b)``."""
    gray = images.select(*keys, "y", "x", ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("v"))
    return patch_colors(images, keys, written(detect_patches(gray, keys, least, most, per_row, block, c)))


def calibrate_color(patches: DataFrame, keys: list[str], illuminant: str = "D50", common_black: bool = False, place: tuple[str, str] | None = None, steps: int = 15) -> DataFrame:
    """Black level, white balance and color matrix per camera from its patches' ``r, g, b``.

    ``common_black``: a second pass holds the black level, the median of the cameras', and fits
    the rest again; ``error_before`` is then the first pass's error.  ``place``: fit an uneven
    illumination as well, see ``fit_color``.  Adds the worst-case clamps over all cameras.
    """
    ref = chart_reference(patches.sparkSession).where(F.col("illuminant") == illuminant)
    rows = patches.join(F.broadcast(ref.select("patch", F.col("l").alias("l0"), F.col("a").alias("a0"), F.col("b").alias("b0"))), "patch")
    fitted = FT.fit_color(rows, keys, illuminant, steps, place)
    if common_black:
        fitted = written(fitted)
        black = fitted.agg(F.array(*(F.percentile(F.col("params")[i], 0.5) for i in range(3))).alias("black"))
        again = FT.fit_color(rows.crossJoin(F.broadcast(black)), keys, illuminant, steps, place, "black")
        fitted = again.join(fitted.select(*keys, F.col("error").alias("error_before")), keys)
    more = [c for c in ("light_x", "light_y", "error_before") if c in fitted.columns]
    m = [[F.col("params")[3 + 3 * i + j] for j in range(3)] for i in range(3)]
    gains, ccm = FT.decompose_color(m)
    lo = [F.min(F.col(c)) for c in "rgb"]
    hi = [F.max(F.col(c)) for c in "rgb"]
    ext = patches.groupBy(*keys).agg(*(f.alias(n) for n, f in zip(("lr", "lg", "lb"), lo, strict=True)), *(f.alias(n) for n, f in zip(("hr", "hg", "hb"), hi, strict=True)))
    worst = ext.agg(F.array(F.max("lr"), F.max("lg"), F.max("lb")).alias("clamp_min"), F.array(F.min("hr"), F.min("hg"), F.min("hb")).alias("clamp_max"))
    out = fitted.select(*keys, F.slice("params", 1, 3).alias("black_level"), F.array(*gains).alias("white_balance"), F.array(*(F.array(*r) for r in ccm)).alias("ccm"), "error", *more)
    return out.crossJoin(F.broadcast(worst))


def vignetting_samples(images: DataFrame, keys: list[str], image: str, patch: int, size: tuple[int, int], **detect) -> DataFrame:
    """Samples for :func:`calibrate_vignetting` from images of a chart that moves about.

    ``images``: ``(keys, image, y, x, r, g, b)`` of ``size`` rows and columns.  In each image the
    same patch gives its place and its median color.
    """
    found = chart_colors(images, [*keys, image], **detect).where(F.col("patch") == patch)
    return found.select(*keys, ((F.col("cx") + 0.5) / size[1]).alias("x"), ((F.col("cy") + 0.5) / size[0]).alias("y"), F.posexplode(F.array("r", "g", "b")).alias("ch", "v"))


def calibrate_vignetting(samples: DataFrame, keys: list[str], black: float = 0.0, rounds: int = 20) -> DataFrame:
    """Vignetting curves per camera and channel from ``(keys, ch, x, y, v)``; x and y in [0, 1]."""
    rows = samples.withColumn("v", black_level(F.col("v"), black))
    top = rows.groupBy(*keys, "ch").agg(F.max("v").alias("__top"))
    rows = rows.join(small(top), [*keys, "ch"]).withColumn("t", F.col("__top") / F.col("v"))
    return FT.fit_vignetting(rows, [*keys, "ch"], "x", "y", "t", rounds=rounds)
