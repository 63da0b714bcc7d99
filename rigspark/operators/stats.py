"""Grouped statistics: floor-index percentiles, reports, histograms, fits of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigspark.scratch import small, written


#: Rows of a group up to which they are sorted in one task.
GROUP_ROWS = 1_000_000
#: Accuracy of the sketch that narrows larger groups: ranks are off by one in so many rows at most.
SKETCH = 10_000


def floor_percentile(df: DataFrame, keys: list[str], v: str, ps: list[float]) -> DataFrame:
    """For each group and p the value at 0-based place ``floor(p * n)``: ``(*keys, p, value)``.

    No interpolation.  Null and NaN do not count; a group without other values, and a place that
    the group does not have (p of 1), has no row.

    Plan: groups of at most :data:`GROUP_ROWS` rows are sorted; see :func:`select_ranks` for the
    way where there is a larger one.
    """
    rows = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > GROUP_ROWS:
        return select_ranks(rows, keys, v, ps)
    w = Window.partitionBy(*keys)
    rows = rows.select(*keys, F.col(v).alias("value"), F.row_number().over(w.orderBy(v)).alias("__rn"), F.count(F.lit(1)).over(w).alias("__n"))
    at = F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.floor(F.lit(float(p)) * F.col("__n")) + 1).alias("at")) for p in ps))
    rows = rows.withColumn("__p", F.explode(F.filter(at, lambda s: s["at"] == F.col("__rn"))))
    return rows.select(*keys, F.col("__p.p").alias("p"), "value")


def select_ranks(rows: DataFrame, keys: list[str], v: str, ps: list[float]) -> DataFrame:
    """:func:`floor_percentile` of groups of any size, without sorting one.

    A sketch of each group, summed over the tasks, gives two values between which each place must
    lie; one more pass counts the rows below them and those of each value between.  The place is
    then found among the distinct values of a range that holds about one row in
    ``SKETCH / 6``.  Should a sketch miss its bound the job fails rather than give another value.
    """
    x, slack = F.col(v).cast("double"), 3.0 / SKETCH
    ends = [min(max(float(p) + s, 0.0), 1.0) for p in ps for s in (-slack, slack)]
    sketch = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(x, ends, SKETCH).alias("__e"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    # The sketch's value at the ends of the scale are the least and the largest.
    edge = lambda i, p, name: F.col(name) if ends[i] in (0.0, 1.0) else F.col("__e")[i]
    ranges = F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.floor(F.lit(float(p)) * F.col("__n")) + 1).alias("at"), edge(2 * i, p, "__lo").alias("low"), edge(2 * i + 1, p, "__hi").alias("high")) for i, p in enumerate(ps)))
    bounds = small(written(sketch.select(*(f"__{k}" for k in keys), ranges.alias("__r"))))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = rows.join(bounds, same) if keys else rows.crossJoin(bounds)
    both = both.select(*keys, F.col(v).alias("value"), x.alias("__x"), F.explode("__r").alias("__r")).where(F.col("__x") <= F.col("__r.high"))
    below = F.col("__x") < F.col("__r.low")
    counts = both.groupBy(*keys, F.col("__r.p").alias("p"), F.col("__r.at").alias("__at"), F.when(~below, F.col("value")).alias("value"), below.alias("__below")).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys, "p")
    until = F.sum("__c").over(w.orderBy(F.desc("__below"), "value"))
    found = counts.withColumn("__u", until).withColumn("__all", F.sum("__c").over(w)).where((F.col("__u") >= F.col("__at")) & (F.col("__u") - F.col("__c") < F.col("__at")))
    sure = F.when(~F.col("__below"), F.col("value")).otherwise(F.raise_error(F.lit("the sketch missed a place")).cast(rows.schema[v].dataType))
    return found.select(*keys, "p", sure.alias("value"))


def median_vector(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Median of each column, the mean of the two middle values for even counts."""
    return df.groupBy(*keys).agg(*(F.percentile(c, 0.5).alias(c) for c in cols))


def patch_medians(pixels: DataFrame, masks: DataFrame, on: list[str], keys: list[str], v: str) -> DataFrame:
    """Floor-index median of the pixels below a mask, for each key (patch, channel)."""
    return floor_percentile(pixels.join(masks, on), keys, v, [0.5]).drop("p")


def histogram(df: DataFrame, keys: list[str], v: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts and their log2 over equal bins; values outside fall into the end bins."""
    b = F.least(F.greatest(F.floor((F.col(v) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log2(F.col("n") + 1.0))


def cumulative_threshold(hist: DataFrame, keys: list[str], least: int, first_bin: int = 1) -> DataFrame:
    """First bin from ``first_bin`` on up to which more than ``least`` values were counted."""
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    rows = hist.where(F.col("bin") >= first_bin).withColumn("__run", run).where(F.col("__run") > least)
    return rows.groupBy(*keys).agg(F.min("bin").alias("bin"))


def extents(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))))


def worst_case_bounds(groups: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Over extents of several cameras: the largest minimum and the smallest maximum."""
    return groups.groupBy(*keys).agg(*(f(f"{n}_{c}").alias(f"{n}_{c}") for c in cols for n, f in (("min", F.max), ("max", F.min))))


#: Linear gray levels of the chart, darkest first.
GRAYS = (6, 21, 49, 92, 150, 233)


def gray_response(patches: DataFrame, keys: list[str], level: str, v: str) -> DataFrame:
    """Line through the second darkest and second brightest gray: slope, y at 0, x at 0 and at 1."""
    dark, bright = GRAYS[1] / 255, GRAYS[4] / 255
    ends = patches.groupBy(*keys).agg(F.max(F.when(F.col(level) == 1, F.col(v))).alias("yd"), F.max(F.when(F.col(level) == 4, F.col(v))).alias("yb"))
    slope = (F.col("yb") - F.col("yd")) / (bright - dark)
    out = ends.withColumn("slope", slope).withColumn("y0", F.col("yd") - F.col("slope") * dark)
    return out.select(*keys, "slope", "y0", (-F.col("y0") / F.col("slope")).alias("x_min"), ((1 - F.col("y0")) / F.col("slope")).alias("x_max"))


def color_error(patches: DataFrame, reference: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Distance in Lab to the reference for each patch, and its mean over the keys."""
    p, r = patches.alias("p"), small(reference).alias("r")
    d = sum(((F.col(f"p.{c}") - F.col(f"r.{c}")) * (F.col(f"p.{c}") - F.col(f"r.{c}")) for c in ("l", "a", "b")), F.lit(0.0))
    rows = p.join(r, on).withColumn("error", F.sqrt(d))
    return rows.select(*dict.fromkeys([*keys, *on]), "error").withColumn("mean_error", F.avg("error").over(Window.partitionBy(*keys)))


def rmse(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], v: str = "v") -> DataFrame:
    """Root mean square difference over the cells that both have."""
    d = F.col(f"a.{v}") - F.col(f"b.{v}")
    return a.alias("a").join(b.alias("b"), on).groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def error_report(df: DataFrame, keys: list[str], v: str, worst: int = 3) -> DataFrame:
    """Count, RMSE, mean, floor-index median, 90 and 99 %, and the largest errors, descending."""
    agg = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rmse"), F.avg(v).alias("mean"))
    ps = floor_percentile(df, keys, v, [0.5, 0.9, 0.99]).groupBy(*keys).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))))
    top = worst_k(df, keys, v, worst).groupBy(*keys).agg(F.sort_array(F.collect_list(v), asc=False).alias("worst"))
    return agg.join(ps, keys).join(top, keys)


def worst_k(df: DataFrame, keys: list[str], v: str, k: int, tiebreak: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(v), *(tiebreak or []))
    return df.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")


def best_by(df: DataFrame, keys: list[str], score: Column, tiebreak: list[str], largest: bool = True) -> DataFrame:
    """The row with the best score of each group; ties go to the smallest tiebreak."""
    order = F.desc("__score") if largest else F.asc("__score")
    rows = df.withColumn("__score", score)
    w = Window.partitionBy(*keys).orderBy(order, *tiebreak)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__score")


def component_stats(labels: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """Area, bounding box, centroid and filled share of the box."""
    out = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.avg(y).alias("cy"), F.avg(x).alias("cx"))
    return out.withColumn("fill", F.col("area") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)))


def filter_patches(stats: DataFrame, least: float, most: float, aspect: float = 2.0, fill: float = 0.7) -> DataFrame:
    """Components that may be chart patches: area within the band, compact, and filled."""
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return stats.where(F.col("area").between(least, most) & (F.greatest(h, w) / F.least(h, w) < aspect) & (F.col("fill") >= fill))


def filter_round(stats: DataFrame, least: float, share: float = 0.3) -> DataFrame:
    """Components that fill at least ``share`` of the circle around their box."""
    r = F.greatest(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1) / 2
    return stats.where((F.col("area") >= least) & (F.col("area") / (F.pi() * r * r) >= share))


def intensity_ratio(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], v: str, alpha: str) -> DataFrame:
    """Ratio of the sums of two images, each cell weighted by both alphas."""
    w = F.col(f"a.{alpha}") * F.col(f"b.{alpha}")
    rows = a.alias("a").join(b.alias("b"), on).groupBy(*keys).agg(F.sum(w * F.col(f"a.{v}")).alias("sa"), F.sum(w * F.col(f"b.{v}")).alias("sb"))
    return rows.select(*keys, (F.col("sa") / F.nullif(F.col("sb"), F.lit(0.0))).alias("ratio"))


def flatten_softmax(layers: DataFrame, cell: list[str], v: str, alpha: str, k: float) -> DataFrame:
    """Layers merged with weights ``exp(k * alpha) - 1``."""
    w = F.exp(k * F.col(alpha)) - 1
    return layers.groupBy(*cell).agg((F.sum(w * F.col(v)) / F.nullif(F.sum(w), F.lit(0.0))).alias(v))


def rejection_counts(df: DataFrame, keys: list[str], err: str, limit: Column) -> DataFrame:
    """Total, invisible (null or NaN) and outliers (not below the limit)."""
    gone = F.col(err).isNull() | F.isnan(err)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("invisible"), F.count_if(~gone & (F.col(err) >= limit)).alias("outliers"))


def reject_outliers(df: DataFrame, keys: list[str], err: str, factor: float, passes: Column | None = None) -> DataFrame:
    """Rows whose error is below ``factor`` times their group's floor-index median.

    Rows without an error go.  Rows for which ``passes`` holds stay whatever their error.
    """
    limits = floor_percentile(df, keys, err, [0.5]).select(*keys, (F.col("value") * factor).alias("__limit"))
    keep = ~F.isnan(err) & (F.col(err) < F.col("__limit"))
    keep = F.coalesce(keep, F.lit(False)) if passes is None else F.coalesce(keep, F.lit(False)) | passes
    return df.join(limits, keys, "left").where(keep).drop("__limit")


def average_at_distance(rays: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Mean of the points at a distance along each ray (columns ox..oz, dx..dz)."""
    return rays.groupBy(*keys).agg(*(F.avg(F.col(f"o{c}") + distance * F.col(f"d{c}")).alias(c) for c in "xyz"))


#: Points of a group up to which all of them are compared with each other.
NEAR_POINTS = 2_048
#: Points of a grid cell at which the search begins.
CELL_POINTS = 64


def nearest_distance(points: DataFrame, keys: list[str], ident: str, x: str, y: str) -> DataFrame:
    """Distance of each point to the nearest other point of its group: ``(*keys, ident, __d)``.

    ``ident`` is unique in a group.  Points without a coordinate, and points alone in their group,
    have no row.

    Plan: where a group has more than :data:`NEAR_POINTS`, a grid.  The search begins with cells
    that hold at most :data:`CELL_POINTS` places; a place looks around itself and is done once it
    has found another within a cell's width.  The others, which are few to a cell, look again in
    cells four times as wide.
    """
    points = points.select(*keys, F.col(ident), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("not isnan(__x) and not isnan(__y)")
    most = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    gap = lambda a, b: F.sqrt((F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2)
    if most <= NEAR_POINTS:
        others = points.select(*keys, *(F.col(c).alias(f"__o{c}") for c in (ident, "__x", "__y")))
        near = points.join(others, keys).where(F.col(ident) != F.col(f"__o{ident}"))
        return near.groupBy(*keys, ident).agg(F.min(gap("__", "__o__")).alias("__d"))
    # Points in the same place are at distance 0; beyond that only places matter.
    places = written(points.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n")))
    box = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.max("__x").alias("__bx"), F.min("__x").alias("__ax"), F.max("__y").alias("__by"), F.min("__y").alias("__ay"))
    wide, high = F.col("__bx") - F.col("__ax"), F.col("__by") - F.col("__ay")
    width = F.greatest(F.sqrt(wide * high / F.col("__m")), F.greatest(wide, high) / F.col("__m"))
    grid = written(box.where("__m > 1").select(*keys, "__ax", "__ay", width.alias("__s"), F.greatest(wide, high).alias("__size")))

    def celled(rows: DataFrame, grid: DataFrame) -> DataFrame:
        at = {c: F.floor((F.col(f"__{c}") - F.col(f"__a{c}")) / F.col("__s")) for c in "xy"}
        return rows.join(small(grid), keys).withColumns({f"__g{c}": v for c, v in at.items()}).drop("__ax", "__ay")

    while True:
        crowd = celled(places, grid).groupBy(*keys, "__gx", "__gy").count().groupBy(*keys).agg(F.max("count").alias("__c"))
        # A width near the spacing of doubles cannot part places any more.
        crowd = written(crowd.join(grid, keys).where((F.col("__c") > CELL_POINTS) & (F.col("__s") > F.col("__size") * 1e-12)).select(*keys, F.lit(0.25).alias("__f")))
        if crowd.isEmpty():
            break
        grid = written(grid.join(crowd, keys, "left").withColumn("__s", F.col("__s") * F.coalesce("__f", F.lit(1.0))).drop("__f"))
    found, left = places.where("__n > 1").select(*keys, "__x", "__y", F.lit(0.0).alias("__d")), places.where("__n = 1").drop("__n")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    while True:
        held = celled(places.drop("__n"), grid).select(*keys, "__gx", "__gy", F.col("__x").alias("__o__x"), F.col("__y").alias("__o__y"))
        look = celled(left, grid).withColumn("__t", around).withColumns({"__gx": F.col("__gx") + F.col("__t.i"), "__gy": F.col("__gy") + F.col("__t.j")})
        pairs = look.join(held, [*keys, "__gx", "__gy"], "left").withColumn("__d", gap("__", "__o__"))
        pairs = pairs.withColumn("__d", F.when((F.col("__x") != F.col("__o__x")) | (F.col("__y") != F.col("__o__y")), F.col("__d")))
        best = written(pairs.groupBy(*keys, "__x", "__y", "__s", "__size").agg(F.min("__d").alias("__d")))
        done = (F.col("__d") <= F.col("__s")) | (F.col("__s") > F.col("__size"))
        found = found.unionByName(best.where(done & F.col("__d").isNotNull()).select(*found.columns))
        left = best.where(~F.coalesce(done, F.lit(False))).select(*left.columns)
        if left.isEmpty():
            break
        grid = grid.withColumn("__s", F.col("__s") * 4)
    return points.join(found, [*keys, "__x", "__y"]).select(*keys, ident, "__d")


def remove_isolated(points: DataFrame, keys: list[str], ident: str, x: str, y: str, factor: float = 2.0) -> DataFrame:
    """Points whose nearest other point of the group is nearer than ``factor`` times the median of those."""
    near = written(nearest_distance(points, keys, ident, x, y))
    limit = floor_percentile(near, keys, "__d", [0.5]).select(*keys, (F.col("value") * factor).alias("__limit"))
    kept = near.join(limit, keys).where("__d < __limit").select(*keys, ident)
    return points.join(kept, [*keys, ident], "left_semi")
