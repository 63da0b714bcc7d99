"""Queries of camera geometry on the rig and the points around it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.catalog import query, r6, s6
from rigspark.functions import camera as C
from rigspark.scratch import written

P, RIG, CAMERAS = B.POINTS_SQL, B.rig_sql(), B.cameras_sql()


def _all(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).crossJoin(F.broadcast(B.rig(spark)))


def _xyz() -> tuple:
    return tuple(F.col(c) for c in "xyz")


_CAM = f"(select *, rx*(x-ox)+ry*(y-oy)+rz*(z-oz) cx, ux*(x-ox)+uy*(y-oy)+uz*(z-oz) cy, -(fx*(x-ox)+fy*(y-oy)+fz*(z-oz)) cz, (x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz) vv from ({P}) p, {RIG} c)"
_SC = "case when type='FTHETA' then case when cx*cx+cy*cy=0 then 0 else atan2(sqrt(cx*cx+cy*cy),-cz)/sqrt(cx*cx+cy*cy) end else 1/-cz end"
_THR = "case when fov is not null then cos(fov)*abs(cos(fov)) when type='FTHETA' then -1.0 else 0.0 end"
_PX = f"(select *, cx*({_SC})*focx+1024 px, cy*({_SC})*focy+1024 py, (-cz)*abs(cz)<=({_THR})*vv outside from {_CAM} where cz<>0)"


@query(f"select point_id, id, {s6('px', 4)} px, {s6('py', 4)} py from {_PX} where not outside")
def b16_project(spark: SparkSession, d: str) -> DataFrame:
    u, v = C.project(_xyz())
    rows = _all(spark, d).where((C.in_camera(_xyz())[2] != 0) & ~C.outside_fov(_xyz()))
    return rows.select("point_id", "id", r6(u, 4).alias("px"), r6(v, 4).alias("py"))


@query(f"select point_id, id, cz>=0 behind, outside, (not outside and px>=0 and px<2048 and py>=0 and py<2048) sees from {_PX}")
def b18_visibility(spark: SparkSession, d: str) -> DataFrame:
    rows = _all(spark, d).where(C.in_camera(_xyz())[2] != 0)
    return rows.select("point_id", "id", C.is_behind(_xyz()).alias("behind"), C.outside_fov(_xyz()).alias("outside"), C.sees(_xyz()).alias("sees"))


@query(f"select point_id, id from {_PX} where not outside and px>=0 and px<2048 and py>=0 and py<2048")
def c4_visible_observations(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import visible_observations

    return visible_observations(B.points(spark, d), B.rig(spark)).select("point_id", "id")


_ANG = "case when type='FTHETA' then n else atan(n) end"
_RAY = f"(select *, sin({_ANG})/n*sx ax, sin({_ANG})/n*sy ay, -cos({_ANG}) az from (select *, sqrt(sx*sx+sy*sy) n from (select point_id, id, type, rx,ry,rz,ux,uy,uz,fx,fy,fz, (px-1024)/focx sx, (py-1024)/focy sy from (select point_id, (point_id*37)%2000+3.5 px, (point_id*91)%2000+7.5 py from ({P})), {RIG})))"


@query(f"select point_id, id, {', '.join(s6(f'r{a}*ax+u{a}*ay-f{a}*az') + f' d{a}' for a in 'xyz')} from {_RAY}")
def b17_unproject(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("point_id")
    ray = C.unproject((i * 37 % 2000 + 3.5).cast("double"), (i * 91 % 2000 + 7.5).cast("double"))
    return _all(spark, d).select("point_id", "id", *(r6(c).alias(f"d{a}") for a, c in zip("xyz", ray, strict=True)))


@query(f"select k, id, {s6('focx*0.5', 4)} focal, 1024.0::double width from {CAMERAS}")
def b20_rescale_camera(spark: SparkSession, d: str) -> DataFrame:
    half = B.cameras(spark, d).withColumns(C.rescale_camera(0.5))
    return half.select("k", "id", r6(F.col("focal")[0], 4).alias("focal"), F.col("resolution")[0].alias("width"))


_HALF = "case when type='FTHETA' then 1024/abs(focx) else atan(1024/abs(focx)) end"


@query(f"select k, id, {s6(_THR)} threshold, {s6(_HALF)} half_fov from {CAMERAS}")
def b21_fov(spark: SparkSession, d: str) -> DataFrame:
    return B.cameras(spark, d).select("k", "id", r6(C.fov_threshold()).alias("threshold"), r6(C.approx_fov(True)).alias("half_fov"))


@query(f"select k, id, {s6('sqrt(greatest(power(ox-t*fx,2)+power(oy-t*fy,2)+power(oz-t*fz,2),0))')} distance from (select *, ox*fx+oy*fy+oz*fz t from {CAMERAS})")
def b22_axis_distance(spark: SparkSession, d: str) -> DataFrame:
    return B.cameras(spark, d).select("k", "id", r6(C.axis_distance()).alias("distance"))


_EQ = "(select point_id, point_id%64 x, (point_id*7)%32 y from ({p}))".format(p=P)


@query(f"""select point_id, {s6('sin((y+0.5)*pi()/32)*cos((x+0.5)*2*pi()/64)')} dx, {s6('sin((y+0.5)*pi()/32)*sin((x+0.5)*2*pi()/64)')} dy, {s6('cos((y+0.5)*pi()/32)')} dz,
 {s6('64*(case when fy<0 or (fy=0 and false) then atan2(fy,fx)+2*pi() else atan2(fy,fx) end)/(2*pi())')} front_x, {s6('32*acos(fz/sqrt(fx*fx+fy*fy+fz*fz))/pi()')} front_y
 from (select *, -((x+0.5)/64-0.5) fx, -0.5::double fy, -((y+0.5)/32-0.5) fz from {_EQ})""")
def b23_spherical_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = B.points(spark, d).select("point_id", (F.col("point_id") % 64).alias("x"), (F.col("point_id") * 7 % 32).alias("y"))
    ray = C.equirect_direction(F.col("x"), F.col("y"), 64.0, 32.0)
    fx, fy = C.cube_to_equirect("front", (F.col("x") + 0.5) / 64 - 0.5, (F.col("y") + 0.5) / 32 - 0.5, 64.0, 32.0)
    return rows.select("point_id", *(r6(c).alias(f"d{a}") for a, c in zip("xyz", ray, strict=True)), r6(fx).alias("front_x"), r6(fy).alias("front_y"))


_AXIS = f"(select point_id, x/1000 x, y/1000 y, z/1000 z, sqrt(x*x+y*y+z*z)/1000 n from ({P}))"


@query(f"""select point_id, {s6('x')} x, {s6('y')} y, {s6('z')} z, {s6('cos(n)+(1-cos(n))*x*x/(n*n)')} r00, {s6('(1-cos(n))*x*y/(n*n)-sin(n)*z/n')} r01,
 {s6('(1-cos(n))*x*z/(n*n)+sin(n)*y/n')} r02, {s6('(1-cos(n))*y*z/(n*n)-sin(n)*x/n')} r12 from {_AXIS}""")
def b19_rotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the rotation by its formula, and the vector that comes back from it."""
    rows = C.rotation_rows(tuple(F.col(c) / 1000 for c in "xyz"))
    flat = B.points(spark, d).select("point_id", *(rows[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)))
    back = C.angle_axis([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    return flat.select("point_id", *(r6(c).alias(a) for a, c in zip("xyz", back, strict=True)), *(r6(c).alias(c) for c in ("r00", "r01", "r02", "r12")))


@query(f"select p_size k, id, {s6('dx*fx+dy*fy+dz*fz')} score from (select *, row_number() over (partition by p_size order by round(dx*fx+dy*fy+dz*fz,9) desc, ordinal) rn from (select distinct p_size, cos(p_size/8.0) dx, sin(p_size/8.0) dy, 0.0 dz from part), {RIG}) where rn=1")
def f2_camera_by_direction(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import camera_by_direction

    rows = B.table(spark, d, "part").select(F.col("p_size").alias("k")).distinct()
    rows = rows.select("k", F.cos(F.col("k") / 8.0).alias("dx"), F.sin(F.col("k") / 8.0).alias("dy"), F.lit(0.0).alias("dz"))
    return camera_by_direction(rows, B.rig(spark), ["k"], 100.0).select("k", "id", r6("score").alias("score"))


@query(f"""select {s6("max(sqrt(ox*ox+oy*oy+oz*oz)) filter (grp<>'')")} radius, {s6(f"max({_HALF}) filter (grp<>'')")} half_fov,
 {s6("min(case when type='FTHETA' then least(abs(focx)*fov, 2048*sqrt(2)) else 2048*sqrt(2) end)", 3)} usable from {CAMERAS}""")
def d18_rig_summary(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import rig_summary

    return rig_summary(B.cameras(spark, d)).select(r6("radius").alias("radius"), r6("half_fov").alias("half_fov"), r6("usable", 3).alias("usable"))


def _rigs(spark: SparkSession, d: str) -> DataFrame:
    """The parts' cameras, seventeen parts in turn being a rig."""
    return B.cameras(spark, d).withColumn("rig", F.floor(F.col("k") / 17))


@query()
def c7_overlap_fraction(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.calibration import overlap_fraction

    return overlap_fraction(_rigs(spark, d), 4, ["rig"])


_RAYS = f"""(select point_id, -50.0::double px, 10.0::double py, 0.0::double pz, x+50 vx, y-10 vy, z vz, 60.0::double qx, -20.0::double qy, 5.0::double qz,
 x-60+point_id%7 wx, y+20-point_id%3 wy, z-5+point_id%5 wz from ({P}))"""
_TWO = f"""(select *, vx*vx+vy*vy+vz*vz aa, vx*wx+vy*wy+vz*wz ab, wx*wx+wy*wy+wz*wz bb, vx*(px-qx)+vy*(py-qy)+vz*(pz-qz) ad, wx*(px-qx)+wy*(py-qy)+wz*(pz-qz) bd from {_RAYS})"""
_NEAREST = f"(select *, (ab*bd-bb*ad)/(aa*bb-ab*ab) ta, (aa*bd-ab*ad)/(aa*bb-ab*ab) tb from {_TWO})"
_TA, _TB = (f"case when ta>=0 and tb>=0 then {t} else 1e6::double end" for t in ("ta", "tb"))


@query(f"select point_id, {', '.join(s6(f'(p{a}+{_TA}*v{a}+q{a}+{_TB}*w{a})/2', 3) + f' {a}' for a in 'xyz')} from {_NEAREST}")
def g5_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """The middle between the closest points of rays that pass each other."""
    a, b = tuple(F.lit(v) for v in (-50.0, 10.0, 0.0)), tuple(F.lit(v) for v in (60.0, -20.0, 5.0))
    i, (x, y, z) = F.col("point_id"), (F.col(c) for c in "xyz")
    m = C.midpoint(a, (x + 50, y - 10, z), b, (x - 60 + i % 7, y + 20 - i % 3, z - 5 + i % 5))
    return B.points(spark, d).select("point_id", *(r6(c, 3).alias(n) for n, c in zip("xyz", m, strict=True)))


_SHIFTED = _PX.replace(f"({P}) p", f"(select point_id, x+point_id%5 x, y+1 y, z-point_id%3 z from ({P})) p")
_IN = "not {0}.outside and {0}.px>=0 and {0}.px<2048 and {0}.py>=0 and {0}.py<2048"


@query(f"select a.point_id, a.id, case when {_IN.format('a')} then {s6('sqrt(power(a.px-b.px,2)+power(a.py-b.py,2))', 4)} end error from {_PX} a join {_SHIFTED} b using (point_id, id) where {_IN.format('b')}")
def g7_reprojection_error(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of points that lie a little beside those they are compared with."""
    from rigspark.operators.fit import reprojection_error
    from rigspark.plans.calibration import visible_observations

    i = F.col("point_id")
    beside = B.points(spark, d).select("point_id", (F.col("x") + i % 5).alias("x"), (F.col("y") + 1).alias("y"), (F.col("z") - i % 3).alias("z"))
    obs = visible_observations(beside, B.rig(spark)).drop("x", "y", "z")
    return reprojection_error(obs, B.points(spark, d), ["point_id"]).select("point_id", "id", r6("error", 4).alias("error"))


@query()
def g6_triangulate(spark: SparkSession, d: str) -> DataFrame:
    """Points found again from their pixels: the distance to the truth."""
    from rigspark.operators.fit import triangulate
    from rigspark.plans.calibration import visible_observations

    truth = B.points(spark, d)
    obs = visible_observations(truth, B.rig(spark)).drop("x", "y", "z")
    start = truth.select("point_id", *((F.col(c) * 1.1 + 5).alias(c) for c in "xyz"))
    got = triangulate(obs, ["point_id"], start)
    t = truth.select("point_id", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    gone = F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return got.join(t, "point_id").select("point_id", F.round(gone, 2).alias("distance"))


_MOVED = f"(select k//17 rig, id, 0.1*(k%7) away, fx, fy, fz, fx*cos(0.01*(k%5))-fy*sin(0.01*(k%5)) gx, fx*sin(0.01*(k%5))+fy*cos(0.01*(k%5)) gy from {CAMERAS})"
_ARC = "acos(least(greatest({0},-1.0),1.0))"


@query(f"""with m as {_MOVED}, one as (select rig, {s6('sqrt(avg(3*away*away))')} origin, {s6('sqrt(avg(power(fx-gx,2)+power(fy-gy,2)))')} forward from m group by rig),
 pairs as (select a.rig, {_ARC.format('a.fx*b.fx+a.fy*b.fy+a.fz*b.fz')} p, {_ARC.format('a.gx*b.gx+a.gy*b.gy+a.fz*b.fz')} q from m a join m b on a.rig=b.rig and a.id<b.id)
 select rig, origin, forward, angles from one left join (select rig, {s6('sqrt(avg(power(p-q,2)))', 5)} angles from pairs where p<1 group by rig) using (rig)""")
def d11_rig_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Rigs against themselves with cameras moved and turned a little, each in its own way."""
    from rigspark.plans.calibration import rig_rmse

    rigs, k = _rigs(spark, d), F.col("k")
    t, f = 0.01 * (k % 5), F.col("forward")
    moved = rigs.withColumn("origin", F.transform("origin", lambda v: v + 0.1 * (k % 7)))
    moved = moved.withColumn("forward", F.array(f[0] * F.cos(t) - f[1] * F.sin(t), f[0] * F.sin(t) + f[1] * F.cos(t), f[2]))
    return rig_rmse(rigs, moved, ["rig"]).select("rig", r6("origin").alias("origin"), r6("forward").alias("forward"), r6("angles", 5).alias("angles"))


@query(f"select {s6('sum(a*a)/count(*)', 4)} xx, {s6('sum(a*b)/count(*)', 4)} xy from (select cast(l_quantity as double) a, cast(l_extendedprice as double)/1000 b from lineitem)")
def d16_normal_sums(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators.fit import normal_sums

    rows = B.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"))
    s = normal_sums(rows, [], [F.col("a")], [F.col("b")])
    return s.select(r6(F.col("xx")[0] / F.col("n"), 4).alias("xx"), r6(F.col("xy")[0] / F.col("n"), 4).alias("xy"))


@query(f"select l_orderkey, l_linenumber, {s6('2.5*cast(l_quantity as double)-0.5*cast(l_discount as double)+3')} p from lineitem")
def d17_linreg_apply(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators.fit import linreg_apply

    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    return linreg_apply(rows, ["a", "b"], np.array([[2.5], [-0.5], [3.0]]), ["p"]).select("l_orderkey", "l_linenumber", r6("p").alias("p"))


@query(f"select {s6('regr_slope(b, a)')} slope, {s6('regr_intercept(b, a)')} intercept from (select cast(l_quantity as double)/50 a, cast(l_extendedprice as double)/1e5 b from lineitem)")
def d16_linreg_gd(spark: SparkSession, d: str) -> DataFrame:
    """Descent long enough to reach the least squares, which the SQL states in closed form."""
    from rigspark.operators.fit import linreg_gd

    rows = B.table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 50).alias("a"), (F.col("l_extendedprice").cast("double") / 1e5).alias("b"))
    m = linreg_gd(rows, ["a"], ["b"], 1000, 0.5)
    return spark.createDataFrame([(float(round(m[0, 0], 6)), float(round(m[1, 0], 6)))], "slope double, intercept double")


_M3 = "(select p_partkey, 1.2+p_size/100.0::double m00, 0.1::double m01, 0.05::double m02, 0.02::double m10, 1.1-p_size/100.0::double m11, 0.03::double m12, -0.1::double m20, 0.0::double m21, 1.3::double m22 from part)"
_CRAMER = f"""(select *, m11*m22-m12*m21-m01*(m22-m12)+m02*(m21-m11) b0, m00*(m22-m12)-(m10*m22-m12*m20)+m02*(m10-m20) b1, m00*(m11-m21)-m01*(m10-m20)+m10*m21-m11*m20 b2,
 m00*(m11*m22-m12*m21)-m01*(m10*m22-m12*m20)+m02*(m10*m21-m11*m20) det from {_M3})"""
_GAINS = f"(select *, greatest(b0/det, b1/det, b2/det)/(b0/det) g0, greatest(b0/det, b1/det, b2/det)/(b1/det) g1, greatest(b0/det, b1/det, b2/det)/(b2/det) g2 from {_CRAMER})"


@query(f"""select p_partkey, {', '.join(f"{s6(f'g{i}')} gain{i}" for i in range(3))}, {', '.join(f"{s6(f'm{i}{j}/g{j}/(m00/g0+m01/g1+m02/g2)')} m{i}{j}" for i in range(3) for j in range(3))} from {_GAINS}""")
def g13_decompose_color(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators.fit import decompose_color

    k = F.col("p_size") / 100.0
    rows = B.table(spark, d, "part").select("p_partkey", k.alias("k"))
    m = [[1.2 + F.col("k"), F.lit(0.1), F.lit(0.05)], [F.lit(0.02), 1.1 - F.col("k"), F.lit(0.03)], [F.lit(-0.1), F.lit(0.0), F.lit(1.3)]]
    gains, ccm = decompose_color(m)
    return rows.select("p_partkey", *(r6(g).alias(f"gain{i}") for i, g in enumerate(gains)), *(r6(ccm[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)))


@query()
def g11_fit_vignetting(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators.fit import fit_vignetting

    g = B.grid(spark, d)
    s = g.select("image_id", (F.col("x") / 64.0).alias("sx"), (F.col("y") / 64.0).alias("sy"), (1 + 0.3 * (F.col("x") / 64.0 - 0.5) ** 2 + 0.1 * F.col("v")).alias("t"))
    out = fit_vignetting(s, ["image_id"], "sx", "sy", "t")
    return out.select("image_id", F.transform("h", lambda c: F.round(c, 3)).alias("h"))


@query()
def g14_ransac_inliers(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators.fit import ransac_inliers

    p = B.points(spark, d)
    noise = F.when(F.col("point_id") % 4 == 0, F.col("point_id") * 13 % 500).otherwise(0)
    m = p.select("point_id", F.col("x").alias("x0"), F.col("z").alias("y0"), (F.col("x") * 1.1 + 5 + noise).alias("x1"), (F.col("z") * 0.9 - 3 + noise).alias("y1"))
    return ransac_inliers(m, 1.0).select("point_id")


_SEEN = f"(select * from {_PX} where not outside and px>=0 and px<2048 and py>=0 and py<2048)"


def _calibrated(spark: SparkSession, d: str):
    """What the rig sees of the parts' points, and the rig after a small change of all but its places."""
    from rigspark.plans.adjustment import ALL, Rig, moved, unknowns
    from rigspark.plans.calibration import visible_observations

    seen = visible_observations(B.points(spark, d), B.rig(spark)).select(F.col("point_id").cast("string").alias("trace_id"), "id", "px", "py")
    obs = written(seen.join(seen.groupBy("trace_id").count().where("count > 1"), "trace_id", "left_semi"))
    rig = Rig.of(B.rig(spark))
    columns, size = unknowns(rig, ALL, True)
    step = np.zeros(size)
    for name, most in (("rotation", 0.004), ("principal", 2.0), ("focal", 0.004), ("distortion", 0.004)):
        at = np.unique(columns[name][columns[name] >= 0])
        step[at] = most * np.sin(1 + 2.4 * np.arange(len(at)))
    return obs, moved(rig, columns, step)


@query(f"""with o as (select point_id, id, count(*) over (partition by point_id) cams from {_SEEN})
 select id, {s6('fx', 4)} fx, {s6('fy', 4)} fy, {s6('fz', 4)} fz, {s6('focx', 1)} focal, 1024.0::double principal, 0.0::double distortion, n from {RIG} join (select id, count(*) n from o where cams>1 group by id) using (id)""")
def g8_bundle_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Rotations, principal points, focal lengths and shared distortions found again from pixels."""
    from rigspark.plans.adjustment import ALL, bundle_adjust

    obs, start = _calibrated(spark, d)
    done = bundle_adjust(obs, start.table(spark), free=tuple(p for p in ALL if p != "position"))
    rows = done.cameras.join(obs.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    f = F.col("forward")
    return rows.select("id", r6(f[0], 4).alias("fx"), r6(f[1], 4).alias("fy"), r6(f[2], 4).alias("fz"), r6(F.col("focal")[0], 1).alias("focal"), r6(F.col("principal")[0], 1).alias("principal"), r6(F.col("distortion")[0], 2).alias("distortion"), "n")


@query()
def h15_calibrate_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The rig from matches of all image pairs, one match in fifty of them wrong."""
    from rigspark.plans.adjustment import calibrate_geometry

    obs, start = _calibrated(spark, d)
    image = F.concat(F.lit("rgb/"), "id", F.lit("/000001.png"))
    kp = obs.select(image.alias("image"), F.col("trace_id").cast("int").alias("kp_idx"), F.col("px").alias("x"), F.col("py").alias("y"))
    side = lambda i: kp.select(F.col("image").alias(f"image{i}"), F.col("kp_idx").alias("k"))
    pairs = side(0).join(side(1), "k").where("image0 < image1")
    other = F.when(F.xxhash64("image0", "image1", "k") % 50 == 0, F.lead("k").over(Window.partitionBy("image0", "image1").orderBy("k")))
    matches = pairs.select("image0", F.col("k").alias("idx0"), "image1", F.coalesce(other, "k").alias("idx1"))
    done = calibrate_geometry(written(matches), written(kp), start.table(spark))
    f = F.col("forward")
    return done.cameras.select("id", *(r6(f[i], 3).alias(f"f{a}") for i, a in enumerate("xyz")), r6(F.col("focal")[0], 0).alias("focal"), r6(F.col("principal")[0], 0).alias("principal"))
