"""Queries of grid stencils, warps, components and block matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.catalog import query, r6, s6
from rigspark.operators import grid as GD
from rigspark.operators import joins as J
from rigspark.operators import sequence as Q
from rigspark.operators import stats as D
from rigspark.scratch import written

G = B.GRID_SQL
K = ["image_id"]
_ROW = "partition by image_id, y order by x"
_COL = "partition by image_id, x order by y"


def _out(df: DataFrame, v: str = "v", digits: int = 6) -> DataFrame:
    return df.select("image_id", "y", "x", r6(v, digits).alias(v))


_BOX = lambda f, src, r: f"(select image_id, y, x, {f}(h) over ({_COL} range between {r} preceding and {r} following) v from (select *, {f}(v) over ({_ROW} range between {r} preceding and {r} following) h from {src}))"


@query(f"select d.image_id, d.y, d.x, d.v dilated, c.v closed from {_BOX('max', f'({G})', 2)} d join {_BOX('min', _BOX('max', f'({G})', 2), 2)} c using (image_id, y, x)")
def e3_morphology(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d).repartition("image_id")
    a = GD.dilate(g, K, 2).withColumnRenamed("v", "dilated")
    return a.join(GD.close_gaps(g, K, 2).withColumnRenamed("v", "closed"), ["image_id", "y", "x"])


def _gauss(src: str, k: int, sigma: float) -> str:
    w = GD.gaussian_weights(k, sigma)
    r = k // 2

    def axis(src: str, line: str, pos: str, n: str) -> str:
        at = lambda i: f"case when a.{pos}+({i})<0 then -(a.{pos}+({i})) when a.{pos}+({i})>={n} then 2*{n}-(a.{pos}+({i}))-2 else a.{pos}+({i}) end"
        taps = " union all ".join(f"select a.image_id, a.{line}, a.{pos}, {at(i - r)} t, {wt!r} w from s a" for i, wt in enumerate(w))
        taps = taps.replace(f">={n}", ">=m").replace(f"2*{n}-", "2*m-").replace("from s a", "from sm a")
        return f"(with s as (select * from {src}), sm as (select *, max({pos}) over (partition by image_id, {line})+1 m from s), t as ({taps}) select t.image_id, t.{line}, t.{pos}, sum(t.w*s.v) v from t join s on s.image_id=t.image_id and s.{line}=t.{line} and s.{pos}=t.t group by 1,2,3)"

    return axis(axis(src, "y", "x", "m"), "x", "y", "m")


@query(f"select image_id, y, x, {s6('v')} v from {_gauss(f'({G})', 5, 1.0)}")
def e4_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _out(GD.gaussian(B.grid(spark, d).repartition("image_id"), K, 5, 1.0))


_CROSS = f"(select image_id, y, x, least(min(v) over ({_ROW} range between 2 preceding and 2 following), min(v) over ({_COL} range between 2 preceding and 2 following)) v from ({G}))"


@query(f"select image_id, y, x, {s6('v')} v from {_gauss(_CROSS, 5, 1.0)}")
def e5_feather(spark: SparkSession, d: str) -> DataFrame:
    return _out(GD.feather(B.grid(spark, d).repartition("image_id"), K, 2))


def _mean_sql(r: int, src: str = f"({G})") -> str:
    return f"(select s.image_id, s.y, s.x, s.v0, s.v/n.v m from (select a.*, b.v v0 from {_BOX('sum', src, r)} a join {src} b using (image_id, y, x)) s join {_BOX('sum', f'(select image_id, y, x, 1.0::double v from {src})', r)} n using (image_id, y, x))"


@query(f"select image_id, y, x, case when v0>m-0.02 then 0 else 1 end mask from {_mean_sql(4)}")
def e6_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    return GD.adaptive_threshold(B.grid(spark, d).repartition("image_id"), K, 9, 0.02).select("image_id", "y", "x", "mask")


@query(f"select image_id, y, x, {s6(f'coalesce(lead(v) over ({_ROW}),v)-coalesce(lag(v) over ({_ROW}),v)')} gx, {s6(f'coalesce(lead(v) over ({_COL}),v)-coalesce(lag(v) over ({_COL}),v)')} gy from ({G})")
def e10_gradients(spark: SparkSession, d: str) -> DataFrame:
    return GD.gradients(B.grid(spark, d).repartition("image_id"), K).select("image_id", "y", "x", r6("gx").alias("gx"), r6("gy").alias("gy"))


_A = repr(0.25**0.25)
_IIR = f"""with recursive line as (select image_id, y, list(v order by x) a from ({G}) group by 1,2),
 f(image_id, y, a, j, v, buf) as (select image_id, y, a, 0, a[1], []::double[] from line union all
  select image_id, y, a, j+1, v*{_A}+(case when j+1=64 then a[63] else a[j+2] end)*(1-{_A}), list_append(buf, v*{_A}+(case when j+1=64 then a[63] else a[j+2] end)*(1-{_A})) from f where j<64),
 fin as (select image_id, y, buf, v from f where j=64),
 b(image_id, y, buf, j, v) as (select image_id, y, buf, 63, v from fin union all select image_id, y, buf, j-1, v*{_A}+(case when j-1=-1 then buf[2] else buf[j] end)*(1-{_A}) from b where j>=0)
 select image_id, y, cast(j+1 as bigint) x, {s6('v')} lp from b where j<=62"""


@query(_IIR)
def e1_iir_lowpass(spark: SparkSession, d: str) -> DataFrame:
    out = GD.iir_lowpass(B.grid(spark, d), K, "y", "x", "v", 0.25)
    return out.select("image_id", "y", "x", r6("lp").alias("lp"))


@query(f"with m as (select * from {_mean_sql(2)}) select image_id, y, x, {s6('least(greatest(m+(v0-m)*(1-exp(-(v0-m)*(v0-m)*100))*1.25,-1),1)')} v from m")
def e2_sharpen(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d).repartition("image_id")
    s = GD.box(GD.box(g.withColumn("one", F.lit(1.0)), K, 2, F.sum, "v", "s"), K, 2, F.sum, "one", "n")
    lp = s.select("image_id", "y", "x", (F.col("s") / F.col("n")).alias("lp"))
    return _out(GD.sharpen(g, lp, ["image_id", "y", "x"], 1.25, 100.0, limit=(-1.0, 1.0)))


_NEAR = lambda r, step: f"(select a.image_id, a.y, a.x, b.v nv from ({G}) a join ({G}) b on a.image_id=b.image_id and abs(a.y-b.y)<={r} and abs(a.x-b.x)<={r} and (a.y-b.y)%{step}=0 and (a.x-b.x)%{step}=0)"
_MED = lambda r, step: f"(select image_id, y, x, list(nv order by nv)[floor(count(*)/2)::int+1] v, avg(nv) m, list(nv) a from {_NEAR(r, step)} group by 1,2,3)"


@query(f"select image_id, y, x, v from {_MED(2, 1)}")
def e9_median_filter(spark: SparkSession, d: str) -> DataFrame:
    return GD.median_filter(B.grid(spark, d), K, 2)


@query(f"select g.image_id, g.y, g.x, case when m.m<0.0 and list_count(list_filter(m.a, lambda q: q>g.v))<1 then m.v else g.v end v from ({G}) g join {_MED(2, 2)} m using (image_id, y, x)")
def e12_repair_stuck(spark: SparkSession, d: str) -> DataFrame:
    return GD.repair_stuck(B.grid(spark, d), K, 1, 0.0, 2).select("image_id", "y", "x", "v")


@query(f"select g.image_id, g.y, g.x, {s6('g.v*(1-(1-p*q))+b.v*(1-p*q)')} v from (select *, (x%4)/3.0 p, (y%3)/2.0 q from ({G})) g join {_gauss(f'({G})', 5, 1.0)} b using (image_id, y, x)")
def e18_diffuse_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d).withColumn("p", F.col("x") % 4 / 3.0).withColumn("q", F.col("y") % 3 / 2.0).repartition("image_id")
    return _out(GD.diffuse_low_confidence(g, K, "p", "q"))


_CHM = "case when {y}%2=0 then case when {x}%2=0 then 1 else 2 end else case when {x}%2=0 then 0 else 1 end end"
_DM = f"""select image_id, y, x, {', '.join(f'{s6(f"coalesce(max(case when d=0 and ch={c} then nv end), avg(case when ch={c} and d>0 and (ch<>1 or d<=1) then nv end))")} {n}' for c, n in enumerate('rgb'))} from (
 select a.image_id, a.y, a.x, b.v nv, {_CHM.format(y='b.y', x='b.x')} ch, abs(a.y-b.y)+abs(a.x-b.x) d from ({G}) a join ({G}) b on a.image_id=b.image_id and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1) group by 1,2,3"""


@query(_DM)
def e7_demosaic_bilinear(spark: SparkSession, d: str) -> DataFrame:
    out = GD.demosaic_bilinear(B.grid(spark, d), K)
    return out.select("image_id", "y", "x", *(r6(c).alias(c) for c in "rgb"))


@query(f"select image_id, cast((y//4)*2+y%2 as bigint) y, cast((x//4)*2+x%2 as bigint) x, {s6('avg(v)')} v from ({G}) group by 1,2,3")
def d20_bin_down(spark: SparkSession, d: str) -> DataFrame:
    return _out(GD.bin_down(B.grid(spark, d), K, 2))


_WARP = f"(select image_id, y dy, x dx, x*0.9::double+y*0.05::double-1.3::double sx, y*0.95::double-x*0.02::double+0.7::double sy from ({G}))"


def _warp(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d)
    return g.select("image_id", F.col("y").alias("dy"), F.col("x").alias("dx"), (F.col("x") * 0.9 + F.col("y") * 0.05 - 1.3).alias("sx"), (F.col("y") * 0.95 - F.col("x") * 0.02 + 0.7).alias("sy"))


_TAPS = " union all ".join(f"select image_id, dy, dx, cast(floor(sy)+{i} as bigint) y, cast(floor(sx)+{j} as bigint) x, ({'sy-floor(sy)' if i else '1-(sy-floor(sy))'})*({'sx-floor(sx)' if j else '1-(sx-floor(sx))'}) w from {_WARP}" for i in (0, 1) for j in (0, 1))


@query(f"select b.image_id, b.dy, b.dx, b.v, n.v nearest from (select t.image_id, t.dy, t.dx, {s6('sum(t.w*coalesce(g.v,0))')} v from ({_TAPS}) t left join ({G}) g using (image_id, y, x) group by 1,2,3) b join (select w.image_id, w.dy, w.dx, {s6('coalesce(g.v,0)')} v from {_WARP} w left join ({G}) g on g.image_id=w.image_id and g.y=floor(w.sy+0.5) and g.x=floor(w.sx+0.5)) n using (image_id, dy, dx)")
def c12_gather(spark: SparkSession, d: str) -> DataFrame:
    g, w = B.grid(spark, d), _warp(spark, d)
    a = J.gather(g, w, K, 50, 64).select("image_id", "dy", "dx", r6("v").alias("v"))
    b = J.gather(g, w, K, 50, 64, "nearest").select("image_id", "dy", "dx", r6("v").alias("nearest"))
    return a.join(b, ["image_id", "dy", "dx"])


@query(f"select a.image_id, a.y y0, a.x x0, o oy, p ox, {s6('a.v')} v0, {s6('b.v')} v1 from ({G}) a, generate_series(-1,1) t(o), generate_series(0,5) u(p), (select * from ({G})) b where b.image_id=a.image_id and b.y=a.y+o and b.x=a.x+p")
def c14_search_box(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d)
    out = J.search_box_candidates(g, g, K, "right", 20.0)
    return out.select("image_id", "y0", "x0", "oy", "ox", r6("v0").alias("v0"), r6("v1").alias("v1"))


@query(f"select serial, cell, {s6('sum(w)')} v from (select serial, cast(floor(p) as bigint) cell, value*(1-(p-floor(p))) w from (select serial, counter/7.0 p, value from ({B.STREAM_SQL})) union all select serial, cast(floor(p) as bigint)+1, value*(p-floor(p)) from (select serial, counter/7.0 p, value from ({B.STREAM_SQL}))) group by 1,2")
def b27_splat(spark: SparkSession, d: str) -> DataFrame:
    rows = B.stream(spark, d).withColumn("p", F.col("counter") / 7.0)
    return GD.splat(rows, ["serial"], "p", "value").select("serial", "cell", r6("v").alias("v"))


@query(f"select image_id, y, (x+10)%64 x, v from ({G}) union all select image_id, y, (x+10)%64+64, v from ({G}) where (x+10)%64<12")
def b31_wrap(spark: SparkSession, d: str) -> DataFrame:
    return GD.wrap_extend(GD.wrap_shift(B.grid(spark, d), 64, 10), 64, 0.2)


@query(f"select cast(image_id//2 as bigint) pair, y, 63-x+64*(image_id%2) x, v from ({G})")
def b32_layout(spark: SparkSession, d: str) -> DataFrame:
    g = GD.flip(B.grid(spark, d), 64, "x").withColumn("pair", F.floor(F.col("image_id") / 2)).withColumn("nth", F.col("image_id") % 2)
    sizes = g.select("pair", "nth").distinct().withColumn("size", F.lit(64))
    return GD.stack(g, ["pair"], "nth", sizes).select("pair", "y", "x", "v")


_MASK = f"(select image_id, y, x from ({G}) where v>0.22)"
_LABELS = f"""with recursive c as (select image_id, y, x, image_id||':'||lpad(cast(y as varchar),8,'0')||':'||lpad(cast(x as varchar),8,'0') n from {_MASK}),
 e as (select a.n a, b.n b from c a join c b on a.image_id=b.image_id and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1), r(n, t) as (select n, n from c union select r.n, e.b from r join e on e.a=r.t),
 l as (select n, min(t) label from r group by 1)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return GD.label_grid(B.grid(spark, d).withColumn("mask", F.when(F.col("v") > 0.22, 1).otherwise(0)), K)


@query(_LABELS + " select c.image_id, c.y, c.x, label from c join l using (n)")
def g3_label_grid(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


@query(_LABELS + f" select image_id, label, count(*) area, min(y) y0, max(y) y1, min(x) x0, max(x) x1, {s6('avg(y)')} cy, {s6('avg(x)')} cx, {s6('count(*)/cast((max(y)-min(y)+1)*(max(x)-min(x)+1) as double)')} fill from c join l using (n) group by 1,2 having count(*)>=2")
def d12_component_stats(spark: SparkSession, d: str) -> DataFrame:
    out = D.component_stats(GD.drop_small(_labels(spark, d), K, 2), [*K, "label"])
    return out.select("image_id", "label", "area", "y0", "y1", "x0", "x1", r6("cy").alias("cy"), r6("cx").alias("cx"), r6("fill").alias("fill"))


@query(f"""with c as (select a.image_id, a.y, a.x, p ox, abs(a.v-b.v) d from ({G}) a, generate_series(0,1) u(p), ({G}) b where b.image_id=a.image_id and b.y=a.y and b.x=a.x+p),
 t as (select image_id, y+i y, x+j x, ox, d from c, generate_series(-2,2) r(i), generate_series(-2,2) s(j)),
 s as (select g.image_id, g.y, g.x, t.ox, avg(t.d) sad from ({G}) g join t using (image_id, y, x) group by 1,2,3,4),
 e as (select *, round(sad*(1+sqrt(ox*ox)/1)*(case when ox=0 then 0.8 else 1.0 end),9) error from s)
 select image_id, y, x, ox fx, cast(0 as bigint) fy, {s6('error')} error from (select *, row_number() over (partition by image_id, y, x order by error, abs(ox)) rn from e) where rn=1""")
def g15_block_match(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d)
    return GD.block_match(g, g, K, "right", 4.0).select("image_id", "y", "x", "fx", "fy", r6("error").alias("error"))


@query(f"select image_id, y, x, {s6('v')} v, cast(rn-1 as bigint) place from (select *, row_number() over (partition by image_id order by y, x) rn from ({G}))")
def e16_raster_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.raster_order(B.grid(spark, d), K, 64).select("image_id", "y", "x", r6("v").alias("v"), F.col("place").cast("long").alias("place"))


def _next(g: DataFrame) -> DataFrame:
    """Each image under the number of the one before it."""
    return g.withColumn("image_id", F.col("image_id") - 1)


_H8 = """select a.image_id, a.y, a.x, {v} v, greatest(1.0::double, p) a from (select *, 0.2+(x%4)/5.0 p from ({g})) b join ({g}) a on b.image_id=a.image_id+1 and a.y=b.y and a.x=b.x""".format(
    g=G, v=s6("a.v*(1-(p*(1-tanh(5*abs(a.v-b.v)))+exp(5*p)/(exp(5*(1-p)*2)+exp(5*p))*tanh(5*abs(a.v-b.v))))+b.v*(p*(1-tanh(5*abs(a.v-b.v)))+exp(5*p)/(exp(5*(1-p)*2)+exp(5*p))*tanh(5*abs(a.v-b.v)))"))


@query(_H8)
def h8_flatten_prefer_base(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import flatten_prefer_base

    g = B.grid(spark, d)
    base = g.select("image_id", "y", "x", "v", F.lit(1.0).alias("a"))
    top = _next(g).withColumn("a", 0.2 + F.col("x") % 4 / 5.0)
    return flatten_prefer_base(base, top, ["image_id", "y", "x"], ["v"]).select("image_id", "y", "x", r6("v").alias("v"), "a")


_W = "(t*(1-tanh(10*abs(l-r)))+exp(10*t*0.9*(1+100*ml/64))/(exp(10*(1-t)*0.8*(1+100*mr/64))+exp(10*t*0.9*(1+100*ml/64)))*tanh(10*abs(l-r)))"


@query(f"select image_id, y, x, {s6(f'l*(1-{_W})+r*{_W}')} v from (select a.image_id, a.y, a.x, a.v l, b.v r, 0.3 t, (a.x%3)/20.0 ml, (a.y%3)/20.0 mr from ({G}) a join ({G}) b on b.image_id=a.image_id+1 and a.y=b.y and a.x=b.x)")
def h4_novel_view_blend(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.functions.scalars import lerp
    from rigspark.plans.panorama import novel_view_weight

    g = B.grid(spark, d)
    a, b = g.withColumnRenamed("v", "l"), _next(g).withColumnRenamed("v", "r")
    w = novel_view_weight(["l"], ["r"], F.lit(0.8), F.lit(0.9), F.col("x") % 3 / 20.0, F.col("y") % 3 / 20.0, F.lit(0.3), 64.0)
    return a.join(b, ["image_id", "y", "x"]).select("image_id", "y", "x", r6(lerp("l", "r", w)).alias("v"))


@query(f"select image_id, y, x, {s6('case when a<1 and b>0 then a*v+(1-a)*w else v end')} v, case when a<1 and b>0 then 1.0::double else a end a from (select p.image_id, p.y, p.x, p.v, (p.x%3)/2.0 a, q.v w, (q.y%2)/1.0 b from ({G}) p join ({G}) q on q.image_id=p.image_id+1 and p.y=q.y and p.x=q.x)")
def h6_merge_pole(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import merge_pole

    g = B.grid(spark, d)
    on = ["image_id", "y", "x"]
    top, low = g.withColumn("a", F.col("x") % 3 / 2.0), _next(g).withColumn("a", F.col("y") % 2 / 1.0)
    return merge_pole(top.join(low.select(*on), on, "left_semi"), low, on).select(*on, r6("v").alias("v"), "a")


@query(f"select image_id, y, x, {s6('least(greatest(least(greatest((b*1.1*1.2),0),1)-0.02,0)/(0.9-0.02), 1)')} v from (select image_id, y, x, case when w<1 then (w-0.05)/(1-0.05) else w end b from (select *, least(greatest(v*2+0.5,0),1) w from ({G})))")
def h1_develop_sensor_part(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.isp import sensor_values

    g = B.grid(spark, d).withColumn("v", F.least(F.greatest(F.col("v") * 2 + 0.5, F.lit(0.0)), F.lit(1.0)))
    v = sensor_values(F.col("v"), 0.05, F.lit(1.1), 1.2, 0.02, 0.9)
    return g.select("image_id", "y", "x", r6(v).alias("v"))


_SIZES = f"""recursive size(image_id, level, rows_, cols_) as (select image_id, 0::bigint, max(y)+1, max(x)+1 from ({G}) group by 1 union all
 select image_id, level+1, cast(floor(rows_*0.9::double+0.5) as bigint), cast(floor(cols_*0.9::double+0.5) as bigint) from size where least(floor(rows_*0.9::double+0.5), floor(cols_*0.9::double+0.5)) > 24)"""


def _levels(spark: SparkSession, d: str) -> list[DataFrame]:
    from rigspark.operators import bands as BD
    from rigspark.plans.flow import pyramid

    return pyramid(BD.lines(B.grid(spark, d), K, ["v"]), K, ["v"])


@query(f"with {_SIZES} select * from size")
def e11_pyramid_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each image's pyramid and their sizes, from the images themselves."""
    sizes = [df.groupBy("image_id").agg(F.lit(i).cast("long").alias("level"), F.count(F.lit(1)).alias("rows_"), F.max(F.size("v")).cast("long").alias("cols_")) for i, df in enumerate(_levels(spark, d))]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out


def _stretched(axis: str) -> str:
    """Cells of level 1 with their two taps along an axis, by centres, edges replicated."""
    n, m = ("a.rows_", "b.rows_") if axis == "y" else ("a.cols_", "b.cols_")
    s = f"least(greatest((t+0.5)*({n}::double/{m})-0.5, 0), {n}-1)"
    m_of = "b.rows_" if axis == "y" else "b.cols_"
    cells = f"(select image_id, a.rows_, a.cols_, unnest(range({m_of})) t from size a join size b using (image_id) where a.level=0 and b.level=1)"
    return f"(select image_id, t, cast(least(floor({s}), {n}-2) as bigint) i, {s}-least(floor({s}), {n}-2) f from {cells} a join size b using (image_id) where b.level=1)"


@query(f"""with {_SIZES}, g as ({G}), ys as {_stretched('y')}, xs as {_stretched('x')}
 select ys.image_id, ys.t y, xs.t x, {s6('(p.v*(1-xs.f)+q.v*xs.f)*(1-ys.f)+(r.v*(1-xs.f)+s.v*xs.f)*ys.f')} v from ys join xs using (image_id)
 join g p on p.image_id=ys.image_id and p.y=ys.i and p.x=xs.i join g q on q.image_id=ys.image_id and q.y=ys.i and q.x=xs.i+1
 join g r on r.image_id=ys.image_id and r.y=ys.i+1 and r.x=xs.i join g s on s.image_id=ys.image_id and s.y=ys.i+1 and s.x=xs.i+1""")
def e11_pyramid_level(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.operators import bands as BD

    return _out(BD.cells(_levels(spark, d)[1], K, ["v"]))


def _moved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Smooth images, and the same moved on by one column."""
    g = GD.gaussian(B.grid(spark, d), K, 5, 1.0)
    return g, GD.wrap_shift(g, 64, 1)


@query()
def g16_refine_flow(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.flow import refine_flow

    a, b = _moved(spark, d)
    zero = a.select("image_id", "y", "x", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    return refine_flow(zero, a, b, K).select("image_id", "y", "x", r6("fx").alias("fx"), r6("fy").alias("fy"))


@query()
def h3_dense_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow over all levels, and what it leaves of the difference of the images."""
    from rigspark.plans.flow import dense_flow, warp_error

    a, b = _moved(spark, d)
    a, b = written(a), written(b)
    error = warp_error(a, b, written(dense_flow(a, b, K, scale=1.0)), K)
    return error.select("image_id", r6("rmse").alias("rmse"), r6("rmse_still").alias("rmse_still"))


@query()
def h9_cubemap(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.plans.panorama import to_cubemap

    mean = B.grid(spark, d).groupBy("y", "x").agg(F.avg("v").alias("v"))
    rows, cols = B.grid_size(mean)
    return to_cubemap(mean, 16, cols, rows).select("y", "x", r6("v").alias("v"))


@query()
def e8_demosaic_edge_aware(spark: SparkSession, d: str) -> DataFrame:
    out = GD.demosaic_edge_aware(B.grid(spark, d), K)
    return out.select("image_id", "y", "x", *(r6(c).alias(c) for c in "rgb"))
