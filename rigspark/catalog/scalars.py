"""Queries of the scalar operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.catalog import query, r6, s6
from rigspark.functions import scalars as S

G, T = B.GRID_SQL, B.TRIPLES_SQL


@query("select l_orderkey, l_linenumber, cast(b*257 as bigint) wide from (select l_orderkey, l_linenumber, l_partkey % 256 b from lineitem)")
def b2_widen8(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("l_partkey") % 256
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.widen8(b).cast("long").alias("wide"))


@query("""select l_orderkey, l_linenumber, cast(p*16+(p>>8) as bigint) p0, cast(q*16+(q>>8) as bigint) p1 from (
 select l_orderkey, l_linenumber, b0*16+b1%16 p, b2*16+(b1>>4) q from (select l_orderkey, l_linenumber, l_partkey%256 b0, l_suppkey%256 b1, l_orderkey%256 b2 from lineitem))""")
def b1_unpack_pixels(spark: SparkSession, d: str) -> DataFrame:
    p0, p1 = S.unpack12(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p0.cast("long").alias("p0"), p1.cast("long").alias("p1"))


_CH = lambda p: f"case when y%2=0 then case when x%2=0 then {p[0]} else {p[1]} end else case when x%2=0 then {p[2]} else {p[3]} end end"


@query(f"select image_id, y, x, cast({_CH((1, 2, 0, 1))} as bigint) gbrg, cast({_CH((0, 1, 1, 2))} as bigint) rggb from ({G})")
def b3_bayer_channel(spark: SparkSession, d: str) -> DataFrame:
    return B.grid(spark, d).select("image_id", "y", "x", S.bayer_channel("y", "x").cast("long").alias("gbrg"), S.bayer_channel("y", "x", "RGGB").cast("long").alias("rggb"))


@query(f"select image_id, y, x, {s6('case when w < 1 then (w-0.06)/(1-0.06) else w end')} v from (select *, v*4 w from ({G}))")
def b4_black_level(spark: SparkSession, d: str) -> DataFrame:
    return B.grid(spark, d).select("image_id", "y", "x", r6(S.black_level(F.col("v") * 4, 0.06)).alias("v"))


_H, _V = [1.0, 1.1, 0.9, 1.2, 1.05], [1.2, 1.0, 1.3, 0.9, 1.1]
_BZ = lambda c, t: "(" + "+".join(f"{p}*{math.comb(4, i)}*power(1-{t},{4 - i})*power({t},{i})" for i, p in enumerate(c)) + ")"


@query(f"select image_id, y, x, {s6('v*' + _BZ(_H, '(x/64.0)') + '*' + _BZ(_V, '(y/64.0)'))} v from ({G})")
def b5_vignette_gain(spark: SparkSession, d: str) -> DataFrame:
    return B.grid(spark, d).select("image_id", "y", "x", r6(F.col("v") * S.vignette_gain(_H, _V, "x", "y", 64.0)).alias("v"))


@query(f"select image_id, y, x, {s6('least(greatest((v+0.5)*1.3, 0), 1)')} v, {s6('(v+0.5)*1.3')} free from ({G})")
def b6_white_balance(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v") + 0.5
    return B.grid(spark, d).select("image_id", "y", "x", r6(S.white_balance(v, 1.3)).alias("v"), r6(S.white_balance(v, 1.3, False)).alias("free"))


@query(f"select l_orderkey, l_linenumber, {s6('(least(greatest(cast(l_discount as double),0.02),0.08)-0.02)/(0.08-0.02)')} v from lineitem")
def b7_clamp_stretch(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.clamp_stretch(F.col("l_discount").cast("double"), 0.02, 0.08)).alias("v"))


_PTS = [(0.0, 0.0), (1e5, 0.5), (2e5, 0.8), (3e5, 1.0)]
_PW = "case when p<100000 then p*(0.5/100000) when p<200000 then 0.5+(p-100000)*(0.3/100000) else 0.8+(p-200000)*(0.2/100000) end"


@query(f"select o_orderkey, {s6(_PW, 9)} v from (select o_orderkey, cast(o_totalprice as double) p from orders)")
def b8_piecewise_linear(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").select("o_orderkey", r6(S.piecewise_linear(F.col("o_totalprice").cast("double"), _PTS), 9).alias("v"))


_CCM = [[1.2, -0.1, -0.1], [-0.2, 1.3, -0.1], [0.0, -0.2, 1.2]]
_CM = S.color_matrix(_CCM, 1.1, 4095)
_BIN = lambda r: f"cast(trunc(least(greatest({r[0]!r}*r+{r[1]!r}*g+{r[2]!r}*b,0),4095)) as bigint)"


@query(f"select vec_id, {', '.join(f'{_BIN(r)} {n}' for r, n in zip(_CM, ('bin_r', 'bin_g', 'bin_b')))} from ({T})")
def b9_color_correct(spark: SparkSession, d: str) -> DataFrame:
    bins = S.color_correct("r", "g", "b", _CCM, 1.1)
    return B.triples(spark, d).select("vec_id", *(c.cast("long").alias(n) for c, n in zip(bins, ("bin_r", "bin_g", "bin_b"), strict=True)))


_TONE = f"""select v.event_id, v.bin, {s6('least(greatest((s*c+0.5*(1-s))*255,0),255)')} tone from (
 select *, tan(pi()/4*1.1) s, case when x<=0.5 then 3*(0.1666+0.05)*power(1-2*x,2)*(2*x)+3*0.3333*(1-2*x)*power(2*x,2)+0.5*power(2*x,3)
 else 0.5*power(1-u,3)+3*0.6666*power(1-u,2)*u+3*(0.8333-0.04)*(1-u)*power(u,2)+power(u,3) end c from (select *, 2*(x-0.5) u from (
 select event_id, bin, power(bin/4095.0, 0.9) x from (select event_id, event_id % 4096 bin from events)))) v"""


@query(_TONE)
def b10_tone_curve(spark: SparkSession, d: str) -> DataFrame:
    lut = S.tone_curve(spark, 0.9, 0.05, -0.04, 1.1)
    rows = B.table(spark, d, "events").select("event_id", (F.col("event_id") % 4096).alias("bin"))
    return rows.join(F.broadcast(lut), "bin").select("event_id", "bin", r6("v").alias("tone"))


def _lab_sql(illuminant: str, r: str = "r", g: str = "g", b: str = "b") -> tuple[str, str, str]:
    def f(row, w):
        x = f"({row[0] / w!r}*({r})+{row[1] / w!r}*({g})+{row[2] / w!r}*({b}))"
        return f"(case when {x}>0.008856 then power(greatest({x},0),1.0/3) else 7.787*{x}+16.0/116 end)"

    x, y, z = (f(row, w) for row, w in zip(S.RGB_TO_XYZ[illuminant], S.WHITE[illuminant]))
    return f"116*{y}-16", f"500*({x}-{y})", f"200*({y}-{z})"


@query(f"select vec_id, {', '.join(f'{s6(e)} {n}' for i in ('D50', 'D65') for e, n in zip(_lab_sql(i), (f'l_{i}', f'a_{i}', f'b_{i}')))} from ({T})")
def b11_to_lab(spark: SparkSession, d: str) -> DataFrame:
    cols = [r6(c).alias(f"{n}_{i}") for i in ("D50", "D65") for n, c in zip("lab", S.to_lab("r", "g", "b", i), strict=True)]
    return B.triples(spark, d).select("vec_id", *cols)


_M3 = [[1.1, -0.05, -0.05], [0.02, 0.95, 0.03], [-0.1, 0.0, 1.1]]
_LIT = [f"(({c}-{k})/(1-{k})*1.2)" for c, k in zip("rgb", (0.05, 0.06, 0.04))]
_MUL = [f"({m[0]}*{_LIT[0]}+{m[1]}*{_LIT[1]}+{m[2]}*{_LIT[2]})" for m in _M3]


@query(f"select vec_id, {', '.join(f'{s6(e)} {n}' for e, n in zip(_lab_sql('D50', *_MUL), 'lab'))} from ({T})")
def b12_apply_color_params(spark: SparkSession, d: str) -> DataFrame:
    lab = S.apply_color_params("r", "g", "b", [0.05, 0.06, 0.04], 1.2, _M3)
    return B.triples(spark, d).select("vec_id", *(r6(c).alias(n) for n, c in zip("lab", lab, strict=True)))


_MAT = lambda m: [f"({a!r})*r+({b!r})*g+({c!r})*b" for a, b, c in m]


@query(f"select vec_id, {', '.join(f'{s6(e)} {n}' for m, p in ((S.RGB_TO_YUV, 'yuv'), (S.YUV_TO_RGB, 'rgb'), (S.RGB_TO_DEC, 'dec')) for e, n in zip(_MAT(m), (p + '0', p + '1', p + '2')))} from ({T})")
def b13_color_transforms(spark: SparkSession, d: str) -> DataFrame:
    sets = (("yuv", S.rgb_to_yuv), ("rgb", S.yuv_to_rgb), ("dec", S.rgb_to_dec))
    return B.triples(spark, d).select("vec_id", *(r6(c).alias(f"{n}{i}") for n, f in sets for i, c in enumerate(f("r", "g", "b"))))


@query("select p_partkey, case when p_size<=5 then 'low' when p_size>=45 then 'high' else 'normal' end flag from part")
def b14_clamped_flag(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").select("p_partkey", S.clamped_flag("p_size", 5, 45).alias("flag"))


_POLAR = f"select image_id, y, x, v fx, lead(v) over (partition by image_id, y order by x) fy from ({G})"


@query(f"""select image_id, y, x, {s6('m')} magnitude, {s6('case when a<0 then a+360 else a end')} hue,
 {s6('case when hi>lo then (m-lo)/(hi-lo) else 0 end')} norm from (select *, min(m) over (partition by image_id) lo, max(m) over (partition by image_id) hi
 from (select *, sqrt(fx*fx+fy*fy) m, degrees(atan2(fy,fx)) a from ({_POLAR}) where fy is not null))""")
def b15_flow_polar(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("image_id", "y").orderBy("x")
    rows = B.grid(spark, d).withColumn("fy", F.lead("v").over(w)).where("fy is not null")
    p = S.flow_polar("v", "fy")
    rows = rows.withColumn("m", p["magnitude"])
    return rows.select("image_id", "y", "x", r6("m").alias("magnitude"), r6(p["hue"]).alias("hue"), r6(S.normalize_minmax("m", ["image_id"])).alias("norm"))


@query(f"""select image_id, y, x, case when sqrt(power(x-32.0,2)+power(y-16.0,2))<20 then 1.0::double else 0.0::double end circle,
 {s6('0.8*greatest(0, 1-sqrt(power(x-32.0,2)+power(y-16.0,2))/16.0)')} radial, {s6('0.8*y/32.0')} topdown,
 {s6('least(greatest((32.0-y)/8.0,0),1)')} edge, case when x%7=0 and y%5=0 and x%2=1 then 0.0::double else 1.0::double end keyed from ({G})""")
def b24_alpha_masks(spark: SparkSession, d: str) -> DataFrame:
    red = S.alpha_colorkey(F.lit(1.0), F.col("x") % 7, F.col("y") % 5, F.col("x") % 2, (0, 0, 1))
    return B.grid(spark, d).select(
        "image_id", "y", "x", S.alpha_circle("y", "x", 32.0, 64.0, 20.0).alias("circle"), r6(S.alpha_radial(0.8, "y", "x", 32.0, 64.0)).alias("radial"),
        r6(S.alpha_topdown(0.8, "y", 32.0)).alias("topdown"), r6(S.alpha_edge(1.0, "y", 32.0, 8.0)).alias("edge"), red.alias("keyed"))


@query(f"""select event_id, {s6('least(greatest((value-20)/60.0,0),1)')} ramp, {s6('least(greatest(value,10),50)')} clamped,
 case when k<0 then -k when k>=10 then 18-k else k end reflected, case when k<0 then k+10 when k>=10 then k-10 else k end wrapped,
 {s6('value*(1-0.3)+7*0.3')} lerped, {s6('value*0.5625+1*0.1875+2*0.1875+3*0.0625')} bilerped, {s6('value*pi()/180')} rad
 from (select *, event_id%20-5 k from events)""")
def b25_scalar_helpers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 20 - 5
    return B.table(spark, d, "events").select(
        "event_id", r6(S.ramp("value", 20.0, 80.0)).alias("ramp"), r6(S.clamp("value", 10.0, 50.0)).alias("clamped"), S.reflect(k, 10).alias("reflected"), S.wrap(k, 10).alias("wrapped"),
        r6(S.lerp("value", 7.0, 0.3)).alias("lerped"), r6(S.bilerp("value", 1.0, 2.0, 3.0, 0.25, 0.25)).alias("bilerped"), r6(S.radians_of("value")).alias("rad"))


@query(f"""select event_id, {s6('power(0.1+bin*(1.9/255),2.2)')} pow, {s6('1/(1+power((0.1+bin*(1.9/255))/0.7,4))')} butter, {s6('sin(pi()*(0.1+bin*(1.9/255)))/(pi()*(0.1+bin*(1.9/255)))')} sinc
 from (select event_id, least(greatest(cast(trunc((value/100.0-0.1)/1.9*255) as bigint),0),255) bin from events)""")
def b26_curve_tables(spark: SparkSession, d: str) -> DataFrame:
    lo, hi, n = 0.1, 2.0, 256
    table = S.curve_table(spark, "power", n, lo, hi, p=2.2).select("bin", F.col("v").alias("pow"))
    for name, kind, par in (("butter", "butterworth", {"cutoff": 0.7, "order": 2}), ("sinc", "sinc", {})):
        table = table.join(S.curve_table(spark, kind, n, lo, hi, **par).select("bin", F.col("v").alias(name)), "bin")
    rows = B.table(spark, d, "events").select("event_id", S.lut_bin(F.col("value") / 100.0, n, lo, hi).cast("long").alias("bin"))
    return rows.join(F.broadcast(table), "bin").select("event_id", r6("pow").alias("pow"), r6("butter").alias("butter"), r6("sinc").alias("sinc"))


@query(f"""select a.vec_id, {s6('list_sum(list_transform(generate_series(1,64), lambda i: abs(a.embedding[i]::double-b.embedding[i]::double)))')} l1,
 {s6('list_sum(list_transform(generate_series(1,64), lambda i: power(a.embedding[i]::double-b.embedding[i]::double,2)))')} l2
 from embeddings a join embeddings b on b.vec_id=a.vec_id+1""")
def b28_vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(S.dist_l1("embedding", "other")).alias("l1"), r6(S.dist_l2sq("embedding", "other")).alias("l2"))


@query("""select page_id, regexp_extract(url,'^(.*)/[^/]*$',1) parent, regexp_replace(regexp_extract(url,'[^/]*$'),'\\.[^.]*$','') stem,
 cast(nullif(regexp_extract(url,'([0-9]+)',1),'') as bigint) number, lpad(cast(page_id as varchar),6,'0') padded, array_to_string(string_split(url,'/'),'|') joined from pages""")
def b29_string_helpers(spark: SparkSession, d: str) -> DataFrame:
    p = S.path_parts("url")
    return B.table(spark, d, "pages").select("page_id", p["parent"].alias("parent"), p["stem"].alias("stem"), S.first_int("url").alias("number"), S.zero_pad("page_id").alias("padded"), F.array_join(F.split("url", "/"), "|").alias("joined"))


@query("select event_id, lpad(cast(event_id as varchar),6,'0') frame_key from events")
def a13_frame_key(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", S.zero_pad("event_id").alias("frame_key"))
