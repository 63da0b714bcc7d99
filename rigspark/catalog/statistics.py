"""Queries of joins, statistics, sets and ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.catalog import query, r6, s6
from rigspark.functions import scalars as S
from rigspark.operators import graph as GR
from rigspark.operators import joins as J
from rigspark.operators import sequence as Q
from rigspark.operators import stats as D

G, ST, GRAPH = B.GRID_SQL, B.STREAM_SQL, B.GRAPH_SQL
KEYS = ["l_returnflag", "l_linestatus"]
_K = "l_returnflag, l_linestatus"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast("double"))


_LI = "(select *, cast(l_extendedprice as double) price from lineitem)"
_FP = lambda keys, v, src, p: f"(select {keys}, {v} pv from (select {keys}, {v}, row_number() over (partition by {keys} order by {v}) rn, count(*) over (partition by {keys}) n from {src}) where rn=floor({p}*n)+1)"


@query(" union all ".join(f"select {_K}, {p}::double p, pv as value from {_FP(_K, 'price', _LI, p)}" for p in (0.5, 0.9, 0.99)))
def d1_floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    return D.floor_percentile(_items(spark, d), KEYS, "price", [0.5, 0.9, 0.99])


@query(f"select {_K}, {s6('quantile_cont(price,0.5)')} price, {s6('quantile_cont(cast(l_quantity as double),0.5)')} quantity from {_LI} group by {_K}")
def d2_median_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("quantity", F.col("l_quantity").cast("double"))
    return D.median_vector(rows, KEYS, ["price", "quantity"]).select(*KEYS, r6("price").alias("price"), r6("quantity").alias("quantity"))


_PM = f"(select image_id, cast(case when y%2=0 then case when x%2=0 then 1 else 2 end else case when x%2=0 then 0 else 1 end end as bigint) ch, v from ({G}) where x between 8 and 40 and y between 4 and 30)"


@query(f"select image_id, ch, pv as value from {_FP('image_id, ch', 'v', _PM, 0.5)}")
def d3_patch_medians(spark: SparkSession, d: str) -> DataFrame:
    px = B.grid(spark, d).withColumn("ch", S.bayer_channel("y", "x").cast("long"))
    mask = px.where("x between 8 and 40 and y between 4 and 30").select("image_id", "y", "x")
    return D.patch_medians(px, mask, ["image_id", "y", "x"], ["image_id", "ch"], "v")


_HIST = "select event_type, cast(least(greatest(floor(value/100.0*32),0),31) as bigint) bin, count(*) n from events group by 1,2"


@query(f"select event_type, bin, n, {s6('log2(n+1.0)')} log_n from ({_HIST})")
def d4_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.histogram(B.table(spark, d, "events"), ["event_type"], "value", 32, 0.0, 100.0).withColumn("log_n", r6("log_n"))


@query(f"select event_type, min(bin) bin from (select *, sum(n) over (partition by event_type order by bin) run from ({_HIST}) where bin>=1) where run>100 group by 1")
def d5_cumulative_threshold(spark: SparkSession, d: str) -> DataFrame:
    return D.cumulative_threshold(D.histogram(B.table(spark, d, "events"), ["event_type"], "value", 32, 0.0, 100.0), ["event_type"], 100)


@query(f"select l_returnflag, max(lo) min_price, min(hi) max_price from (select {_K}, min(price) lo, max(price) hi from {_LI} group by {_K}) group by 1")
def d6_worst_case_bounds(spark: SparkSession, d: str) -> DataFrame:
    return D.worst_case_bounds(D.extents(_items(spark, d), KEYS, ["price"]), ["l_returnflag"], ["price"])


@query(f"""select {_K}, {s6('s')} slope, {s6('yd-s*(21/255.0)')} y0, {s6('-(yd-s*(21/255.0))/s')} x_min, {s6('(1-(yd-s*(21/255.0)))/s')} x_max from (
 select *, (yb-yd)/(150/255.0-21/255.0) s from (select {_K}, max(case when l_linenumber=1 then price end)/100000 yd, max(case when l_linenumber=4 then price end)/50000 yb from {_LI} group by {_K}))""")
def d7_gray_response(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("y", F.col("price") / F.when(F.col("l_linenumber") == 1, 100000.0).otherwise(50000.0))
    return D.gray_response(rows, KEYS, "l_linenumber", "y").select(*KEYS, *(r6(c).alias(c) for c in ("slope", "y0", "x_min", "x_max")))


@query(f"""with p as (select label, vec_id%24 patch, avg(100*embedding[1]::double) l, avg(100*embedding[2]::double) a, avg(100*embedding[3]::double) b from embeddings group by 1,2),
 r as (select patch, avg(l) l, avg(a) a, avg(b) b from p group by 1),
 e as (select label, patch, sqrt(power(p.l-r.l,2)+power(p.a-r.a,2)+power(p.b-r.b,2)) error from p join r using (patch))
 select label, patch, {s6('error')} error, {s6('avg(error) over (partition by label)')} mean_error from e""")
def d8_color_error(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "embeddings")
    p = e.groupBy("label", (F.col("vec_id") % 24).alias("patch")).agg(*(F.avg(100 * F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("lab")))
    ref = p.groupBy("patch").agg(*(F.avg(c).alias(c) for c in "lab"))
    return D.color_error(p, ref, ["patch"], ["label"]).select("label", "patch", r6("error").alias("error"), r6("mean_error").alias("mean_error"))


@query(f"select a.image_id, {s6('sqrt(avg(power(a.v-b.v,2)))')} rmse from ({G}) a join ({G}) b on b.image_id=(a.image_id+1)%10 and a.y=b.y and a.x=b.x group by 1")
def d9_image_rmse(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d)
    other = g.withColumn("image_id", F.pmod(F.col("image_id") + 9, F.lit(10)))
    return D.rmse(g, other, ["image_id", "y", "x"], ["image_id"]).withColumn("rmse", r6("rmse"))


@query(f"""select {_K}, n, {s6('rmse', 4)} rmse, {s6('mean', 4)} mean, m.pv median, p.pv p90, q.pv p99, w.top as worst from
 (select {_K}, count(*) n, sqrt(avg(price*price)) rmse, avg(price) mean from {_LI} group by {_K})
 join {_FP(_K, 'price', _LI, 0.5)} m using ({_K}) join {_FP(_K, 'price', _LI, 0.9)} p using ({_K}) join {_FP(_K, 'price', _LI, 0.99)} q using ({_K})
 join (select {_K}, array_to_string(list(cast(cast(round(price*100) as bigint) as varchar) order by price desc),',') top from (select *, row_number() over (partition by {_K} order by price desc) rn from {_LI}) where rn<=3 group by {_K}) w using ({_K})""")
def d10_error_report(spark: SparkSession, d: str) -> DataFrame:
    out = D.error_report(_items(spark, d), KEYS, "price")
    top = F.array_join(F.transform("worst", lambda v: F.round(v * 100).cast("long").cast("string")), ",")
    return out.select(*KEYS, "n", r6("rmse", 4).alias("rmse"), r6("mean", 4).alias("mean"), "median", "p90", "p99", top.alias("worst"))


@query(f"select image_id, {s6('sum(a.w*b.w*a.v)/sum(a.w*b.w*b.v)', 5)} ratio from (select *, (x%3)/2.0 w from ({G})) a join (select image_id, y, x, v+1 v, (y%4)/3.0 w from ({G})) b using (image_id, y, x) group by 1")
def d13_intensity_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = B.grid(spark, d)
    a = g.withColumn("w", F.col("x") % 3 / 2.0)
    b = g.withColumn("v", F.col("v") + 1).withColumn("w", F.col("y") % 4 / 3.0)
    return D.intensity_ratio(a, b, ["image_id", "y", "x"], ["image_id"], "v", "w").withColumn("ratio", r6("ratio", 5))


@query(f"select y, x, {s6('sum((exp(3*w)-1)*v)/sum(exp(3*w)-1)')} v from (select *, (image_id+1)/10.0 w from ({G})) group by 1,2")
def d14_flatten_softmax(spark: SparkSession, d: str) -> DataFrame:
    layers = B.grid(spark, d).withColumn("w", (F.col("image_id") + 1) / 10.0)
    return D.flatten_softmax(layers, ["y", "x"], "v", "w", 3.0).withColumn("v", r6("v"))


@query(f"select {_K}, count(*) total, count(*) filter (e is null) invisible, count(*) filter (e>=60000) outliers from (select *, case when l_quantity<=2 then null else price end e from {_LI}) group by {_K}")
def d15_rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("e", F.when(F.col("l_quantity") > 2, F.col("price")))
    return D.rejection_counts(rows, KEYS, "e", F.lit(60000.0))


@query(f"select serial, {s6('avg(value+7*(counter%5))')} x, {s6('avg(1+7*(counter%3))')} y, {s6('avg(2+7*(counter%2))')} z from ({ST}) group by 1")
def d19_average_at_distance(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("counter")
    rays = B.stream(spark, d).select("serial", F.col("value").alias("ox"), F.lit(1.0).alias("oy"), F.lit(2.0).alias("oz"), (c % 5).alias("dx"), (c % 3).alias("dy"), (c % 2).alias("dz"))
    return D.average_at_distance(rays, ["serial"], 7.0).select("serial", *(r6(a).alias(a) for a in "xyz"))


@query(f"select distinct serial from ({ST})")
def d21_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return J.union_keys(B.stream(spark, d).select("serial"))


# Joins.
@query("select o_orderkey, c_custkey, c_nationkey from orders join customer on o_custkey=c_custkey")
def c1_with_camera(spark: SparkSession, d: str) -> DataFrame:
    orders = B.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.with_camera(orders, B.table(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_custkey", "c_nationkey")


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey<12) and l_partkey in (select s_suppkey from supplier where s_nationkey<12)")
def c2_known_only(spark: SparkSession, d: str) -> DataFrame:
    known = B.table(spark, d, "supplier").where("s_nationkey < 12")
    return J.known_only(B.table(spark, d, "lineitem"), known, "l_suppkey", "l_partkey", "s_suppkey").select("l_orderkey", "l_linenumber")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def c3_invalid_inputs(spark: SparkSession, d: str) -> DataFrame:
    return J.invalid_inputs(B.table(spark, d, "documents"), B.table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("select a.l_orderkey, a.l_linenumber i, b.l_linenumber j from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and a.l_linenumber<b.l_linenumber")
def c5_pairs_within(spark: SparkSession, d: str) -> DataFrame:
    return J.pairs_within(B.table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("select c_nationkey, i, coalesce(lead(i) over (partition by c_nationkey order by i), min(i) over (partition by c_nationkey)) j from (select c_nationkey, c_custkey i from customer)")
def c6_ring_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.ring_pairs(B.table(spark, d, "customer"), ["c_nationkey"], "c_custkey")


@query("select l_orderkey, l_linenumber, o_custkey, p_size from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey")
def c8_resolve_matches(spark: SparkSession, d: str) -> DataFrame:
    m = B.table(spark, d, "lineitem")
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return J.resolve_matches(m, orders, part, "l_orderkey", "l_partkey").select("l_orderkey", "l_linenumber", "o_custkey", "p_size")


_SEQ = f"(select serial, row_number() over (partition by serial order by counter) frame, value from ({ST}))"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("serial").orderBy("counter")
    return B.stream(spark, d).select("serial", F.row_number().over(w).cast("long").alias("frame"), "value")


@query(f"select a.serial, a.frame, a.value, b.value prev_value from {_SEQ} a left join {_SEQ} b on a.serial=b.serial and b.frame=a.frame-1")
def c10_with_previous(spark: SparkSession, d: str) -> DataFrame:
    return J.with_previous(_frames(spark, d), ["serial"], "frame", ["value"]).select("serial", "frame", "value", "prev_value")


_NN = """select a.label, a.vec_id left_id, b.vec_id right_id, sqrt(list_sum(list_transform(generate_series(1,64), lambda i: power(a.embedding[i]::double-b.embedding[i]::double,2)))) d
 from embeddings a join embeddings b on a.label=b.label where a.vec_id%2=0 and b.vec_id%2=1"""


@query(f"select label, left_id, right_id, {s6('d')} distance from (select *, min(d) over (partition by label) m from (select *, row_number() over (partition by label, left_id order by d, right_id) rn from ({_NN})) where rn=1) where d<=greatest(1.5*m,0.02)")
def c11_match_descriptors(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "embeddings")
    got = J.match_descriptors(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), ["label"], "vec_id", "embedding", factor=1.5)
    return got.select("label", "left_id", "right_id", r6("distance").alias("distance"))


@query(f"select l_orderkey, l_linenumber, {s6('power(bin/255.0,0.45)')} v from (select l_orderkey, l_linenumber, l_partkey%256 bin from lineitem)")
def c13_lut_join(spark: SparkSession, d: str) -> DataFrame:
    lut = S.curve_table(spark, "power", 256, 0.0, 1.0, p=0.45)
    return J.lut_join(B.table(spark, d, "lineitem"), lut.drop("x"), F.col("l_partkey") % 256).select("l_orderkey", "l_linenumber", r6("v").alias("v"))


@query("select l_orderkey, l_linenumber, patch, w from (select *, l_partkey%6 patch from lineitem) join (values (0,6),(1,21),(2,49),(3,92),(4,150),(5,233)) t(patch,w) using (patch)")
def c15_with_reference(spark: SparkSession, d: str) -> DataFrame:
    ref = spark.createDataFrame([("D50", i, w) for i, w in enumerate(D.GRAYS)], "illuminant string, patch long, w int")
    rows = B.table(spark, d, "lineitem").withColumn("patch", F.col("l_partkey") % 6)
    return J.with_reference(rows, ref, "D50").select("l_orderkey", "l_linenumber", "patch", "w")


_ISO = "select a.label, a.vec_id, min(sqrt(power(a.embedding[1]::double-b.embedding[1]::double,2)+power(a.embedding[2]::double-b.embedding[2]::double,2))) d from embeddings a join embeddings b on a.label=b.label and a.vec_id<>b.vec_id group by 1,2"


@query(f"with near as ({_ISO}) select n.label, n.vec_id from near n join {_FP('label', 'd', '(select label, d from near)', 0.5)} m using (label) where d<2*pv")
def c16_remove_isolated(spark: SparkSession, d: str) -> DataFrame:
    pts = B.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return D.remove_isolated(pts, ["label"], "vec_id", "x", "y").select("label", "vec_id")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey=o_custkey")
def c17_with_isp_config(spark: SparkSession, d: str) -> DataFrame:
    orders = B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.with_isp_config(B.table(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


# Ordered rows.
@query(f"select serial, counter, previous, counter-previous-1 lost from (select *, lag(counter) over (partition by serial order by counter) previous from ({ST})) where counter-previous>1")
def e13_detect_gaps(spark: SparkSession, d: str) -> DataFrame:
    return Q.detect_gaps(B.stream(spark, d), ["serial"], "counter").select("serial", "counter", "previous", "lost")


@query(f"select serial, counter from (select *, row_number() over (partition by serial order by counter) rn from ({ST})) where rn%5=0")
def e14_decimate(spark: SparkSession, d: str) -> DataFrame:
    return Q.decimate(B.stream(spark, d), ["serial"], ["counter"], 5).select("serial", "counter")


@query(f"select serial, dense_rank() over (order by serial)-1 ordinal, dense_rank() over (order by cast(serial as varchar))-1 text_ordinal from (select distinct serial from ({ST}))")
def e15_assign_ordinals(spark: SparkSession, d: str) -> DataFrame:
    s = B.stream(spark, d)
    a = Q.assign_ordinals(s, "serial").select("serial", F.col("ordinal").cast("long").alias("ordinal"))
    b = Q.assign_ordinals(s, "serial", by_text=True).select("serial", F.col("ordinal").cast("long").alias("text_ordinal"))
    return a.join(b, "serial")


@query(f"""select image_id, y, x, {s6('case when pv is null then v else v*(1-w)+pv*w end')} v from (select a.image_id, a.y, a.x, a.v, b.v pv, 1-(a.x%5)/5.0 w from ({G}) a left join ({G}) b on b.image_id=a.image_id-1 and a.y=b.y and a.x=b.x)""")
def e17_temporal_blend(spark: SparkSession, d: str) -> DataFrame:
    out = Q.temporal_blend(B.grid(spark, d), ["y", "x"], "image_id", "v", F.col("x") % 5 / 5.0)
    return out.select("image_id", "y", "x", r6("v").alias("v"))


@query(f"select serial, first, last, first+1 as begin, least(first+1+99,last) as end from (select serial, min(counter) first, max(counter) last from ({ST}) group by 1)")
def a3_frame_range(spark: SparkSession, d: str) -> DataFrame:
    h = B.stream(spark, d).groupBy("serial").agg(F.min("counter").alias("first"), F.max("counter").alias("last"))
    return Q.frame_range(h, "first", "last", 1, 100)


@query(f"select serial, counter, serial%4 shard from ({ST})")
def s4_route_shards(spark: SparkSession, d: str) -> DataFrame:
    return Q.route_shards(B.stream(spark, d), "serial", 4).select("serial", "counter", "shard")


@query(f"""select serial, counter, take from (select *, last_value(case when kind='signup' then 1 when kind='error' then 0 end ignore nulls) over w is_on, cast(sum(case when kind='signup' then 1 else 0 end) over w as bigint) take
 from ({ST}) window w as (partition by serial order by ts, counter)) where is_on=1""")
def s5_segment_takes(spark: SparkSession, d: str) -> DataFrame:
    return Q.segment_takes(B.stream(spark, d), ["serial"], ["ts", "counter"], F.col("kind") == "signup", F.col("kind") == "error").select("serial", "counter", "take")


@query(f"select cast(floor(counter/20) as bigint) frame, count(distinct serial) cameras, count(distinct serial)>=18 complete from ({ST}) group by 1")
def s6_assemble_sets(spark: SparkSession, d: str) -> DataFrame:
    return Q.assemble_sets(B.stream(spark, d), F.floor(F.col("counter") / 20), "serial", 18)


# Top-k, best rows, unions.
@query(f"select {_K}, l_orderkey, l_linenumber, price from (select *, row_number() over (partition by {_K} order by price desc, l_orderkey, l_linenumber) rn from {_LI}) where rn<=5")
def f1_worst_k(spark: SparkSession, d: str) -> DataFrame:
    return D.worst_k(_items(spark, d), KEYS, "price", 5, ["l_orderkey", "l_linenumber"]).select(*KEYS, "l_orderkey", "l_linenumber", "price")


@query(f"select {_K}, l_orderkey, l_linenumber from (select *, row_number() over (partition by {_K} order by price/cast(l_quantity as double) desc, l_orderkey, l_linenumber) rn from {_LI}) where rn=1")
def f2_best_by(spark: SparkSession, d: str) -> DataFrame:
    best = D.best_by(_items(spark, d), KEYS, F.col("price") / F.col("l_quantity").cast("double"), ["l_orderkey", "l_linenumber"])
    return best.select(*KEYS, "l_orderkey", "l_linenumber")


@query(f"select point_id, {s6('abs((400+500)*(-300-y)-(-500-x)*(200+300))/sqrt(power(900,2)+power(500,2))')} distance from ({B.POINTS_SQL})")
def f3_line_distance(spark: SparkSession, d: str) -> DataFrame:
    lit = [F.lit(float(v)) for v in (-500, -300, 400, 200)]
    return B.points(spark, d).select("point_id", r6(Q.line_distance(F.col("x"), F.col("y"), *lit)).alias("distance"))


@query("select l_suppkey k from lineitem union select s_suppkey from supplier")
def f4_union_keys(spark: SparkSession, d: str) -> DataFrame:
    return J.union_keys(B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query(f"select src, dst from ({GRAPH}) union all select src, dst from ({GRAPH}) where src like '%1'")
def f5_union_matches(spark: SparkSession, d: str) -> DataFrame:
    g = B.match_graph(spark, d)
    return J.union_matches(g, g.where("src like '%1'"))


# Graph.
@query(f"select counter node, min(counter) over (partition by serial) component from ({ST})")
def g1_connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Each frame linked with the one before it: a long chain for each camera."""
    before = F.lag("counter").over(Window.partitionBy("serial").orderBy("counter"))
    links = B.stream(spark, d).select(F.col("counter").alias("src"), F.coalesce(before, "counter").alias("dst"))
    return GR.connected_components(links)


# Reachability over the whole match graph is too slow in SQL; a test holds it against brute force.
@query()
def g1_match_components(spark: SparkSession, d: str) -> DataFrame:
    return GR.connected_components(B.match_graph(spark, d))


@query("select 'o'||l_orderkey image0, l_linenumber idx0, 'p'||l_partkey image1, l_suppkey idx1 from lineitem")
def g2_singleton_traces(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("image0"), F.col("l_linenumber").alias("idx0"), F.concat(F.lit("p"), "l_partkey").alias("image1"), F.col("l_suppkey").alias("idx1"))
    return GR.singleton_traces(rows).select("trace.*")


@query("""select 'p'||l_partkey trace_id, 'o'||l_orderkey image, o_custkey kp_idx, cast(o_totalprice as double) x, cast(o_custkey as double) y, 'cam'||(l_orderkey%17) id
 from lineitem join orders on l_orderkey=o_orderkey where l_suppkey%2=o_custkey%2""")
def c9_trace_observations(spark: SparkSession, d: str) -> DataFrame:
    """Customers are the keypoints of an order's image; an item is a member where its parity is the customer's."""
    keypoints = B.table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("image"), F.col("o_custkey").alias("kp_idx"), F.col("o_totalprice").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    items = B.table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("trace_id"), F.concat(F.lit("o"), "l_orderkey").alias("image"), (F.col("l_suppkey") % 2).alias("side"))
    members = items.join(keypoints.select("image", "kp_idx"), "image").where(F.col("side") == F.col("kp_idx") % 2).drop("side")
    camera = F.concat(F.lit("cam"), F.substring("image", 2, 20).cast("long") % 17)
    return GR.trace_observations(members, keypoints, B.rig(spark), camera).select("trace_id", "image", "kp_idx", "x", "y", "id")


_SHAPE = "(select l_orderkey, count(*) area, max(l_linenumber)-min(l_linenumber)+1 h, max(l_suppkey%5)-min(l_suppkey%5)+1 w from lineitem group by 1)"


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the cells (line, supplier mod 5), measured as a component."""
    return D.component_stats(B.table(spark, d, "lineitem").withColumn("x", F.col("l_suppkey") % 5), ["l_orderkey"], "l_linenumber", "x")


@query(f"select l_orderkey, area from {_SHAPE} where area between 2 and 4 and greatest(h,w)/least(h,w)::double<2.0 and area/(h*w)::double>=0.7")
def b30_filter_patches(spark: SparkSession, d: str) -> DataFrame:
    return D.filter_patches(_shapes(spark, d), 2, 4).select("l_orderkey", "area")


@query(f"select l_orderkey, area from {_SHAPE} where area>=2 and area/(pi()*(greatest(h,w)/2.0::double)*(greatest(h,w)/2.0::double))>=0.3")
def b30_filter_round(spark: SparkSession, d: str) -> DataFrame:
    return D.filter_round(_shapes(spark, d), 2).select("l_orderkey", "area")


@query(f"select l_orderkey, l_linenumber from {_LI} l join {_FP(_K, 'price', _LI, 0.5)} m using ({_K}) where l_linenumber=7 or price<1.6*pv")
def g4_reject_outliers(spark: SparkSession, d: str) -> DataFrame:
    return D.reject_outliers(_items(spark, d), KEYS, "price", 1.6, F.col("l_linenumber") == 7).select("l_orderkey", "l_linenumber")


@query("""select (a*2147483647+b) pair_id, a image0, b image1 from (select distinct l_orderkey%1000+1 a, l_partkey%1000+1001 b from lineitem)""")
def a9_pair_ids(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.sources.tables import pair_id, split_pair_id

    rows = B.table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000 + 1).alias("a"), (F.col("l_partkey") % 1000 + 1001).alias("b")).distinct()
    rows = rows.select(pair_id(F.col("a"), F.col("b")).alias("pair_id"))
    i, j = split_pair_id(F.col("pair_id"))
    return rows.select("pair_id", i.alias("image0"), j.alias("image1"))


@query("select page_id, regexp_extract(url,'([^/]+)/[^/]*$',1) camera, regexp_replace(regexp_extract(url,'[^/]*$'),'\\.[^.]*$','') frame from pages")
def a12_image_paths(spark: SparkSession, d: str) -> DataFrame:
    from rigspark.sources.tables import camera_and_frame

    camera, frame = camera_and_frame(F.col("url"))
    return B.table(spark, d, "pages").select("page_id", camera.alias("camera"), frame.alias("frame"))
