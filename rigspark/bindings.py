"""Grids, streams, graphs, rigs and point sets as projections of the given tables.

Each binding is a DataFrame function and the same rows as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ``image_id, y, x, v``: each label's vectors are the rows of an image.
GRID_SQL = "select cast(label as bigint) image_id, row_number() over (partition by label order by vec_id)-1 y, cast(generate_subscripts(embedding,1)-1 as bigint) x, cast(unnest(embedding) as double) v from embeddings"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").withColumn("y", y.cast("long"))
    return rows.select(F.col("label").cast("long").alias("image_id"), "y", F.posexplode("embedding").alias("x", "v")).select("image_id", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def grid_size(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns of one image ``(y, x, ...)``."""
    most = cells.agg(F.max("y"), F.max("x")).first()
    return tuple(0 if m is None else int(m) + 1 for m in most)


#: ``vec_id, r, g, b``: colors around 0.5.
TRIPLES_SQL = "select vec_id, 0.5+cast(embedding[1] as double) r, 0.5+cast(embedding[2] as double) g, 0.5+cast(embedding[3] as double) b from embeddings"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *((0.5 + e[i].cast("double")).alias(c) for i, c in enumerate("rgb")))


#: ``serial, counter, ts, kind, value``: events as frame packets of cameras.
STREAM_SQL = "select user_id serial, event_id counter, ts, event_type kind, value from events"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("serial"), F.col("event_id").alias("counter"), "ts", F.col("event_type").alias("kind"), "value")


#: ``src, dst``: order and part of each line item.
GRAPH_SQL = "select 'o'||l_orderkey src, 'p'||l_partkey dst from lineitem"


def match_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


#: ``point_id, x, y, z``: parts as points around the rig.
POINTS_SQL = "select p_partkey point_id, (cast(p_retailprice as double)-949.95::double)*10 x, (p_size-25.5::double)*20 y, (p_partkey%200)*7-700::double z from part"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("point_id"),
        ((F.col("p_retailprice").cast("double") - 949.95) * 10).alias("x"),
        ((F.col("p_size") - 25.5).cast("double") * 20.0).alias("y"),
        ((F.col("p_partkey") % 200) * 7 - 700.0).cast("double").alias("z"),
    )


def _rig_rows() -> list[tuple]:
    """Seventeen cameras: a ring of fourteen flat ones, one fisheye up, two down."""
    import math

    rows = []
    for i in range(14):
        a = -2 * math.pi * i / 14
        f = (math.cos(a), math.sin(a), 0.0)
        rows.append((i, f"cam{i + 1}", "side camera", "RECTILINEAR", [21.8 * f[0], 21.8 * f[1], 0.0], list(f), [0.0, 0.0, 1.0], [f[1], -f[0], 0.0], [1269.580673376528, -1269.580673376528], None))
    for i, (name, z, y, up) in enumerate([("cam0", 13.1, 0.0, 1.0), ("cam15", -13.1, 0.0, 1.0), ("cam16", -13.1, 9.8, -1.0)]):
        forward = [0.0, 0.0, math.copysign(1.0, z)]
        # right = forward x up
        rows.append((14 + i, name, "", "FTHETA", [0.0, y, z], forward, [0.0, up, 0.0], [-forward[2] * up, 0.0, 0.0], [483.76220324, -483.76220324], 1.61443))
    return rows


RIG_SCHEMA = "ordinal int, id string, grp string, type string, origin array<double>, forward array<double>, up array<double>, right array<double>, focal array<double>, fov double, principal array<double>, resolution array<double>, distortion array<double>, version int"


def rig(spark: SparkSession) -> DataFrame:
    rows = [(*r, [1024.0, 1024.0], [2048.0, 2048.0], [0.0, 0.0], 1) for r in _rig_rows()]
    return spark.createDataFrame(rows, RIG_SCHEMA)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera for each part: those of the rig in turn, with the part's own focal length and place."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (1 + F.col("p_size") / 50.0).alias("__o"), (1 + F.col("p_size") / 100.0).alias("__f"))
    rows = part.join(F.broadcast(rig(spark)), F.col("ordinal") == F.col("k") % 17)
    scaled = lambda c, by: F.transform(c, lambda v: v * F.col(by))
    return rows.withColumns({"origin": scaled("origin", "__o"), "focal": scaled("focal", "__f"), "id": F.concat_ws("-", "id", "k")}).drop("__o", "__f")


def cameras_sql() -> str:
    own, f = "(1+p_size/50.0::double)", "(1+p_size/100.0::double)"
    return f"(select p_partkey k, ordinal, id||'-'||p_partkey id, grp, type, ox*{own} ox, oy*{own} oy, oz*{own} oz, fx, fy, fz, ux, uy, uz, rx, ry, rz, focx*{f} focx, focy*{f} focy, fov from part join {rig_sql()} r on ordinal = p_partkey%17)"


def rig_sql() -> str:
    """The rig as a VALUES list with one column for each number (``right`` is named ``ri``)."""
    def values(r: tuple) -> str:
        numbers = [*r[4], *r[5], *r[6], *r[7], *r[8]]
        return f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {', '.join(f'{n!r}::double' for n in numbers)}, {'null' if r[9] is None else repr(r[9])}::double)"

    names = "ordinal, id, grp, type, ox, oy, oz, fx, fy, fz, ux, uy, uz, rx, ry, rz, focx, focy, fov"
    return f"(select * from (values {', '.join(map(values, _rig_rows()))}) t({names}))"
