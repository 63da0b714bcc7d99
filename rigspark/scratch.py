"""Tables between the steps of a job: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table up to which it is broadcast; tables beyond it join by shuffle.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession, name: str = "rigspark") -> str:
    """A new folder below ``spark.checkpoint.dir``, the one that driver and executors share.

    Where the setting is missing a local session gets a temporary folder; on a cluster, where
    executors would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rigspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rigspark") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    The table is deleted when the application ends.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt to ``spark.sql.shuffle.partitions`` tasks that are not put together by their bytes.

    For rows whose work is large beside their bytes, as the points that Python places.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def small(df: DataFrame) -> DataFrame:
    """Broadcast a side of a join if it has few rows, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
