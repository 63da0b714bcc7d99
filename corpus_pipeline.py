"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``;
the last adds ``shard`` and ``slot``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties and further
columns of any name, which stay (but ``shard`` and ``slot`` at the end): a null text is judged like
an empty one by the classifier, has no words for the joins and the benchmark, and so gets no copies
in the mix; a null source is a source of its own; rows with a null id, or that repeat a kept id,
are no copies of others.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rigspark.llm.common import small_batches, written
from rigspark.llm.decontamination import decontaminate
from rigspark.llm.mixing import mixed
from rigspark.llm.ngram_join import near_duplicates
from rigspark.llm.quality import keep_quality, train_quality
from rigspark.llm.sharding import interleave

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go."""
    small_batches(spark)
    return keep_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or in a chain, one stays."""
    small_batches(spark)
    return near_duplicates(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every shard holds the sources in the proportion of the whole."""
    return interleave(docs, SHARDS)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("source_mix", source_mix), ("shards", shards)]

#: The network and the join on word sets are not expressible in SQL; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
