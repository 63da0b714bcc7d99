"""Registered queries of the corpus operators: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rigspark.llm.oracles import MERKLE_SQL, NEGATIVES_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.html import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.sharding import shard_report

    return shard_report(_table(spark, sf_dir, "documents"), shards=24)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="rigspark")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.url_filter import UrlFilter, judge_urls, labelled_urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = UrlFilter.train(labelled_urls(pages, _table(spark, sf_dir, "labels")))
    return judge_urls(pages, model).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.ann import neighbours_of_every_twentieth

    return neighbours_of_every_twentieth(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.hyperplane_tree import negatives_of_every_fiftieth

    return negatives_of_every_fiftieth(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rigspark.llm.packing import packing_report

    return packing_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rigspark.llm.merkle import dataset_manifest

    return dataset_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": NEGATIVES_SQL, "op13_merkle": MERKLE_SQL}
