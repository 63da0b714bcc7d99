"""Registered queries of the package outside the corpus operators, and the flagship query."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark import catalog

MODULES = ("scalars", "statistics", "grids", "cameras", "jobs")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"rigspark.catalog.{name}")


def queries() -> dict[str, catalog.Query]:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cameras lost frames, and what is each one's robust error level?"""
    from rigspark import bindings as B
    from rigspark.operators.sequence import assign_ordinals, detect_gaps
    from rigspark.operators.stats import error_report, reject_outliers

    packets = B.stream(spark, sf_dir)
    lost = detect_gaps(packets, ["serial"], "counter").groupBy("serial").agg(F.count(F.lit(1)).alias("gaps"), F.sum("lost").alias("lost"))
    errors = error_report(reject_outliers(packets, ["serial"], "value", 3.0), ["serial"], "value").drop("worst")
    return assign_ordinals(packets, "serial").join(lost, "serial", "left").join(errors, "serial").fillna(0, ["gaps", "lost"])
