"""All queries by name. The module kelk.llm is added by __spark_entry__, not from here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelk.plans import cleaning_queries, contract_queries, core_queries, label_queries, source_queries, stream_queries, text_queries

MODULES = (core_queries, cleaning_queries, text_queries, label_queries, contract_queries, source_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_queries.alerts_ewma_batch(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
