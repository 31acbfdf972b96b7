"""All queries of the core by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marrow.plans import contexts, data_quality, documents, knowledge, pipeline, storage, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = knowledge.QUERIES | documents.QUERIES | pipeline.QUERIES | contexts.QUERIES | streams.QUERIES | storage.QUERIES | data_quality.QUERIES
SQL: dict[str, str] = knowledge.SQL | documents.SQL | pipeline.SQL | contexts.SQL | streams.SQL | storage.SQL | data_quality.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ranked_search"](spark, sf_dir)
