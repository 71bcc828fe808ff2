"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, repetition
from . import block_queries, catalog_queries, derived_queries, more_queries, page_queries, record_queries, registry, stream_queries, text_queries  # noqa: F401  registers their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of documents with their labels and sizes, the most repeated first."""
    docs = registry.table(spark, sf_dir, "documents")
    lines = repetition.repeated_lines(docs.withColumn("text", T.compact(F.col("text"))), "doc_id", F.col("text"))
    found = lines.join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    labelled = catalog.hydrate(found, registry.table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -1})
    return labelled.orderBy(F.desc("n"), "doc_id", "line")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
