"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, graph_queries, model_queries, reader_queries, record_queries, search_queries  # noqa: F401
from .queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and term overlap fused by reciprocal rank."""
    return QUERIES["rrf_fusion"](spark, sf_dir)
