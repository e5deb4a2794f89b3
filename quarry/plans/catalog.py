"""The registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import conversation_queries, etl_queries, evidence_queries, graph_queries, record_queries, resolution_queries, scope_queries, search_queries, view_queries

MODULES = (search_queries, conversation_queries, evidence_queries, graph_queries, etl_queries, scope_queries, resolution_queries, record_queries, view_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search with reranking for all questions."""
    return search_queries.search_cascade(spark, sf_dir)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
