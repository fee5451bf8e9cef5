"""All queries of this package by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import p1_queries, p3_queries, p4_queries, p6_queries, p7_queries, p8_queries, p9_queries, p10_queries

_MODULES = (p1_queries, p3_queries, p4_queries, p6_queries, p7_queries, p8_queries, p9_queries, p10_queries)
LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
LLM_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
