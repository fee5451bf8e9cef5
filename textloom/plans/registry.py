"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import reference_queries
from textloom.plans.core_queries import CORE_QUERIES, CORE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**CORE_QUERIES, **reference_queries.QUERIES}
SQL: dict[str, str] = {**CORE_SQL, **reference_queries.SQL}
