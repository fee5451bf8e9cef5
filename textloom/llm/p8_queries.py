"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.leaks import find_leaks
from textloom.tables import table


def _leaks(spark: SparkSession, sf_dir: str, largest: bool) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text", largest)
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"), "units")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, False).select("doc_id", "item_id")


QUERIES = {f.__name__: f for f in (p8_found, p8_leaks)}
