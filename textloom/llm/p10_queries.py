"""Problem 10: missing and wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.languages import fit_and_segment, language_code
from textloom.tables import table


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return fit_and_segment(docs, "doc_id", "text", "lang").drop("label")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    right = F.coalesce((F.col("segments") == 1) & (language_code(F.col("label")) == F.col("lang")), F.lit(False))
    return fit_and_segment(docs, "doc_id", "text", "lang").where(~right).select("doc_id", "segment_no", "lang")


QUERIES = {f.__name__: f for f in (p10_found, p10_segments)}
