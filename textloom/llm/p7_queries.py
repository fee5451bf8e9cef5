"""Problem 7: broken prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.pairs import broken_pairs
from textloom.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "subtitle_segments", "seg_key", "source_text", "translated_text", "target_lang")
    return broken_pairs(pairs, "seg_key", "source_text", "translated_text", "target_lang").withColumnRenamed("pair_key", "seg_key")


QUERIES = {"p7_found": p7_found}
