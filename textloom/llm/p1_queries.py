"""Problem 1: sentence boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.sentences import run_on_ends, run_on_units, whole_text_ends, whole_text_units
from textloom.tables import table


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = table(spark, sf_dir, "tracks", "track_id", "source_type").where("source_type = 'manual'").select("track_id").distinct()
    return table(spark, sf_dir, "raw_segments", "track_id", "pos", "row_id", "text").join(manual, "track_id", "left_semi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_on_ends(_manual(spark, sf_dir), "track_id", "pos", "row_id", "text").select(F.lit("raw_segments").alias("source_table"), "row_key", "end_char")
    shown = whole_text_ends(table(spark, sf_dir, "subtitle_segments", "seg_key", "translated_text"), "seg_key", "translated_text")
    return raw.unionByName(shown.select(F.lit("subtitle_segments").alias("source_table"), "row_key", "end_char"))


def p1_track_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on_units(_manual(spark, sf_dir), "track_id", "pos", "row_id", "text").withColumnRenamed("track", "track_id")


def p1_subtitle_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_text_units(table(spark, sf_dir, "subtitle_segments", "seg_key", "translated_text"), "seg_key", "translated_text").withColumnRenamed("row_key", "seg_key")


def p1_last_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last sentence of each subtitle ends: where its text does."""
    ends = whole_text_ends(table(spark, sf_dir, "subtitle_segments", "seg_key", "translated_text"), "seg_key", "translated_text")
    return ends.groupBy(F.col("row_key").alias("seg_key")).agg(F.max("end_char").alias("last_end"))


def p1_track_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters and digits of all sentences of each track: those of its rows, each once."""
    units = p1_track_sentences(spark, sf_dir)
    return units.groupBy("track_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"[^\p{L}\p{N}]", ""))).alias("letters"))


QUERIES = {f.__name__: f for f in (p1_found, p1_track_sentences, p1_subtitle_sentences, p1_last_ends, p1_track_letters)}
SQL = {
    "p1_last_ends": r"""
SELECT seg_key, CAST(length(regexp_replace(translated_text, '[\s\p{Z}\x{200b}\x{feff}]+$', '')) AS BIGINT) AS last_end FROM subtitle_segments WHERE regexp_matches(translated_text, '[\p{L}\p{N}]')""",
    "p1_track_letters": r"""
WITH one AS (SELECT * FROM raw_segments WHERE track_id IN (SELECT track_id FROM tracks WHERE source_type = 'manual') AND pos IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id, pos ORDER BY row_id) = 1)
SELECT track_id, CAST(sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS BIGINT) AS letters FROM one GROUP BY track_id HAVING bool_or(trim(text) <> '')""",
}
