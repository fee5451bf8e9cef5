"""Queries of the core's own problems (nested records, intervals)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.intervals import interval_bounds, interval_gaps, interval_periods
from textloom.operators.nested import distinct_objects, flatten_nested, nested_paths, object_bridge
from textloom.tables import table


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters", "chapter_key", "content")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_nested(_chapters(spark, sf_dir), "chapter_key", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = nested_paths(_chapters(spark, sf_dir), "chapter_key", "content").where("parent_path IS NOT NULL")
    return below.select(F.col("doc_key").alias("chapter_key"), "node_path", "parent_path", "node_type")


def p2_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_objects(_nodes(spark, sf_dir))


def p2_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_bridge(_nodes(spark, sf_dir))


def p2_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every object; the root of a chapter is the row with the empty path."""
    return nested_paths(_chapters(spark, sf_dir), "chapter_key", "content").select(F.col("doc_key").alias("chapter_key"), "node_path", "node_id")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_bounds(table(spark, sf_dir, "raw_segments", "track_id", "start_s", "end_s", "duration_s"), "track_id", "start_s", "end_s", "duration_s")


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_bounds(table(spark, sf_dir, "subtitle_segments", "track_id", "start_s", "end_s"), "track_id", "start_s", "end_s")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_gaps(_raw(spark, sf_dir)).withColumnRenamed("entity", "track_id")


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_periods(_raw(spark, sf_dir)).withColumnRenamed("entity", "track_id")


def p5_subtitle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_gaps(_shown(spark, sf_dir)).withColumnRenamed("entity", "track_id")


def p5_subtitle_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_periods(_shown(spark, sf_dir)).withColumnRenamed("entity", "track_id")


_BOUNDS = """
SELECT track_id, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS a, CAST(round_even({end} * 1000, 0) AS BIGINT) AS b
FROM {table} WHERE track_id IS NOT NULL AND isfinite(start_s) AND isfinite({end}) AND abs(start_s) < 9e14 AND abs({end}) < 9e14
"""
_REACH = """
WITH x AS ({bounds}), y AS (
  SELECT *, max(b) OVER (PARTITION BY track_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM x WHERE b > a)
"""
_GAPS = _REACH + "SELECT track_id, reach AS gap_start_ms, a AS gap_end_ms FROM y WHERE a - reach > 500"
_PERIODS = (
    _REACH
    + """, z AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM y)
SELECT track_id, CAST(n AS INTEGER) AS period_no, min(a) AS period_start_ms, max(b) AS period_end_ms FROM z GROUP BY track_id, n"""
)

CORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_objects, p2_bridge, p2_occurrences, p5_found, p5_periods, p5_subtitle_gaps, p5_subtitle_periods)
}

_RAW_BOUNDS = _BOUNDS.format(table="raw_segments", end="coalesce(end_s, start_s + duration_s)")
_SHOWN_BOUNDS = _BOUNDS.format(table="subtitle_segments", end="end_s")
CORE_SQL: dict[str, str] = {
    "p5_found": _GAPS.format(bounds=_RAW_BOUNDS),
    "p5_periods": _PERIODS.format(bounds=_RAW_BOUNDS),
    "p5_subtitle_gaps": _GAPS.format(bounds=_SHOWN_BOUNDS),
    "p5_subtitle_periods": _PERIODS.format(bounds=_SHOWN_BOUNDS),
}
