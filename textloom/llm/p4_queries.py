"""Problem 4: speech transcripts into clean speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.turns import speaker_turns
from textloom.tables import table


def _turns(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    local = table(spark, sf_dir, "tracks", "track_id", "source_type").where("source_type = 'local_srt_file'").select("track_id").distinct()
    rows = table(spark, sf_dir, "raw_segments", "track_id", "pos", "row_id", "text", "start_s", "duration_s").join(local, "track_id", "left_semi")
    return speaker_turns(rows, table(spark, sf_dir, "speakers"), with_text=with_text).withColumnRenamed("track", "track_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, False).where("speaker_no IS NOT NULL").select("track_id", "speaker_no", "first_pos", "last_pos")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, True)


QUERIES = {f.__name__: f for f in (p4_found, p4_turns)}
