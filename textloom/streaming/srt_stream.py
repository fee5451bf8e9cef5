"""Subtitle files as they arrive (an extension: batch processing has no stream).

Structured Streaming watches a folder; each new file is parsed by the same expressions as in a batch, and a sink gets
whole micro-batches, so a batch that is repeated after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources.srt import parse_srt


def stream_subtitles(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``track_id, pos, start_s, end_s, text`` of the SRT files that come into ``folder``."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.srt").format("text").load(folder)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(parse_srt(F.col("value"))).alias("pos", "c"))
    return rows.select(F.regexp_replace("file", r"\.srt$", "").alias("track_id"), "pos", "c.start_s", "c.end_s", "c.text")


def write_stream(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch, transformed, into a folder of its own under ``out``."""

    def save(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
