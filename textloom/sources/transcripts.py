"""Transcripts of videos: choosing one, and fetching it through a data source of our own.

The network isn't reached from here: :class:`TranscriptSource` takes a fetcher, and the one that is there by default
answers from a folder of JSON files.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.operators.merge import merge_sentences

# Fixed value: the languages asked for first.
PREFERRED = ("en",)
ATTEMPTS, DELAY = 3, 5.0


def transcript_rank(language: Column, generated: Column, preferred: tuple[str, ...] = PREFERRED) -> Column:
    """The order of choice: manual in a preferred language, generated in one, any manual, any generated."""
    liked = F.coalesce(language.isin(*preferred), F.lit(False))
    g = F.coalesce(generated, F.lit(True))
    return F.when(liked & ~g, 0).when(liked, 1).when(~g, 2).otherwise(3)


def best_transcripts(candidates: DataFrame, video: str, language: str, generated: str, order: str, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """``video, language, source_type``: the transcript chosen for each video; among equals the first by ``order``."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.coalesce(F.col(language), F.lit("")))
    chosen = F.min_by(F.struct(F.col(language).alias("language"), F.col(generated).alias("generated")), F.struct(transcript_rank(F.col(language), F.col(generated), preferred), F.when(place > 0, place).otherwise(0), F.col(order)))
    return candidates.where(F.col(video).isNotNull()).groupBy(F.col(video).alias("video")).agg(chosen.alias("c")).select("video", "c.language", F.when(F.coalesce("c.generated", F.lit(True)), "generated").otherwise("manual").alias("source_type"))


class Disabled(Exception):
    """A video without transcripts: asking again doesn't help."""


def fetch(get: Callable[[str], list[dict]], video: str, attempts: int = ATTEMPTS, delay: float = DELAY) -> list[dict]:
    """The entries of a video's transcript; nothing after ``attempts`` failures or if there is none."""
    for n in range(attempts):
        try:
            return get(video)
        except Disabled:
            return []
        except Exception:  # noqa: BLE001
            if n + 1 < attempts:
                time.sleep(delay)
    return []


def from_folder(folder: str) -> Callable[[str], list[dict]]:
    """A fetcher that reads ``<folder>/<video>.json``: an array of ``{text, start, duration}``."""

    def get(video: str) -> list[dict]:
        path = os.path.join(folder, f"{video}.json")
        if not os.path.exists(path):
            raise Disabled(video)
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    return get


class _Video(InputPartition):
    def __init__(self, video: str) -> None:
        self.video = video


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.videos = [v for v in options.get("videos", "").split(",") if v]
        self.folder, self.delay = options.get("folder", "."), float(options.get("delay", DELAY))

    def partitions(self) -> list[InputPartition]:
        return [_Video(v) for v in self.videos]

    def read(self, partition: _Video) -> Iterator[tuple]:
        for pos, e in enumerate(fetch(from_folder(self.folder), partition.video, delay=self.delay)):
            yield partition.video, pos, float(e["start"]), float(e["duration"]), e["text"]


class TranscriptSource(DataSource):
    """``spark.read.format("transcripts").option("videos", "a,b").option("folder", ...)``: one partition for each video."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "track_id string, pos long, start_s double, duration_s double, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_merged_transcripts(spark: SparkSession, videos: list[str], folder: str, delay: float = DELAY) -> DataFrame:
    """The sentences of the transcripts of ``videos``, fetched with retries and merged; a video without one has no row."""
    spark.dataSource.register(TranscriptSource)
    rows = spark.read.format("transcripts").option("videos", ",".join(videos)).option("folder", folder).option("delay", delay).load()
    return merge_sentences(rows.withColumn("end_s", F.lit(None).cast("double")), "track_id", "pos", "text", "start_s", "end_s", "duration_s")
