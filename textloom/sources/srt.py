"""SRT and WebVTT files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.timecode import seconds_of
from textloom.operators.merge import merge_sentences

CUE = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType())]))


def _cue(block: Column) -> Column:
    lines = F.split(block, "\n")
    times = F.split(F.element_at(lines, 2), r"\s*-->\s*")
    start, end = seconds_of(F.trim(F.element_at(times, 1))), seconds_of(F.trim(F.split(F.trim(F.try_element_at(times, F.lit(2))), r"\s")[0]))
    good = (F.size(lines) >= 3) & (F.size(times) == 2) & start.isNotNull() & end.isNotNull()
    return F.when(good, F.struct(start.alias("start_s"), end.alias("end_s"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text")))


def parse_srt(text: Column) -> Column:
    """The cues of an SRT text, in order. A block needs an index line, a time line and a line of text; others are skipped."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    blocks = F.split(F.regexp_replace(clean, r"(?U)^\s+|\s+$", ""), r"\n\s*\n")
    return F.filter(F.transform(blocks, _cue), lambda c: c.isNotNull())


def parse_vtt(text: Column) -> Column:
    """The cues of a WebVTT text: notes and settings are left out, and times may lack their hours."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿?WEBVTT[^\n]*\n", ""), "\r\n?", "\n")
    times = F.regexp_replace(clean, r"(?m)(?<![\d:.])(\d{2}):(\d{2})\.(\d{3})", "00:$1:$2,$3")
    times = F.regexp_replace(times, r"(\d+:\d{2}:\d{2})\.(\d{3})", "$1,$2")
    numbered = F.regexp_replace(times, r"(?m)(^|\n)(?:[^\n]+\n)?(\d+:\d{2}:\d{2},\d{3}[ \t]*-->)", "$10\n$2")
    return parse_srt(numbered)


def parse_ass(text: Column) -> Column:
    """The cues of an ASS or SSA text in order of time: its dialogue lines, without override tags; ``\\N`` breaks a line."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x.startswith("Dialogue:"))

    def cue(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, r"^Dialogue:\s*", ""), ",", 10)
        # Hundredths of a second become milliseconds.
        seconds = lambda n: seconds_of(F.concat(F.regexp_replace(F.trim(F.try_element_at(parts, F.lit(n))), r"^(\d+:\d{2}:\d{2})[.](\d{2})$", "$1,$2"), F.lit("0")))
        body = F.regexp_replace(F.regexp_replace(F.try_element_at(parts, F.lit(10)), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
        good = seconds(2).isNotNull() & seconds(3).isNotNull() & body.isNotNull()
        return F.when(good, F.struct(seconds(2).alias("start_s"), seconds(3).alias("end_s"), body.alias("text")))

    return F.array_sort(F.filter(F.transform(lines, cue), lambda c: c.isNotNull()))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``track_id, source_lang, source_type, title, pos, start_s, end_s, text`` of all SRT, VTT, ASS and SSA files under ``path``.

    The title is the file's name without its ending; the language is ``auto``. A file that isn't UTF-8 is read as far as
    it is; a file without cues has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{srt,vtt,ass,ssa}").load(path)
    text = F.decode("content", "UTF-8")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    low = F.lower("path")
    cues = F.when(low.endswith(".vtt"), parse_vtt(text)).when(low.rlike(r"\.(ass|ssa)$"), parse_ass(text)).otherwise(parse_srt(text))
    rows = files.select(F.col("path").alias("track_id"), F.url_decode(name).alias("title"), F.posexplode(cues).alias("pos", "c"))
    return rows.select("track_id", F.lit("auto").alias("source_lang"), F.lit("local_srt_file").alias("source_type"), "title", F.col("pos").cast("long").alias("pos"), "c.start_s", "c.end_s", "c.text")


def read_merged_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """The files' sentences, as :func:`textloom.operators.merge.merge_sentences` gives them."""
    rows = read_subtitles(spark, path).withColumn("duration_s", F.lit(None).cast("double"))
    return merge_sentences(rows, "track_id", "pos", "text", "start_s", "end_s", "duration_s")
