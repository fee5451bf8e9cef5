"""Subtitle files and Markdown as text, and their files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import strip
from textloom.functions.names import sanitize_filename
from textloom.functions.timecode import time_range

#: Entries of a track in a piece of its file.
BLOCK = 4096


def _pieces(rows: DataFrame, track: str, order: list[str], entry: Column, glue: str) -> DataFrame:
    """``track, piece_no, text``: the entries of each track in order, joined, in pieces of bounded size."""
    own = rows.withColumn("e_", entry)
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "e_"))), lambda x: x["e_"]), glue)
    return own.groupBy(F.col(track).alias("track"), F.floor(F.col(order[0]) / BLOCK).alias("piece_no")).agg(piece.alias("text"))


def _joined(pieces: DataFrame, glue: str, begin: Column | None = None, end: str = "") -> DataFrame:
    """One text for each track: a row of it is one file, so its size is that of a file."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda x: x["text"]), glue)
    return pieces.groupBy("track").agg(F.concat(begin if begin is not None else F.lit(""), body, F.lit(end)).alias("text"))


def numbered(rows: DataFrame, track: str, pos: str, part: str | None = None) -> DataFrame:
    """``rows`` with ``n_``, their number within the track from 1, counted in blocks of positions first."""
    block = F.floor(F.col(pos) / BLOCK)
    order = [pos] + ([part] if part else [])
    local = rows.withColumn("b_", block).withColumn("l_", F.row_number().over(Window.partitionBy(track, "b_").orderBy(*order)))
    counts = local.groupBy(F.col(track).alias("t_"), F.col("b_").alias("c_")).agg(F.count(F.lit(1)).alias("k_"))
    offset = counts.select("t_", "c_", F.coalesce(F.sum("k_").over(Window.partitionBy("t_").orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_"))
    return local.join(offset, (F.col(track) == F.col("t_")) & (F.col("b_") == F.col("c_"))).withColumn("n_", F.col("l_") + F.col("o_")).drop("b_", "l_", "t_", "c_", "o_")


def srt_texts(rows: DataFrame, track: str, pos: str, start: str, end: str, text: str, part: str | None = None) -> DataFrame:
    """``track, text``: the SRT file of each track, entries numbered from 1 in order of ``pos`` (and ``part``).

    A row without times is left out, but its number is used. An entry is number, times and text, and a blank line parts it
    from the next.
    """
    own = numbered(rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull()), track, pos, part)
    good = own.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    entry = F.concat(F.col("n_").cast("string"), F.lit("\n"), time_range(F.col(start), F.col(end)), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return _joined(_pieces(good, track, ["n_"], entry, "\n\n"), "\n\n", end="\n")


def transcript_markdown(rows: DataFrame, tracks: DataFrame, track: str, pos: str, start: str, duration: str, text: str, language: str, source_type: str) -> DataFrame:
    """``track, text``: each transcript as Markdown, a heading of times over each entry.

    ``tracks`` has a row for each track, with its language and type.
    """
    stop = F.col(start) + F.coalesce(F.col(duration), F.lit(0.0))
    entry = F.concat(F.lit("## "), time_range(F.col(start), stop), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    body = _joined(_pieces(rows.where(F.col(pos).isNotNull() & F.col(start).isNotNull()), track, [pos], entry, "\n"), "\n")
    known = tracks.select(F.col(track).alias("track"), F.coalesce(F.col(language), F.lit("None")).alias("l_"), F.coalesce(F.col(source_type), F.lit("None")).alias("s_"))
    # The labels of the listing.
    head = F.concat(F.lit("# YouTube Video Transcript: "), "track", F.lit("\n\n**Source Language:** "), "l_", F.lit("\n**Source Type:** "), "s_", F.lit(" subtitles\n\n"))
    return body.join(known, "track").select("track", F.concat(head, "text").alias("text"))


def bilingual_markdown(rows: DataFrame, tracks: DataFrame, track: str, pos: str, start: str, end: str, source: str, translated: str, language: str, source_type: str, target: str) -> DataFrame:
    """``track, text``: source and translation of each segment one below the other. A track without segments gets a note.

    ``tracks`` has a row for each track, with its language, type and target language. The two characters backslash and n
    become a blank.
    """
    # The labels of the listing.
    clean = lambda c: strip(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\\n", " "))
    own = numbered(rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull()), track, pos)
    entry = F.concat(F.lit("### 片段 "), F.col("n_").cast("string"), F.lit(" (`"), F.regexp_replace(F.coalesce(time_range(F.col(start), F.col(end)), F.lit(" --> ")), " --> ", "` --> `"), F.lit("`)\n\n原文: "), clean(source), F.lit("\n译文: "), clean(translated), F.lit("\n"))
    body = _joined(_pieces(own, track, ["n_"], entry, "\n"), "\n")
    known = tracks.select(F.col(track).alias("track"), *[F.coalesce(F.col(c), F.lit("None")).alias(a) for c, a in ((language, "l_"), (source_type, "s_"), (target, "g_"))])
    head = F.concat(F.lit("# YouTube 视频翻译: "), "track", F.lit("\n\n**原始语言:** `"), "l_", F.lit("` (类型: `"), "s_", F.lit("`)\n**目标语言:** `"), "g_", F.lit("`\n\n---\n\n"))
    return known.join(body, "track", "left").select("track", F.concat(head, F.coalesce("text", F.lit("\n**注意: 未找到任何字幕片段。**\n"))).alias("text"))


def subtitle_path(title: Column, language: Column) -> Column:
    """Where a translated track goes: ``<title>/subtitle/<title>_<language>.srt``."""
    name = sanitize_filename(title)
    return F.concat(name, F.lit("/subtitle/"), name, F.lit("_"), language, F.lit(".srt"))


def write_files(files: DataFrame, folder: str, path: str = "path", content: str = "text") -> None:
    """Each row as one file under ``folder`` (a folder all executors share): text as UTF-8, or bytes.

    A file is written beside its place and then moved there, so a task that runs again leaves no half of one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for b in batches:
            for p, c in zip(b["p"], b["c"], strict=True):
                full = os.path.normpath(os.path.join(folder, p))
                if not full.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"{p!r} lies outside the folder")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                draft = f"{full}.{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    f.write(bytes(c) if isinstance(c, (bytes, bytearray)) else c.encode())
                os.replace(draft, full)
            yield pd.DataFrame({"n": [len(b)]})

    files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_logs(results: DataFrame, path: str) -> None:
    """The log entries of a run, one JSON object in a line, encoded once."""
    results.where(F.col("log").isNotNull()).select(F.col("log").alias("value")).write.mode("overwrite").text(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """The errors that are left (``kind, id, source_text, translated_text``), whether the run succeeded or not."""
    errors.write.mode("overwrite").json(path)
