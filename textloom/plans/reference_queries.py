"""Queries over the test tables, one or more for each operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import names, timecode
from textloom.operators import batching, display, html_blocks, merge, prompts, remote, replies
from textloom.plans import pipelines
from textloom.sinks import epub as epub_sink
from textloom.sinks import text as text_sink
from textloom.sources import epub as epub_source
from textloom.sources.transcripts import best_transcripts
from textloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The data never fill a task of the usual size, so batches are cut at smaller ones here.
TRACK_LIMIT, CHAPTER_LIMIT = 300, 2000
GLOSSARY = {"lantern": "Laterne", "bridge": "Brücke", "old aunt": "alte Tante"}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each track, those stored twice once."""
    s = table(spark, sf_dir, "subtitle_segments", "seg_key", "track_id", "segment_id", "pos", "start_s", "end_s", "source_text", "translated_text", "target_lang")
    first = s.groupBy("track_id", "pos").agg(F.min_by(F.struct("seg_key", "segment_id", "start_s", "end_s", "source_text", "translated_text", "target_lang"), "seg_key").alias("s"))
    return first.select("track_id", "pos", "s.*")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each track, those fetched twice once."""
    r = table(spark, sf_dir, "raw_segments", "row_id", "track_id", "pos", "start_s", "end_s", "duration_s", "text")
    first = r.groupBy("track_id", "pos").agg(F.min_by(F.struct("row_id", "start_s", "end_s", "duration_s", "text"), "row_id").alias("r"))
    return first.select("track_id", "pos", "r.*")


_SEG = "seg AS (SELECT * FROM subtitle_segments QUALIFY row_number() OVER (PARTITION BY track_id, pos ORDER BY seg_key) = 1)"
_RAW = "raw AS (SELECT * FROM raw_segments QUALIFY row_number() OVER (PARTITION BY track_id, pos ORDER BY row_id) = 1)"


def _code(x: str) -> str:
    y, x = x, f"greatest({x}, 0.0)"
    ms = f"(CAST(floor({x}) AS BIGINT) * 1000 + CAST(round_even(({x} - floor({x})) * 1000, 0) AS BIGINT))"
    return f"CASE WHEN {y} IS NOT NULL THEN printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000) END"


_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


# Times ----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH t AS (SELECT row_id, start_s, {_code("start_s")} AS code FROM raw_segments)
SELECT row_id, code, round(CAST(split_part(code, ':', 1) AS BIGINT) * 3600 + CAST(split_part(code, ':', 2) AS BIGINT) * 60
  + CAST(split_part(split_part(code, ':', 3), ',', 1) AS BIGINT) + CAST(split_part(code, ',', 2) AS BIGINT) / 1000.0, 3) AS seconds FROM t""")
def srt_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_segments", "row_id", "start_s")
    return rows.select("row_id", timecode.format_time(F.col("start_s")).alias("code")).withColumn("seconds", F.round(timecode.seconds_of(F.col("code")), 3))


@query(rf"""
WITH t AS (SELECT seg_key, CASE pos % 3 WHEN 0 THEN CAST(CAST(floor(start_s) AS BIGINT) AS VARCHAR) || ',5-->' || CAST(CAST(floor(start_s) AS BIGINT) AS VARCHAR) || ':7,12'
    WHEN 1 THEN {_code("start_s")} || ' --> ' || {_code("end_s")} ELSE translated_text END AS raw FROM subtitle_segments),
p AS (SELECT *, {_STRIP.format("coalesce(raw, '')")} AS s, len(string_split({_STRIP.format("coalesce(raw, '')")}, '-->')) AS n,
    regexp_extract(trim(split_part({_STRIP.format("coalesce(raw, '')")}, '-->', 1)), '^(?:(?:(\d+):)?(\d+):)?(\d+),(\d+)$', ['h', 'm', 's', 'f']) AS a,
    regexp_extract(trim(split_part({_STRIP.format("coalesce(raw, '')")}, '-->', 2)), '^(?:(?:(\d+):)?(\d+):)?(\d+),(\d+)$', ['h', 'm', 's', 'f']) AS b FROM t),
q AS (SELECT *, a.s <> '' AND CAST('0' || a.h AS BIGINT) <= 99 AND CAST('0' || a.m AS BIGINT) <= 59 AND CAST('0' || a.s AS BIGINT) <= 59 AND CAST('0' || a.f AS BIGINT) <= 999 AS ok_a,
    b.s <> '' AND CAST('0' || b.h AS BIGINT) <= 99 AND CAST('0' || b.m AS BIGINT) <= 59 AND CAST('0' || b.s AS BIGINT) <= 59 AND CAST('0' || b.f AS BIGINT) <= 999 AS ok_b FROM p)
SELECT seg_key, CASE WHEN coalesce(raw, '') = '' THEN 'ERROR_NORM_INVALID_INPUT_TYPE__' || coalesce(raw, 'None') WHEN n <> 2 THEN 'ERROR_NORM_NO_ARROW_SEPARATOR__' || s
  WHEN NOT ok_a THEN 'ERROR_NORM_START_PARSE_FAILED__' || s WHEN NOT ok_b THEN 'ERROR_NORM_END_PARSE_FAILED__' || s
  ELSE printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', CAST('0' || a.h AS BIGINT), CAST('0' || a.m AS BIGINT), CAST('0' || a.s AS BIGINT), CAST('0' || a.f AS BIGINT),
    CAST('0' || b.h AS BIGINT), CAST('0' || b.m AS BIGINT), CAST('0' || b.s AS BIGINT), CAST('0' || b.f AS BIGINT)) END AS norm FROM q""")
def timestamp_id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subtitle_segments", "seg_key", "pos", "start_s", "end_s", "translated_text")
    whole = F.floor("start_s").cast("string")
    raw = (
        F.when(F.col("pos") % 3 == 0, F.concat(whole, F.lit(",5-->"), whole, F.lit(":7,12")))
        .when(F.col("pos") % 3 == 1, timecode.time_range(F.col("start_s"), F.col("end_s")))
        .otherwise(F.col("translated_text"))
    )
    return rows.select("seg_key", timecode.normalize_range(raw).alias("norm"))


# Re-segmenting --------------------------------------------------------------------------------------------------------


@query(f"WITH {_SEG} SELECT track_id, pos, printf('seg_%04d', row_number() OVER (PARTITION BY track_id ORDER BY pos) - 1) AS id FROM seg")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.segment_ids(_segments(spark, sf_dir).select("track_id", "pos"), "track_id", "pos").select("track_id", "pos", "id")


@query(rf"""
SELECT seg_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_text, '(\d)\.(\d)', '\1<DECIMAL_DOT>\2', 'g'), '。。+', '...', 'g'),
    '(Mr|Mrs|Miss|Ms|Dr|St)\.', '\1<PERIOD>', 'g'), '[\s\p{{Z}}]*([.?!]{{2,}})', '<SPECIALPUNC>\1<SPECIALPUNC>', 'g') AS shielded,
  regexp_replace(translated_text, '(\d)\.(\d)', '\1##DECIMAL##\2', 'g') AS decimals FROM subtitle_segments""")
def text_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subtitle_segments").select("seg_key", merge.protect(F.col("source_text")).alias("shielded"), display.protect_decimals(F.col("translated_text")).alias("decimals"))


@query(f"""
WITH {_RAW}, t AS (SELECT track_id, pos, {_STRIP.format("coalesce(text, '')")} AS x, start_s, coalesce(start_s + duration_s, end_s, start_s) AS stop, duration_s, end_s FROM raw),
u AS (SELECT *, coalesce(start_s, last_value(stop IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s,
  coalesce(sum(CASE WHEN x <> '' THEN length(x) + 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
SELECT track_id, pos, CAST(off AS BIGINT) AS "offset", CAST(length(x) AS INTEGER) AS n, round(s, 3) AS start_s, round(s + coalesce(duration_s, coalesce(end_s, s) - s), 3) AS end_s FROM u WHERE x <> ''""")
def char_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.segment_offsets(_rows(spark, sf_dir), "track_id", "pos", "text", "start_s", "end_s", "duration_s")
    return got.select(F.col("track").alias("track_id"), "pos", "offset", "n", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query()
def sentence_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merge.merge_sentences(_rows(spark, sf_dir), "track_id", "pos", "text", "start_s", "end_s", "duration_s")
    return got.select(F.col("track").alias("track_id"), "run", "no", "text", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


def _last(d: str) -> str:
    return f"WHEN instr(reverse(h), '{d[::-1]}') > 0 THEN length(h) - instr(reverse(h), '{d[::-1]}') + 1"


@query(f"""
WITH t AS (SELECT doc_id, substr(text, 1, 250) AS h FROM documents)
SELECT doc_id, CAST(CASE {" ".join(_last(d) for d in (",", ";", ":", " and ", " but ", " or ", " so ", " "))} WHEN h IS NULL THEN 250 ELSE 250 END AS INTEGER) AS point FROM t""")
def best_split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", merge.best_split(F.col("text")).alias("point"))


# Tasks ----------------------------------------------------------------------------------------------------------------


@query("SELECT seg_key, CAST((coalesce(length(segment_id), 0) + coalesce(length(translated_text), 0)) // 3 + 20 AS BIGINT) AS tokens FROM subtitle_segments")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subtitle_segments").select("seg_key", batching.item_tokens(F.col("segment_id"), F.col("translated_text")).alias("tokens"))


_FOLD = f"""
WITH RECURSIVE {_SEG}, t AS (SELECT track_id, pos, segment_id, translated_text, (coalesce(length(segment_id), 0) + coalesce(length(translated_text), 0)) // 3 + 20 AS tok,
  row_number() OVER (PARTITION BY track_id ORDER BY pos) AS n FROM seg),
f AS (SELECT track_id, pos, n, tok AS held, 1 AS batch_no FROM t WHERE n = 1
  UNION ALL SELECT t.track_id, t.pos, t.n, CASE WHEN f.held + t.tok > {TRACK_LIMIT} THEN t.tok ELSE f.held + t.tok END,
    CASE WHEN f.held + t.tok > {TRACK_LIMIT} THEN f.batch_no + 1 ELSE f.batch_no END FROM f JOIN t ON t.track_id = f.track_id AND t.n = f.n + 1)"""


@query(_FOLD + "SELECT track_id, pos, CAST(batch_no AS BIGINT) AS batch_no FROM f")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).withColumn("tok", batching.item_tokens(F.col("segment_id"), F.col("translated_text")))
    return batching.greedy_batches(s, "track_id", "pos", "tok", TRACK_LIMIT).withColumnRenamed("grp", "track_id")


@query(
    _FOLD
    + """SELECT 'json_subtitle_batch_' || track_id || '_part_' || CAST(f.batch_no AS VARCHAR) AS task_id, count(*) AS n_items, CAST(sum(t.tok) AS BIGINT) AS tokens,
  '[' || string_agg('{"id": ' || CAST(to_json(coalesce(segment_id, '')) AS VARCHAR) || ', "text": ' || CAST(to_json(coalesce(translated_text, '')) AS VARCHAR) || '}', ', ' ORDER BY pos) || ']' AS payload
FROM f JOIN t USING (track_id, pos) GROUP BY track_id, f.batch_no"""
)
def json_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.json_tasks(_segments(spark, sf_dir), "track_id", "pos", "segment_id", "translated_text", limit=TRACK_LIMIT).select("task_id", "n_items", "tokens", "payload")


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of each book, those stored twice once."""
    c = table(spark, sf_dir, "chapters", "chapter_key", "book_id", "chapter_pos", "chapter_id", "title", "content")
    one = c.groupBy("book_id", "chapter_pos").agg(F.min_by(F.struct("chapter_key", "chapter_id", "title", "content"), "chapter_key").alias("c"))
    return one.select("book_id", "chapter_pos", "c.*")


def _chapter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chapters(spark, sf_dir)
    return html_blocks.blocks_to_html(c, "chapter_key", "content").withColumn("chapter_key", F.col("doc_key").cast("long")).join(c.drop("content"), "chapter_key")


@query()
def chapter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.chapter_tasks(_chapter_blocks(spark, sf_dir), "book_id", "chapter_pos", "chapter_id", "title", "block_no", "block_type", "html", CHAPTER_LIMIT)


@query("SELECT task_key, book_id FROM tasks ORDER BY task_key LIMIT 100")
def task_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.first_tasks(table(spark, sf_dir, "tasks", "task_key", "book_id"), ["task_key"], 100)


@query("SELECT chapter_key, 'chp' || CAST(chapter_pos AS VARCHAR) || '-blk0' AS first_block, split_part(chapter_id, '_split_', 1) AS base_id FROM chapters")
def chapter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_key", batching.block_ids(F.col("chapter_pos"), F.lit(0)).alias("first_block"), batching.base_chapter_id(F.col("chapter_id")).alias("base_id"))


# Display --------------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str, parts: Column) -> DataFrame:
    rows = table(spark, sf_dir, "subtitle_segments", "seg_key", "translated_text").where("translated_text IS NOT NULL")
    return rows.select("seg_key", F.posexplode(parts).alias("part_no", "part"))


def _parts_sql(expr: str) -> str:
    return f"SELECT seg_key, CAST(i - 1 AS INTEGER) AS part_no, p[i] AS part FROM (SELECT seg_key, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT seg_key, {expr} AS p FROM subtitle_segments WHERE translated_text IS NOT NULL))"


_DASH = rf"list_filter(list_transform(regexp_split_to_array(translated_text, '[\s\p{{Z}}]*-[\s\p{{Z}}]*'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query(_parts_sql(f"CASE WHEN len({_DASH}) > 1 THEN list_transform({_DASH}, lambda x, i: CASE WHEN i > 1 THEN '- ' || x ELSE x END) ELSE [{_STRIP.format('translated_text')}] END"))
def dialogue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, display.dialogue_parts(F.col("translated_text"), compat=True))


def _marked_sql(marks: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(translated_text, '(?s)([^{marks}]*[{marks}]|[^{marks}]+$)'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query(_parts_sql(_marked_sql("。？！.")))
def strong_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, display.marked_parts(F.col("translated_text"), display.STRONG))


_WEAK = _marked_sql("，；：—,;:\\-")


@query(_parts_sql(f"CASE WHEN length(translated_text) > 80 AND len({_WEAK}) > 1 THEN {_WEAK} ELSE [translated_text] END"))
def weak_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, display.weak_parts(F.col("translated_text")))


@query(f"""
WITH t AS (SELECT seg_key, start_s, end_s, {_marked_sql("。？！.")} AS p FROM subtitle_segments WHERE translated_text IS NOT NULL),
u AS (SELECT seg_key, start_s, end_s, len(p) AS k, i, p[i] AS x FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM t)),
v AS (SELECT *, sum(length(x)) OVER (PARTITION BY seg_key ORDER BY i) AS c, sum(length(x)) OVER (PARTITION BY seg_key) AS total FROM u)
SELECT seg_key, CAST(i - 1 AS INTEGER) AS part_no, CAST(floor((start_s + (end_s - start_s) * (c - length(x)) / total) * 1000 + 0.5) AS BIGINT) AS start_ms, CAST(floor((CASE WHEN i = k THEN end_s ELSE start_s + (end_s - start_s) * c / total END) * 1000 + 0.5) AS BIGINT) AS end_ms FROM v""")
def proportional_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subtitle_segments", "seg_key", "start_s", "end_s", "translated_text").where("translated_text IS NOT NULL")
    parts = display.allocate(F.col("start_s"), F.col("end_s"), display.marked_parts(F.col("translated_text"), display.STRONG))
    return rows.select("seg_key", F.posexplode(parts).alias("part_no", "p")).select("seg_key", "part_no", F.floor(F.col("p.start") * 1000 + 0.5).alias("start_ms"), F.floor(F.col("p.end") * 1000 + 0.5).alias("end_ms"))


def _break_sql() -> str:
    whens = " ".join(f"WHEN instr(reverse(substr(rest, 1, 35)), '{b}') > 0 THEN 36 - instr(reverse(substr(rest, 1, 35)), '{b}')" for b in "。？！，.?!,")
    return f"CASE {whens} ELSE 35 END"


@query(f"""
WITH RECURSIVE w AS (SELECT seg_key, 0 AS line_no, CAST(NULL AS VARCHAR) AS line, translated_text AS rest FROM subtitle_segments WHERE translated_text IS NOT NULL
  UNION ALL SELECT seg_key, line_no + 1, CASE WHEN length(rest) > 35 THEN {_STRIP.format(f"substr(rest, 1, {_break_sql()})")} ELSE rest END,
    CASE WHEN length(rest) > 35 THEN {_STRIP.format(f"substr(rest, {_break_sql()} + 1)")} ELSE '' END FROM w WHERE rest <> '')
SELECT seg_key, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM w WHERE line_no > 0""")
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subtitle_segments", "seg_key", "translated_text").where("translated_text IS NOT NULL")
    return rows.select("seg_key", F.posexplode(display.wrap_lines(F.col("translated_text"))).alias("line_no", "line"))


@query(f"""
WITH {_SEG} SELECT track_id, pos, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, {_STRIP.format("coalesce(translated_text, '')")} = '' AS blank FROM seg""")
def screen_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the parts of each segment begin and end: where the segment does, whatever its parts are."""
    shown = screen_segments(spark, sf_dir).groupBy("track_id", "pos")
    return shown.agg(F.min_by("start_s", "part_no").alias("start_s"), F.max_by("end_s", "part_no").alias("end_s"), F.every(F.col("text") == "").alias("blank"))


@query()
def screen_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.on_screen(_segments(spark, sf_dir), "track_id", "pos", "start_s", "end_s", "translated_text").withColumnRenamed("track", "track_id")


# Files ----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {_SEG}, t AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS n FROM seg)
SELECT track_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_code("start_s")} || ' --> ' || {_code("end_s")} || chr(10) || coalesce(translated_text, ''), chr(10) || chr(10) ORDER BY n) || chr(10) AS text
FROM t WHERE start_s IS NOT NULL AND end_s IS NOT NULL GROUP BY track_id""")
def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sink.srt_texts(_segments(spark, sf_dir), "track_id", "pos", "start_s", "end_s", "translated_text").withColumnRenamed("track", "track_id")


@query(f"""
WITH {_RAW}, b AS (SELECT track_id, string_agg('## ' || {_code("start_s")} || ' --> ' || {_code("(start_s + coalesce(duration_s, 0.0))")} || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY pos) AS body
  FROM raw WHERE start_s IS NOT NULL GROUP BY track_id)
SELECT track_id, '# YouTube Video Transcript: ' || track_id || chr(10) || chr(10) || '**Source Language:** ' || coalesce(source_lang, 'None') || chr(10) || '**Source Type:** ' || coalesce(source_type, 'None') || ' subtitles' || chr(10) || chr(10) || body AS text
FROM b JOIN tracks USING (track_id)""")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = text_sink.transcript_markdown(_rows(spark, sf_dir), table(spark, sf_dir, "tracks"), "track_id", "pos", "start_s", "duration_s", "text", "source_lang", "source_type")
    return got.withColumnRenamed("track", "track_id")


@query(rf"""
WITH {_SEG}, t AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS n FROM seg),
b AS (SELECT track_id, string_agg('### 片段 ' || CAST(n AS VARCHAR) || ' (`' || {_code("start_s")} || '` --> `' || {_code("end_s")} || '`)' || chr(10) || chr(10) || '原文: ' || {_STRIP.format("replace(coalesce(source_text, ''), '\\n', ' ')")} || chr(10)
    || '译文: ' || {_STRIP.format("replace(coalesce(translated_text, ''), '\\n', ' ')")} || chr(10), chr(10) ORDER BY n) AS body FROM t GROUP BY track_id)
SELECT track_id, '# YouTube 视频翻译: ' || track_id || chr(10) || chr(10) || '**原始语言:** `' || coalesce(source_lang, 'None') || '` (类型: `' || coalesce(source_type, 'None') || '`)' || chr(10) || '**目标语言:** `de`' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || coalesce(body, chr(10) || '**注意: 未找到任何字幕片段。**' || chr(10)) AS text FROM tracks LEFT JOIN b USING (track_id)""")
def bilingual_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "tracks").withColumn("target", F.lit("de"))
    got = text_sink.bilingual_markdown(_segments(spark, sf_dir), tracks, "track_id", "pos", "start_s", "end_s", "source_text", "translated_text", "source_lang", "source_type", "target")
    return got.withColumnRenamed("track", "track_id")


@query(r"""
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[^\-_.() A-Za-z0-9]', '_', 'g'), '__+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g') AS s FROM documents),
u AS (SELECT doc_id, text, CASE WHEN length(s) > 100 THEN CASE WHEN regexp_replace(substr(s, 1, 100), '_[^_]*$', '') = '' THEN substr(text, 1, 50) ELSE regexp_replace(substr(s, 1, 100), '_[^_]*$', '') END ELSE s END AS s FROM t)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'untitled' WHEN s = '' THEN 'untitled_video' ELSE s END AS name FROM u""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", names.sanitize_filename(F.col("text")).alias("name"))


@query("""
WITH t AS (SELECT track_id, title, CASE source_type WHEN 'manual' THEN 'https://www.youtube.com/watch?v=' || track_id || '&t=9' WHEN 'generated' THEN 'https://youtu.be/' || track_id || '?si=x' ELSE 'in/' || track_id || '.srt' END AS url FROM tracks)
SELECT track_id, CASE WHEN contains(url, 'watch?v=') THEN split_part(split_part(url, 'watch?v=', 2), '&', 1) WHEN contains(url, 'youtu.be/') THEN split_part(split_part(url, 'youtu.be/', 2), '?', 1) ELSE url END AS video,
  coalesce(CASE WHEN trim(title) <> '' THEN title END, track_id) AS title, 'subtitle' AS kind FROM t""")
def video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("source_type")
    url = F.when(kind == "manual", F.concat(F.lit("https://www.youtube.com/watch?v="), "track_id", F.lit("&t=9"))).when(kind == "generated", F.concat(F.lit("https://youtu.be/"), "track_id", F.lit("?si=x"))).otherwise(F.concat(F.lit("in/"), "track_id", F.lit(".srt")))
    t = table(spark, sf_dir, "tracks").withColumn("url", url)
    return t.select("track_id", names.video_id(F.col("url")).alias("video"), names.title_or_id(F.col("title"), F.col("track_id")).alias("title"), names.input_kind(F.col("url")).alias("kind"))


@query("""
SELECT origin_id AS video, lang AS language, CASE WHEN generated THEN 'generated' ELSE 'manual' END AS source_type FROM (
  SELECT *, lower(source) LIKE '%generated%' AS generated FROM documents WHERE origin_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY origin_id ORDER BY CASE WHEN lang = 'en' AND NOT coalesce(generated, true) THEN 0 WHEN lang = 'en' THEN 1 WHEN NOT coalesce(generated, true) THEN 2 ELSE 3 END, doc_id) = 1""")
def best_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "origin_id").withColumn("generated", F.lower("source").contains("generated"))
    return best_transcripts(docs, "origin_id", "lang", "generated", "doc_id")


# Prompts --------------------------------------------------------------------------------------------------------------


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql() -> str:
    terms = "\nGLOSSARY: use these translations.\n* \"lantern\": \"Laterne\"\n* \"bridge\": \"Brücke\"\n* \"old aunt\": \"alte Tante\"\n"
    keep = "Rules: Keep every id as it is. Keep all tags and attributes, data-mmg-id among them. Return as many objects as you were given, in order."
    heads = {
        "json_batch": f"You translate the HTML in a JSON array from en to de.\n\n{keep} Translate only what stands between tags in html_content.\n{terms}\n\nINPUT:\n",
        "split_part": f"You translate HTML from en to de.\n\nRules: Keep all tags and attributes. Return bare HTML.\n{terms}\n\nINPUT:\n",
        "json_subtitle_batch": f'You translate subtitles in a JSON array from en to de. What you can\'t translate you return in brackets, as in {{"id": "seg_1", "text": "[as it was]"}}.\n\n{keep} Translate only the text fields.\n{terms}\n\nINPUT:\n',
    }
    whens = [f"WHEN task_type = '{kind}' THEN {_STRIP.format(f"({_quote(head)} || coalesce(text_to_translate, ''))")}" for kind, head in heads.items()]
    return f"SELECT task_key, CASE {' '.join(whens)} END AS prompt FROM tasks"


@query(_prompt_sql())
def glossary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").select("task_key", prompts.build_prompt(F.col("task_type"), F.col("text_to_translate"), F.lit("en"), F.lit("de"), GLOSSARY).alias("prompt"))


@query("""
SELECT task_key, 'system' AS first_role, 'Translate the text.' AS first_content, 'user' AS second_role, 'From en to de.' || chr(10) || chr(10) || text_to_translate AS second_content, 'user' AS lone_role, [text_to_translate] AS lone_parts FROM tasks""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tasks", "task_key", "text_to_translate")
    two, one = prompts.role_messages(F.lit("Translate the text."), F.lit("From en to de."), F.col("text_to_translate")), prompts.messages(F.col("text_to_translate"))
    return t.select("task_key", two[0]["role"].alias("first_role"), two[0]["content"].alias("first_content"), two[1]["role"].alias("second_role"), two[1]["content"].alias("second_content"), one[0]["role"].alias("lone_role"), one[0]["parts"].alias("lone_parts"))


_ASKED = "Translate text_en of each segment from en to de. Return translated_segments, each with its id ({}) unchanged and {}."


@query(f"""
SELECT task_key, '{{"source_language": "en", "target_language": "de", "instructions": "{_ASKED.format("HH:MM:SS,mmm --> HH:MM:SS,mmm", "translated_text")}", "segments": ' || text_to_translate || '}}' AS by_time,
  '{{"source_language": "en", "target_language": "de", "instructions": "{_ASKED.format("seg_N", "text_de")}", "segments": ' || text_to_translate || '}}' AS by_number FROM tasks""")
def segment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tasks", "task_key", "text_to_translate")
    args = (F.col("text_to_translate"), F.lit("en"), F.lit("de"))
    return t.select("task_key", prompts.segment_request(*args).alias("by_time"), prompts.segment_request(*args, out_key="text_de", simplified_ids=True).alias("by_number"))


@query("""
SELECT book_id, 'You translate a chapter of "' || coalesce(title_source, '') || '" from ' || coalesce(language_source, '') || ' to ' || coalesce(language_target, '') || '. Tone: plain. Style: literary.' || chr(10)
  || chr(10) || 'GLOSSARY: use these translations.' || chr(10) || '* "lantern": "Laterne"' || chr(10) || '* "bridge": "Brücke"' || chr(10) || '* "old aunt": "alte Tante"' || chr(10) || chr(10) || chr(10) || 'INPUT:' || chr(10) || coalesce(isbn, '') AS prompt FROM books""")
def book_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"book_title": F.col("title_source"), "source_lang": F.col("language_source"), "target_lang": F.col("language_target"), "tone_style": F.lit("plain"), "writing_style": F.lit("literary"), "task_list_json": F.col("isbn")}
    return table(spark, sf_dir, "books").select("book_id", prompts.book_prompt(values, GLOSSARY).alias("prompt"))


# Replies --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_SEG} SELECT track_id, pos, CASE WHEN segment_id IS NULL THEN '' ELSE coalesce(translated_text, '') END AS translated FROM seg")
def json_repair_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translations, sent through payloads with a doubled key and without their end, and joined back."""
    s = _segments(spark, sf_dir)
    tasks = batching.json_tasks(s, "track_id", "pos", "segment_id", "translated_text", limit=TRACK_LIMIT)
    broken = F.concat(F.regexp_replace(F.regexp_replace("payload", r"^\[\{\"id\": ", '[{"id": "id": '), r"\]$", ', {"id": "seg_99'))
    answers = tasks.select(F.col("base_id").alias("track_id"), F.col("part").alias("part"), broken.alias("reply"))
    got = replies.apply_replies(s.withColumn("translated", F.lit("")), answers, "track_id", "segment_id", "translated", "reply", "part")
    return got.select("track_id", "pos", "translated")


@query(r"""
WITH last AS (SELECT * FROM tasks WHERE task_type = 'split_part' QUALIFY row_number() OVER (PARTITION BY llm_processing_id ORDER BY created_at DESC, task_key DESC) = 1),
p AS (SELECT regexp_extract(llm_processing_id, '^split::(.*)::part_\d+$', 1) AS chapter_id, part_number, text_to_translate AS t FROM last)
SELECT chapter_id, count(*) AS parts, string_agg(t, '' ORDER BY part_number NULLS FIRST, t) AS html FROM p WHERE t IS NOT NULL AND NOT starts_with(t, '[TRANSLATION_FAILED]') GROUP BY chapter_id""")
def split_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each split chapter, of a part that was tried again the last one."""
    parts = table(spark, sf_dir, "tasks", "task_key", "llm_processing_id", "task_type", "part_number", "text_to_translate", "created_at").where("task_type = 'split_part'")
    last = parts.groupBy("llm_processing_id").agg(F.max_by(F.struct("part_number", "text_to_translate"), F.struct("created_at", "task_key")).alias("p")).select("llm_processing_id", "p.*")
    parts = last.withColumn("chapter", F.regexp_extract("llm_processing_id", r"^split::(.*)::part_\d+$", 1))
    return replies.reassemble(parts, "chapter", "part_number", "text_to_translate")


@query("SELECT seg_key, CASE WHEN pos % 2 = 0 AND translated_text IS NOT NULL THEN translated_text ELSE source_text END AS content FROM subtitle_segments")
def fix_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "subtitle_segments")
    return replies.patch_blocks(s.select("seg_key", F.col("source_text").alias("content")), s.where("pos % 2 = 0").select("seg_key", F.col("translated_text").alias("content")), "seg_key", "content")


@query()
def final_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _chapters(spark, sf_dir).withColumn("k", F.col("chapter_key").cast("string"))
    headings = html_blocks.blocks_to_html(chapters, "k", "content").where("block_type = 'heading'").select(F.col("doc_key").alias("chapter_id"), F.col("block_no").alias("pos"), F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return replies.final_titles(chapters.withColumn("target", F.lit("")), headings, "k", "target", "title")


@query(r"""
WITH t AS (SELECT book_id AS k, split_part(list_extract(string_split(split_part(chapter_id, '#', 1), '/'), -1), '_split_', 1) AS b, max('<' || title || '>') AS t FROM chapters WHERE trim(title) <> '' GROUP BY 1, 2)
SELECT chapter_key, coalesce(trim(regexp_extract('Part ' || CAST(chapter_pos AS VARCHAR), '^\s*([a-zA-Z0-9]+\s*)', 1) || t), 'Part ' || CAST(chapter_pos AS VARCHAR)) AS text
FROM chapters LEFT JOIN t ON k IS NOT DISTINCT FROM book_id AND b = split_part(list_extract(string_split(split_part(chapter_id, '#', 1), '/'), -1), '_split_', 1)""")
def toc_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters")
    links = c.select("chapter_key", "book_id", F.concat("chapter_id", F.lit("#top")).alias("href"), F.concat(F.lit("Part "), F.col("chapter_pos").cast("string")).alias("text"))
    titles = c.where("title IS NOT NULL").select("book_id", "chapter_id", F.when(F.trim("title") != "", F.concat(F.lit("<"), "title", F.lit(">"))).alias("title"))
    return replies.patch_toc(links, titles).select("chapter_key", "text")


@query("SELECT book_id, CASE language_target WHEN 'zh-CN' THEN '【中文翻译】' WHEN 'ja' THEN '【日本語訳】' ELSE '[' || language_target || '] ' END || title_source AS title_target FROM books")
def book_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("book_id", replies.target_title(F.col("title_source"), F.col("language_target")).alias("title_target"))


_T = _STRIP.format("translated_text")
# A character five times in a row, or a run of characters four times in a row, of every length that fits; or all in brackets.
_REPEATED = f"""
r AS (SELECT seg_key, translated_text, {_T} AS t FROM subtitle_segments),
f AS (SELECT seg_key, translated_text, t, coalesce(length(t) >= 10 AND (
  len(list_filter(range(1, greatest(length(t) - 3, 1)), lambda i: substr(t, i, 5) = repeat(substr(t, i, 1), 5))) > 0
  OR len(list_filter(range(2, length(t) // 4 + 1), lambda k: len(list_filter(range(1, length(t) - 4 * k + 2), lambda i: substr(t, i, 4 * k) = repeat(substr(t, i, k), 4))) > 0)) > 0
  OR starts_with(t, '[') AND ends_with(t, ']')), false) AS repeated FROM r)"""


@query(f"WITH {_REPEATED} SELECT seg_key, repeated FROM f")
def repetition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subtitle_segments").select("seg_key", replies.is_repeated(F.col("translated_text")).alias("repeated"))


@query(f"WITH {_REPEATED} SELECT seg_key, CASE WHEN repeated THEN 'hard' WHEN coalesce(t, '') = '' OR starts_with(translated_text, '[TRANSLATION_FAILED]') THEN 'soft' END AS error_class FROM f")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subtitle_segments").select("seg_key", replies.error_class(F.col("translated_text")).alias("error_class"))


@query("SELECT seg_key, coalesce(a = b AND a <> '', false) AS untranslated FROM (SELECT seg_key, " + _STRIP.format("source_text") + " AS a, " + _STRIP.format("translated_text") + " AS b FROM subtitle_segments)")
def untranslated_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subtitle_segments").select("seg_key", replies.untranslated(F.col("source_text"), F.col("translated_text")).alias("untranslated"))


@query("SELECT DISTINCT 'chp' || CAST(chapter_pos AS VARCHAR) || '-blk0' AS mmg_id, 'fix::chp' || CAST(chapter_pos AS VARCHAR) || '-blk0' AS task_id FROM chapters WHERE chapter_pos IS NOT NULL")
def repair_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chapters", "chapter_pos").withColumn("mmg_id", batching.block_ids(F.col("chapter_pos"), F.lit(0)))
    answers = c.select(F.concat(F.lit("x [TRANSLATION_FAILED: "), "mmg_id", F.lit("] y")).alias("reply"))
    return replies.fix_tasks(c.select("mmg_id").distinct(), replies.failed_block_ids(answers, "reply"))


@query(f"WITH {_SEG} SELECT track_id, pos, coalesce(source_text, '') AS translated_text FROM seg")
def identity_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("track_id", "pos", "start_s", "end_s", F.lit(None).cast("double").alias("duration_s"), F.col("source_text").alias("text"))
    run = pipelines.run_subtitles(rows, remote.provider("identity"), "en", "de", limit=TRACK_LIMIT, rounds=1, backoff=0.0)
    return run.segments.select("track_id", "pos", "translated_text")


@query()
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("track_id", "pos", "start_s", "end_s", F.lit(None).cast("double").alias("duration_s"), F.col("source_text").alias("text"))
    run = pipelines.run_subtitles(rows, remote.provider("faulty"), "en", "de", limit=TRACK_LIMIT, rounds=2, attempts=2, backoff=0.0)
    return run.errors


@query()
def book_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _chapters(spark, sf_dir).withColumn("chapter_id", F.concat_ws("/", F.col("book_id").cast("string"), F.col("chapter_pos").cast("string"), "chapter_id"))
    return pipelines.run_books(chapters, remote.provider("substituting", glossary=GLOSSARY), "en", "de", GLOSSARY, CHAPTER_LIMIT, backoff=0.0)


# HTML and books -------------------------------------------------------------------------------------------------------


@query()
def html_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = document_blocks(spark, sf_dir)
    return b.groupBy("doc_key").agg(F.count_if(F.col("block_type") == "heading").alias("headings"), F.count_if(F.col("block_type") == "paragraph").alias("paragraphs"))


@query()
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.html_to_blocks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.blocks_to_html(table(spark, sf_dir, "chapters", "chapter_key", "content"), "chapter_key", "content")


_CHAP = "ch AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, chapter_pos ORDER BY chapter_key) = 1)"


@query(f"""
WITH {_CHAP}, m AS (SELECT DISTINCT book_id, 'i' || chapter_id AS id, chapter_id AS href FROM ch), t AS (SELECT book_id, chapter_id AS href, arg_max(title, chapter_pos) AS title FROM ch WHERE title IS NOT NULL GROUP BY ALL)
SELECT ch.book_id, ch.chapter_pos AS pos, m.href, t.title FROM ch JOIN m ON ch.book_id = m.book_id AND m.id = 'i' || ch.chapter_id LEFT JOIN t ON t.book_id = ch.book_id AND t.href = m.href""")
def spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chapters(spark, sf_dir)
    spine = c.select("book_id", F.col("chapter_pos").alias("pos"), F.concat(F.lit("i"), "chapter_id").alias("idref"))
    manifest = c.select("book_id", F.concat(F.lit("i"), "chapter_id").alias("id"), F.col("chapter_id").alias("href")).distinct()
    titles = c.where("title IS NOT NULL").select("book_id", F.concat("chapter_id", F.lit("#a")).alias("href"), "title", F.col("chapter_pos").alias("pos"))
    return epub_source.spine_chapters(spine, manifest, titles, "book_id")


@query(f"""
WITH {_CHAP}, c AS (SELECT book_id, count(*) AS n FROM ch WHERE chapter_id IS NOT NULL GROUP BY book_id)
SELECT b.book_id, {_STRIP.format("coalesce(title_source, '')")} AS title, CAST(coalesce(n, 0) AS BIGINT) AS chapters FROM books b LEFT JOIN c USING (book_id)""")
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book written as an EPUB and read again."""
    b = table(spark, sf_dir, "books")
    books = b.select("book_id", F.col("title_source").alias("title"), F.col("author_source").alias("authors"), F.col("language_source").alias("language"), F.col("publisher_source").alias("publisher"), "isbn")
    # Ids become file names, so each gets its place in front.
    chapters = _chapters(spark, sf_dir).withColumn("chapter_id", F.regexp_replace(F.concat(F.col("chapter_pos").cast("string"), F.lit("_"), F.element_at(F.split("chapter_id", "/"), -1)), r"[^\w.]", "_"))
    files = epub_sink.build_epubs(books, chapters, None, "book_id")
    return _read_back(files)


def _read_back(files: DataFrame) -> DataFrame:
    """``book_id, title, chapters`` of each file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [(k, epub_source.parse_epub(bytes(e), str(k))) for k, e in zip(x["book_id"], x["epub"], strict=True)]
            yield pd.DataFrame([(k, f.metadata.get("title"), len(f.chapters)) for k, f in found], columns=["book_id", "title", "chapters"])

    return files.mapInPandas(read, "book_id long, title string, chapters long")


@query(f"""
WITH {_CHAP} SELECT b.book_id, {_STRIP.format("coalesce(title_source, '')")} AS title, coalesce(language_source, '') AS language, {_STRIP.format("coalesce(publisher_source, '')")} AS publisher,
  list_filter(list_transform(coalesce(author_source, []), lambda x: {_STRIP.format("coalesce(x, '')")}), lambda x: x <> '') AS authors FROM books b""")
def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a book's file says of the book, read again."""
    b = table(spark, sf_dir, "books")
    books = b.select("book_id", F.col("title_source").alias("title"), F.col("author_source").alias("authors"), F.col("language_source").alias("language"), F.col("publisher_source").alias("publisher"), "isbn")
    files = epub_sink.build_epubs(books, _chapters(spark, sf_dir).limit(0), None, "book_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [(k, epub_source.parse_epub(bytes(e), str(k)).metadata) for k, e in zip(x["book_id"], x["epub"], strict=True)]
            yield pd.DataFrame([(k, m.get("title"), m.get("language"), m.get("publisher"), m.get("authors")) for k, m in found], columns=["book_id", "title", "language", "publisher", "authors"])

    return files.mapInPandas(read, "book_id long, title string, language string, publisher string, authors array<string>")


@query(f"""
WITH {_CHAP}, c AS (SELECT book_id, count(*) AS n FROM ch WHERE chapter_id IS NOT NULL GROUP BY book_id)
SELECT b.book_id, {_STRIP.format("coalesce('[de] ' || title_source, title_source, '')")} AS title, CAST(coalesce(n, 0) AS BIGINT) AS chapters FROM books b LEFT JOIN c USING (book_id)""")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book translated, repaired, titled, built as an EPUB and read again."""
    b = table(spark, sf_dir, "books")
    books = b.select("book_id", F.col("title_source").alias("title"), F.col("author_source").alias("authors"), F.col("language_source").alias("language"), F.col("publisher_source").alias("publisher"), "isbn", F.lit(None).cast("string").alias("cover"))
    named = F.regexp_replace(F.concat(F.col("chapter_pos").cast("string"), F.lit("_"), F.element_at(F.split("chapter_id", "/"), -1)), r"[^\w.]", "_")
    chapters = _chapters(spark, sf_dir).select("book_id", "chapter_pos", named.alias("chapter_id"), "title", F.lit(None).cast("string").alias("nav_type"), F.lit(None).cast("string").alias("css"), "content")
    run = pipelines.translate_books(books, chapters, None, remote.provider("substituting", glossary=GLOSSARY), "en", "de", GLOSSARY, CHAPTER_LIMIT, backoff=0.0)
    return _read_back(run.files.select("book_id", "epub"))
