"""The two pipelines as chains of operators: subtitles and books.

A stage is a function from DataFrame to DataFrame; there is no context object. What a run leaves behind (results, errors,
counts of each retry round) is returned as tables.
"""

from __future__ import annotations

import itertools
import json
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.names import input_kind, video_id
from textloom.operators import batching, display, merge, prompts, remote, replies
from textloom.operators.html_blocks import blocks_to_html, html_to_blocks
from textloom.operators.nested import canonical, read_document
from textloom.sinks.epub import build_epubs, epub_path
from textloom.sinks.text import srt_texts, subtitle_path, write_errors, write_files
from textloom.sources.epub import is_contents, read_epubs
from textloom.sources.srt import read_subtitles
from textloom.sources.transcripts import read_merged_transcripts
from textloom.tables import cut_lineage


@dataclass
class SubtitleRun:
    """What a subtitle run gives: the segments, the SRT texts, what is still wrong, and the counts of each round."""

    segments: DataFrame
    files: DataFrame
    errors: DataFrame
    rounds: list[dict[str, int]]


def run_stages(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stages in order; the first that raises ends the run."""
    for stage in stages:
        df = df.transform(stage)
    return df


def model_segments(rows: DataFrame, track: str = "track_id", pos: str = "pos", merge_rows: bool = False) -> DataFrame:
    """``track_id, pos, id, start_s, end_s, source_text``: the rows of each track as segments, or their sentences.

    Rows with the same track and position are one: the least by text and times.
    """
    held = [c for c in ("text", "start_s", "end_s", "duration_s") if c in rows.columns]
    one = rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull()).groupBy(track, pos).agg(F.min(F.struct(*held)).alias("r_")).select(track, pos, "r_.*")
    if merge_rows:
        merged = merge.sentence_positions(cut_lineage(merge.merge_sentences(one, track, pos, "text", "start_s", "end_s", "duration_s")))
        one = merged.select(F.col("track").alias(track), F.col("position").alias(pos), "text", "start_s", "end_s", "duration_s")
    ids = merge.segment_ids(one, track, pos)
    stop = F.coalesce("end_s", F.col("start_s") + F.coalesce("duration_s", F.lit(0.0)))
    return ids.select(F.col(track).alias("track_id"), F.col(pos).cast("long").alias("pos"), "id", "start_s", stop.alias("end_s"), F.col("text").alias("source_text"))


def ask(tasks: DataFrame, make: Callable[[], remote.Provider], keep: tuple[str, ...], results: str | None = None, **options: object) -> DataFrame:
    """The results of ``tasks`` with their columns ``keep``, written once; with ``results``, a folder, a task that has a result
    there isn't sent again."""
    if results is None:
        return cut_lineage(remote.map_remote(tasks, make, keep=keep, **options))
    return remote.map_once(tasks, make, results, **options).join(tasks.select("task_id", *keep), "task_id")


def translate_segments(segments: DataFrame, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, glossary: dict[str, str] | None = None, limit: int = batching.LIMIT, results: str | None = None, **options: object) -> DataFrame:
    """``segments`` with ``translated_text``: soft and new ones in batches, hard ones (``error_class``) one to a task."""
    hard = F.coalesce(F.col("error_class") == "hard", F.lit(False)) if "error_class" in segments.columns else F.lit(False)
    base = F.when(hard, F.concat_ws("_", "track_id", "id")).otherwise(F.col("track_id"))
    todo = segments.withColumn("base_", base)
    tasks = batching.json_tasks(todo, "base_", "pos", "id", "source_text", limit=limit)
    if results is not None:
        tasks = cut_lineage(tasks)  # read for what is there, what isn't, and for both together
    asked = tasks.withColumn("prompt", prompts.build_prompt(F.col("task_type"), F.col("payload"), F.lit(source_lang), F.lit(target_lang), glossary))
    answers = ask(asked, make, ("base_id", "part"), results, **options)
    known = answers.where(~F.col("translated_text").startswith(replies.FAILED))
    failed = answers.where(F.col("translated_text").startswith(replies.FAILED)).groupBy("base_id").agg(F.max("translated_text").alias("why_"))
    fresh = todo.withColumn("translated_text", F.lit(None).cast("string"))
    applied = _apply(fresh, known)
    return applied.join(failed, F.col("base_") == F.col("base_id"), "left").withColumn("translated_text", F.coalesce("translated_text", "why_", F.lit(""))).drop("base_", "base_id", "why_")


def _apply(segments: DataFrame, answers: DataFrame) -> DataFrame:
    named = answers.select(F.col("base_id").alias("base_"), "part", F.col("translated_text").alias("reply_"))
    return replies.apply_replies(segments, named, "base_", "id", "translated_text", "reply_", "part")


def run_subtitles(rows: DataFrame, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, glossary: dict[str, str] | None = None, merge_rows: bool = False, rounds: int = 3, limit: int = batching.LIMIT, results: str | None = None, **options: object) -> SubtitleRun:
    """Rows to translated SRT texts. Without any segment the result has no rows.

    ``results`` is a folder that keeps the replies of each round: a run that is repeated sends only what has none there.
    """
    segments = cut_lineage(model_segments(rows, merge_rows=merge_rows))
    n = itertools.count()

    def translate(todo: DataFrame) -> DataFrame:
        own = None if results is None else f"{results}/round_{next(n)}"
        return translate_segments(todo, make, source_lang, target_lang, glossary, limit, own, **options)

    done, log = replies.retry_rounds(translate(segments), translate, ["track_id", "pos"], "translated_text", rounds)
    shown = display.on_screen(done, "track_id", "pos", "start_s", "end_s", "translated_text")
    files = srt_texts(shown, "track", "pos", "start_s", "end_s", "text", "part_no")
    errors = done.withColumn("kind", replies.error_class(F.col("translated_text"))).where("kind IS NOT NULL").select("kind", "track_id", "id", "source_text", "translated_text")
    return SubtitleRun(done, files, errors, log)


def run_books(chapters: DataFrame, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, glossary: dict[str, str] | None = None, limit: int = batching.LIMIT, max_tasks: int | None = None, results: str | None = None, **options: object) -> DataFrame:
    """``chapter_id, html, title_target``: the translated HTML of each chapter.

    ``chapters`` has ``book_id, chapter_pos, chapter_id, title, content``; chapter ids must be unique. Split chapters are
    put together from their parts; a failed task leaves its chapters out.
    """
    keyed = chapters.withColumn("k_", F.concat_ws("/", F.col("book_id").cast("string"), F.col("chapter_pos").cast("string")))
    blocks = blocks_to_html(keyed, "k_", "content").join(keyed.select(F.col("k_").alias("doc_key"), "book_id", "chapter_pos", "chapter_id", "title"), "doc_key")
    tasks = batching.chapter_tasks(blocks, "book_id", "chapter_pos", "chapter_id", "title", "block_no", "block_type", "html", limit)
    if max_tasks is not None:
        tasks = batching.first_tasks(tasks, ["book", "first_pos", "task_id"], max_tasks)
    tasks = cut_lineage(tasks)
    asked = tasks.withColumn("prompt", prompts.build_prompt(F.col("task_type"), F.col("payload"), F.lit(source_lang), F.lit(target_lang), glossary))
    answers = ask(asked, make, ("task_type", "first_pos"), results, **options)
    good = answers.where(~F.col("translated_text").startswith(replies.FAILED))
    whole = replies.chapter_replies(good.where("task_type = 'json_batch'"), "translated_text", "first_pos")
    named = good.where("task_type = 'split_part'").withColumn("c_", F.regexp_extract("task_id", r"^split::(.*)::part_(\d+)$", 1)).withColumn("n_", F.regexp_extract("task_id", r"::part_(\d+)$", 1).cast("long"))
    split = replies.reassemble(named, "c_", "n_", "translated_text").select("chapter_id", "html", F.lit(True).alias("injected"))
    every = whole.select("chapter_id", "html", "injected").unionByName(split).withColumn("x", replies.take_injected_title(F.col("html"), F.col("injected")))
    return every.select("chapter_id", F.col("x.html").alias("html"), F.col("x.title").alias("title_target"))


@dataclass
class BookRun:
    """What a book run gives: the books' files, their chapters, and the source blocks that are still not translated."""

    files: DataFrame
    chapters: DataFrame
    errors: DataFrame


def with_block_ids(chapters: DataFrame, key: str, pos: str, content: str) -> DataFrame:
    """``key, content`` of the chapters, each block with an ``mmg_id``: its own or one made of the chapter's place and its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, text in zip(b["p"], b["c"], strict=True):
                document = read_document(text)
                blocks = document if isinstance(document, list) else [] if document is None else [document]
                for n, x in enumerate(blocks):
                    if isinstance(x, dict) and not x.get("mmg_id"):
                        x["mmg_id"] = f"chp{p}-blk{n}"
                out.append(canonical(blocks))
            yield pd.DataFrame({key: b[key], content: out})

    kind = chapters.schema[key].dataType.simpleString()
    return chapters.select(key, F.col(pos).alias("p"), F.col(content).alias("c")).mapInPandas(run, f"{key} {kind}, {content} string")


def _repaired(blocks: DataFrame, sources: DataFrame, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, glossary: dict[str, str] | None, results: str | None, **options: object) -> tuple[DataFrame, DataFrame]:
    """``blocks`` (``k_, mmg_id, block``) with what a reply marks as failed asked for once more, and what still fails.

    ``sources`` are the source blocks (``k_, mmg_id, html``); an id is looked for in its own chapter only.
    """
    asked_id = F.concat_ws("|", "k_", "mmg_id")
    failed = replies.failed_block_ids(blocks.select("k_", F.col("block").alias("reply")), "reply", "k_")
    tasks = cut_lineage(replies.fix_tasks(sources.withColumn("b_", asked_id), failed.select(asked_id.alias("b_"))).select("task_id", "b_", "html"))
    asked = tasks.withColumn("prompt", prompts.build_prompt(F.lit("fix_batch"), F.col("html"), F.lit(source_lang), F.lit(target_lang), glossary))
    answers = ask(asked, make, ("b_", "html"), results, **options)
    good = ~F.col("translated_text").contains(replies.FAILED.rstrip("]"))
    fixes = html_to_blocks(answers.where(good), "b_", "translated_text").where("block_no = 0").select(F.col("doc_key").alias("b_"), "block")
    own = blocks.withColumn("b_", F.concat_ws("|", "k_", F.coalesce("mmg_id", F.regexp_extract("block", replies.FAILED_BLOCK, 1))))
    return replies.patch_blocks(own, fixes, "b_", "block").drop("b_"), answers.where(~good).select("b_", "html", "translated_text")


_LINKS = "k_ string, link_no int, href string, text string"


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, n, x.get("href") or "", _words(x)) for k, c in zip(b["k_"], b["content"], strict=True) for n, x in enumerate(_hyperlinks(json.loads(c)))]
        yield pd.DataFrame(rows, columns=["k_", "link_no", "href", "text"])


def _hyperlinks(value: Any) -> Iterator[dict[str, Any]]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("type") == "hyperlink":
                yield x
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]


def _words(link: dict[str, Any]) -> str:
    out, todo = [], [link.get("content")]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            todo.append(x.get("content"))
        elif isinstance(x, list):
            todo += x[::-1]
    return "".join(out)


def _relinked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for content, texts in zip(b["content"], b["texts"], strict=True):
            document = json.loads(content)
            for x, t in zip(_hyperlinks(document), texts, strict=True):
                x["content"] = [{"type": "text", "content": t}]
            out.append(canonical(document))
        yield pd.DataFrame({"k_": b["k_"], "content": out})


def _with_contents(chapters: DataFrame) -> DataFrame:
    """``chapters`` with the links of tables of contents showing the target titles of the chapters of their book."""
    title = F.coalesce("title_target", "title")
    tables = chapters.where(is_contents(F.col("chapter_id"), F.col("nav_type"), F.col("title")))
    links = tables.select("k_", "content").mapInPandas(_links, _LINKS).join(tables.select("k_", "book_id"), "k_")
    patched = replies.patch_toc(links, chapters.select("book_id", "chapter_id", title.alias("title")))
    texts = patched.groupBy("k_").agg(F.array_sort(F.collect_list(F.struct("link_no", "text"))).alias("x")).select("k_", F.transform("x", lambda x: x["text"]).alias("texts"))
    new = tables.select("k_", "content").join(texts, "k_").select("k_", "content", "texts").mapInPandas(_relinked, "k_ string, content string").withColumnRenamed("content", "new_")
    return chapters.join(new, "k_", "left").withColumn("content", F.coalesce("new_", "content")).drop("new_")


def translate_books(books: DataFrame, chapters: DataFrame, resources: DataFrame | None, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, glossary: dict[str, str] | None = None, limit: int = batching.LIMIT, results: str | None = None, **options: object) -> BookRun:
    """Books to EPUB files: translate, put chapters together, repair failed blocks, choose titles, patch contents, build.

    ``books`` has ``book_id, title, authors, language, publisher, isbn, cover``, ``chapters`` ``book_id, chapter_pos,
    chapter_id, title, nav_type, css, content`` and ``resources`` ``book_id, href, media_type, content``. A chapter that wasn't
    translated keeps its source. ``results`` is a folder that keeps replies, as for :func:`run_subtitles`.
    """
    keyed = chapters.withColumn("k_", F.concat_ws("/", F.col("book_id").cast("string"), F.col("chapter_pos").cast("string")))
    numbered = with_block_ids(keyed, "k_", "chapter_pos", "content")
    own = cut_lineage(keyed.drop("content").join(numbered, "k_"))
    html = run_books(own.drop("chapter_id").withColumnRenamed("k_", "chapter_id"), make, source_lang, target_lang, glossary, limit, results=results and f"{results}/chapters", **options)
    html = cut_lineage(html.withColumnRenamed("chapter_id", "k_"))
    blocks = html_to_blocks(html, "k_", "html").withColumnRenamed("doc_key", "k_")
    sources = blocks_to_html(own, "k_", "content").join(own.select(F.col("k_").alias("doc_key"), "chapter_pos"), "doc_key").select(F.col("doc_key").alias("k_"), batching.block_ids(F.col("chapter_pos"), F.col("block_no")).alias("mmg_id"), "html")
    fixed, errors = _repaired(cut_lineage(blocks), sources, make, source_lang, target_lang, glossary, results and f"{results}/fixes", **options)
    target = fixed.groupBy("k_").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda x: x["block"]), ","), F.lit("]")).alias("new_"))
    headings = fixed.where("block_type = 'heading'").select(F.col("k_").alias("chapter_id"), F.col("block_no").alias("pos"), F.col("block_text").alias("text"))
    titles = replies.final_titles(own.join(html.select("k_", "title_target"), "k_", "left").select("k_", "title_target", "title"), headings, "k_", "title_target", "title").select(F.col("chapter_id").alias("k_"), F.col("title").alias("title_target"))
    done = own.join(target, "k_", "left").withColumn("content", F.coalesce("new_", "content")).drop("new_").join(titles, "k_", "left")
    done = cut_lineage(_with_contents(done))
    named = books.withColumn("title_target", replies.target_title(F.col("title"), F.lit(target_lang))).withColumn("language_target", F.lit(target_lang))
    files = build_epubs(named, done, resources, "book_id").join(named.select("book_id", "title"), "book_id")
    return BookRun(files, done, errors)


def translate_book_files(spark: SparkSession, path: str, folder: str, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, **options: Any) -> BookRun:
    """All EPUB files under ``path`` as translated ones under ``folder`` (shared by the executors)."""
    tables = [cut_lineage(read_epubs(spark, path, what).withColumnRenamed("path", "book_id")) for what in ("books", "chapters", "resources")]
    run = translate_books(*tables, make, source_lang, target_lang, **options)
    write_files(run.files.withColumn("path", epub_path(F.col("title"), F.lit(target_lang))), folder, "path", "epub")
    write_errors(run.errors, posixpath.join(folder, "errors_books"))
    return run


def translate_subtitle_files(spark: SparkSession, path: str, folder: str, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, **options: Any) -> SubtitleRun:
    """All subtitle files under ``path``, merged into sentences, as translated SRT files under ``folder``."""
    rows = cut_lineage(read_subtitles(spark, path).withColumn("duration_s", F.lit(None).cast("double")))
    run = run_subtitles(rows, make, source_lang, target_lang, **({"merge_rows": True} | options))
    titles = rows.select(F.col("track_id").alias("track"), "title").distinct()
    write_files(run.files.join(titles, "track").withColumn("path", subtitle_path(F.col("title"), F.lit(target_lang))), folder, "path", "text")
    write_errors(run.errors, posixpath.join(folder, "errors_subtitles"))
    return run


def translate_path(spark: SparkSession, path: str, folder: str, make: Callable[[], remote.Provider], source_lang: str, target_lang: str, transcripts: str | None = None, **options: Any) -> BookRun | SubtitleRun:
    """The pipeline that reads ``path``: a book, a subtitle file, or the address of a video whose transcript is in the folder
    ``transcripts``. An error if none does."""
    kind, video = spark.range(1).select(input_kind(F.lit(path)), video_id(F.lit(path))).first()
    if kind is None or kind == "subtitle" and video != path and transcripts is None:
        raise ValueError(f"no pipeline reads {path!r}")
    if kind == "book":
        return translate_book_files(spark, path, folder, make, source_lang, target_lang, **options)
    if video == path:
        return translate_subtitle_files(spark, path, folder, make, source_lang, target_lang, **options)
    merged = merge.sentence_positions(cut_lineage(read_merged_transcripts(spark, [video], transcripts)))
    rows = merged.select(F.col("track").alias("track_id"), F.col("position").alias("pos"), "start_s", "end_s", "duration_s", "text")
    run = run_subtitles(rows, make, source_lang, target_lang, **options)
    write_files(run.files.withColumn("path", subtitle_path(F.col("track"), F.lit(target_lang))), folder, "path", "text")
    return run
