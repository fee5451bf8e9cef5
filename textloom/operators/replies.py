"""Replies of a language model: repairing them, joining them back by id, finding and retrying bad ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import strip
from textloom.tables import cut_lineage

# Fixed value: how the text of a failed task begins.
FAILED = "[TRANSLATION_FAILED]"
ITEMS = "array<struct<id:string,text:string>>"
BOOK_ITEMS = "array<struct<id:string,html_content:string,injected_heading:boolean>>"



def repaired_items(reply: Column) -> Column:
    """The items ``{id, text}`` of a reply: as it is, else from its first bracket to its last brace, closed again.

    A key written twice is written once first. What still doesn't parse, or is no array, is null.
    """
    # Fixed value: a key written twice.
    fixed = F.regexp_replace(reply, r'"(id|text)"\s*:\s*"(?:id|text)"\s*:', '"$1":')
    inner = F.regexp_extract(fixed, r"(?s)(\[.*\})", 1)
    closed = F.concat(F.regexp_replace(inner, r",\s*$", ""), F.lit("]"))
    return F.coalesce(_array(F.trim(fixed), ITEMS), _array(closed, ITEMS))


def _array(text: Column, schema: str) -> Column:
    """The array in ``text``; null unless it is a complete one (a parser may accept a broken one as empty)."""
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.filter(F.from_json(text, schema), lambda x: x.isNotNull()))


def apply_replies(segments: DataFrame, replies: DataFrame, track: str, identifier: str, translated: str, reply: str, order: str) -> DataFrame:
    """``segments`` with ``translated`` set from ``replies`` of the same track, by id.

    Unknown ids are ignored; of an id that comes more than once the last one counts, by ``order`` and place; an item
    without a text sets null; a segment no reply names keeps its text.
    """
    items = replies.select(F.col(track).alias("t_"), F.col(order).alias("o_"), F.posexplode(repaired_items(F.col(reply))).alias("p_", "x")).where(F.col("x.id").isNotNull())
    last = items.groupBy("t_", F.col("x.id").alias("i_")).agg(F.max_by(F.struct(F.col("x.text").alias("text")), F.struct("o_", "p_")).alias("n_"))
    joined = segments.join(last, F.col(track).eqNullSafe(F.col("t_")) & (F.col(identifier) == F.col("i_")), "left")
    return joined.withColumn(translated, F.when(F.col("n_").isNotNull(), F.col("n_.text")).otherwise(F.col(translated))).drop("t_", "i_", "n_")


def book_items(reply: Column) -> Column:
    """The items ``{id, html_content, injected_heading}`` of a reply to a chapter batch; null if it isn't valid.

    The candidate is the first fenced block, else the text from the first bracket or brace; empty anchors are taken out.
    """
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)([\[{].*)", 1)
    candidate = F.when(fenced != "", fenced).when(bare != "", bare).otherwise(reply)
    # Fixed value: an empty anchor.
    return _array(F.trim(F.regexp_replace(candidate, r'(<a href=\\"\\"></a>)+', "")), BOOK_ITEMS)


def chapter_replies(replies: DataFrame, reply: str, order: str) -> DataFrame:
    """``chapter_id, html, injected``: the translated HTML of each chapter of batch replies; the last one counts."""
    items = replies.select(F.col(order).alias("o"), F.posexplode(book_items(F.col(reply))).alias("p", "x")).where(F.col("x.id").isNotNull() & F.col("x.html_content").isNotNull())
    return items.groupBy(F.col("x.id").alias("chapter_id")).agg(F.max_by("x.html_content", F.struct("o", "p")).alias("html"), F.max_by(F.coalesce("x.injected_heading", F.lit(False)), F.struct("o", "p")).alias("injected"))


def reassemble(parts: DataFrame, chapter: str, part: str, text: str) -> DataFrame:
    """``chapter_id, parts, html``: the parts of each split chapter joined in order; failed parts are left out."""
    good = parts.where(F.col(text).isNotNull() & ~F.col(text).startswith(FAILED))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).cast("long").alias("n"), F.col(text).alias("x")))), lambda x: x["x"]), "")
    return good.groupBy(F.col(chapter).alias("chapter_id")).agg(F.count(F.lit(1)).alias("parts"), joined.alias("html"))


def patch_blocks(blocks: DataFrame, fixes: DataFrame, identifier: str, content: str) -> DataFrame:
    """``blocks`` with ``content`` replaced where a fix has the same id; of several fixes of an id the greatest counts."""
    one = fixes.where(F.col(identifier).isNotNull()).groupBy(F.col(identifier).alias("i_")).agg(F.max(content).alias("n_"))
    return blocks.join(one, F.col(identifier) == F.col("i_"), "left").withColumn(content, F.coalesce("n_", F.col(content))).drop("i_", "n_")


def take_injected_title(html: Column, injected: Column) -> Column:
    """``{title, html}``: a leading heading of a chapter that got one injected becomes its title and is taken out."""
    # Fixed value: what a leading heading looks like.
    pattern = r"(?is)^\s*<h[1-6][^>]*>(.*?)</h[1-6]>"
    title = F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), r"<[^>]*>", ""))
    hit = F.coalesce(injected, F.lit(False)) & html.rlike(pattern)
    return F.struct(F.when(hit & (title != ""), title).alias("title"), F.when(hit, F.regexp_replace(html, pattern, "")).otherwise(html).alias("html"))


def final_titles(chapters: DataFrame, headings: DataFrame, chapter: str, target: str, source: str) -> DataFrame:
    """``chapter_id, title``: the target title, else the first heading (``chapter_id, pos, text``), else the source title."""
    first = headings.where(F.trim("text") != "").groupBy(F.col("chapter_id").alias("c_")).agg(F.min_by("text", "pos").alias("h_"))
    some = lambda c: F.when(F.trim(c) != "", c)
    return chapters.join(first, F.col(chapter) == F.col("c_"), "left").select(F.col(chapter).alias("chapter_id"), F.coalesce(some(F.col(target)), F.col("h_"), some(F.col(source))).alias("title"))


def patch_toc(links: DataFrame, titles: DataFrame, book: str = "book_id") -> DataFrame:
    """``links`` (``book, href, text``) with the target titles of the chapters of the same book they lead to, found by file name.

    The first word of ASCII letters and digits of the old text is kept in front; links to unknown chapters keep their text.
    """
    base = lambda c: F.substring_index(F.element_at(F.split(F.substring_index(c, "#", 1), "/"), -1), "_split_", 1)
    one = titles.where(F.trim("title") != "").groupBy(F.col(book).alias("toc_book_"), base(F.col("chapter_id")).alias("b_")).agg(F.max("title").alias("t_"))
    prefix = F.regexp_extract("text", r"^\s*([a-zA-Z0-9]+\s*)", 1)
    found = F.col(book).eqNullSafe(F.col("toc_book_")) & (base(F.col("href")) == F.col("b_"))
    return links.join(one, found, "left").withColumn("text", F.coalesce(F.trim(F.concat(prefix, "t_")), "text")).drop("toc_book_", "b_", "t_")


# How a book's title is marked in a language.
TITLE_PREFIXES = {"zh-CN": "【中文翻译】", "ja": "【日本語訳】"}


def target_title(title: Column, language: Column) -> Column:
    prefixes = F.create_map(*[F.lit(x) for kv in TITLE_PREFIXES.items() for x in kv])
    return F.concat(F.coalesce(F.element_at(prefixes, language), F.concat(F.lit("["), language, F.lit("] "))), title)


def is_repeated(text: Column) -> Column:
    """Whether a translation repeats itself or is in brackets: for segments, not for whole documents.

    Under 10 characters never; a character five times in a row, a run four times in a row, or a bracketed text.
    """
    t = strip(text)
    # What counts as repeated, and from which length on.
    looks = t.rlike(r"(?s)(.)\1{4,}") | t.rlike(r"(?s)(.{2,}?)\1{3,}") | (t.startswith("[") & t.endswith("]"))
    return F.coalesce((F.length(t) >= 10) & looks, F.lit(False))


def error_class(text: Column) -> Column:
    """``hard`` (repeated), ``soft`` (empty or failed) or null."""
    empty = strip(F.coalesce(text, F.lit(""))) == ""
    return F.when(is_repeated(text), F.lit("hard")).when(empty | F.coalesce(text.startswith(FAILED), F.lit(False)), F.lit("soft"))


def untranslated(source: Column, translated: Column) -> Column:
    """Whether a translation is its source, but for blanks at the ends."""
    return F.coalesce((strip(source) == strip(translated)) & (strip(source) != ""), F.lit(False))


# Fixed value: how a failed block is marked.
FAILED_BLOCK = r"\[TRANSLATION_FAILED: (chp\d+-blk\d+)\]"


def failed_block_ids(replies: DataFrame, text: str, *keep: str) -> DataFrame:
    """``mmg_id``: the blocks that replies mark as failed, each once (for each value of the columns ``keep``)."""
    found = F.regexp_extract_all(F.col(text), F.lit(FAILED_BLOCK), 1)
    return replies.select(*keep, F.explode(found).alias("mmg_id")).distinct()


def fix_tasks(blocks: DataFrame, failed: DataFrame) -> DataFrame:
    """The source blocks that need a repair, with a task id: those whose id is in the one column of ``failed``."""
    (identifier,) = failed.columns
    return blocks.join(failed, identifier, "left_semi").withColumn("task_id", F.concat(F.lit("fix::"), F.col(identifier)))


def retry_rounds(segments: DataFrame, translate: Callable[[DataFrame], DataFrame], key: list[str], translated: str, rounds: int = 3) -> tuple[DataFrame, list[dict[str, int]]]:
    """``segments`` after up to ``rounds`` rounds of translating again what is bad, and how many were bad in each.

    ``translate`` gets the bad rows with ``error_class`` (a hard one should go alone) and returns ``key`` and
    ``translated``. Each round is written before the next, so a lost executor doesn't call the model again. It ends when
    nothing is soft; hard ones that are left are counted in the last entry.
    """
    log: list[dict[str, int]] = []
    current = cut_lineage(segments)
    for n in range(rounds + 1):
        judged = current.withColumn("error_class", error_class(F.col(translated)))
        counts = {r[0]: r[1] for r in judged.where("error_class IS NOT NULL").groupBy("error_class").count().collect()}
        log.append({"hard": counts.get("hard", 0), "soft": counts.get("soft", 0)})
        if n == rounds or not counts or n and not counts.get("soft"):
            return current, log
        fixed = translate(judged.where("error_class IS NOT NULL")).select(*key, F.struct(F.col(translated).alias("v")).alias("new_"))
        current = cut_lineage(current.join(fixed, key, "left").withColumn(translated, F.when(F.col("new_").isNotNull(), F.col("new_.v")).otherwise(F.col(translated))).drop("new_"))
    return current, log
