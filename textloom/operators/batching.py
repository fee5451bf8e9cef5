"""Order-preserving greedy packing into size-bounded tasks.

A batch takes items in order and closes before the item that would exceed the limit. That is a fold, not a running sum,
but what a block of items does to the fold is a small table: once the batch open at the block's start closes, the rest is
the same whatever was in it. So blocks are folded on their own, their tables are chained in order (one row for each
block), and every block then numbers its items knowing what was open before it. No task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.grouped import Columns, map_groups
from textloom.tables import cut_lineage

#: Estimated tokens of a task: what a reply may have, by the growth in translation, with a margin.
OUTPUT_TOKENS, GROWTH, MARGIN = 64_000, 3, 0.9
LIMIT = int(OUTPUT_TOKENS / GROWTH * MARGIN)
#: Positions of a group in a block.
BLOCK = 8192


def item_tokens(identifier: Column, text: Column) -> Column:
    """Estimated tokens of an item of a JSON task; nulls count as empty."""
    return F.floor((F.length(F.coalesce(identifier, F.lit(""))) + F.length(F.coalesce(text, F.lit("")))) / 3).cast("long") + 20


def html_tokens(html: Column) -> Column:
    return F.floor(F.length(F.coalesce(html, F.lit(""))) / 3).cast("long")


def _walk(sizes: list[int], limit: int, held: int, empty: bool) -> tuple[list[int], int, bool]:
    """The number of batches closed before each item, from a batch that holds ``held``; what is open at the end."""
    closed, out = 0, []
    for s in sizes:
        if not empty and held + s > limit:
            closed += 1
            held = 0
        held, empty = held + s, False
        out.append(closed)
    return out, held, empty


def _block_table(limit: int) -> Callable[[tuple, Columns], list[tuple]]:
    def run(key: tuple, rows: Columns) -> list[tuple]:
        sizes = rows["size"]
        prefix = [0]
        for s in sizes:
            prefix.append(prefix[-1] + s)
        # For each item, as the first of a batch: the first item of the next, and what is open at the end of the block.
        tails: list[tuple[int, int]] = [(0, 0)] * (len(sizes) + 1)
        nxt, j = [0] * len(sizes), 0
        for i in range(len(sizes)):
            j = max(j, i + 1)
            while j < len(sizes) and prefix[j + 1] - prefix[i] <= limit:
                j += 1
            nxt[i] = j
        for i in range(len(sizes) - 1, -1, -1):
            tails[i] = (prefix[-1] - prefix[i], 0) if nxt[i] >= len(sizes) else (tails[nxt[i]][0], tails[nxt[i]][1] + 1)
        # Where a batch open at the block's start may close, and what follows then.
        reach, held, closed = [], [], []
        for i, s in enumerate(sizes):
            if i and prefix[i] > limit:
                break
            reach.append(prefix[i] + s)
            held.append(tails[i][0])
            closed.append(tails[i][1] + 1)
        return [(*key, reach, held, closed, prefix[-1] if len(reach) == len(sizes) else -1, *tails[0])]

    return run


def _chain(limit: int) -> Callable[[tuple, Columns], list[tuple]]:
    def run(key: tuple, rows: Columns) -> list[tuple]:
        held, empty, number, out = 0, True, 0, []
        for block, reach, helds, closed, every, held0, closed0 in zip(*[rows[c] for c in ("block", "reach", "held", "closed", "every", "held0", "closed0")], strict=True):
            out.append((*key, block, held, empty, number))
            if empty:
                held, number, empty = held0, number + closed0, False
                continue
            k = next((i for i, x in enumerate(reach) if held + x > limit), None)
            if k is None:
                held += every
            else:
                number += int(closed[k])
                held = int(helds[k])
        return out

    return run


def _number(limit: int) -> Callable[[tuple, Columns], list[tuple]]:
    def run(key: tuple, rows: Columns) -> list[tuple]:
        closed, _, _ = _walk(rows["size"], limit, rows["held"][0], rows["empty"][0])
        return [(key[0], p, rows["number"][0] + c + 1) for p, c in zip(rows["pos"], closed, strict=True)]

    return run


def greedy_batches(items: DataFrame, group: str, pos: str, size: str, limit: int = LIMIT, block: int = BLOCK, written: bool = False) -> DataFrame:
    """``grp, pos, batch_no``: the batch of each item, from 1, in order of the integer column ``pos``.

    An item over the limit is a batch of its own. Items with a null group or position are left out; items with the same
    position are taken from the smallest on. An empty table gives no row. ``items`` is read twice; unless it is ``written``
    already, what is needed of it is.
    """
    own = items.where(F.col(group).isNotNull() & F.col(pos).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    own = own.withColumn("block", F.floor(F.col("pos") / block))
    own = own if written else cut_lineage(own)
    tables = map_groups(own, ["grp", "block"], ["pos", "size"], _block_table(limit), "grp string, block long, reach array<long>, held array<long>, closed array<long>, every long, held0 long, closed0 long")
    entries = map_groups(tables, ["grp"], ["block"], _chain(limit), "grp string, block long, held long, empty boolean, number long")
    return map_groups(own.join(entries, ["grp", "block"]), ["grp", "block"], ["pos", "size"], _number(limit), "grp string, pos long, batch_no long")


def _object(identifier: Column, text: Column, key: str = "text") -> Column:
    """One object of a payload, spaced as in the payloads of stored tasks."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.concat(F.lit('{"id": '), quoted(identifier), F.lit(f', "{key}": '), quoted(text), F.lit("}"))


def json_tasks(rows: DataFrame, base: str, pos: str, identifier: str, text: str, task_type: str = "json_subtitle_batch", limit: int = LIMIT, key: str = "text") -> DataFrame:
    """``task_id, task_type, base_id, part, n_items, tokens, payload``: the rows of each ``base`` as JSON tasks, in order.

    The id is ``type_base_part_n`` and the payload ``[{"id": ..., "text": ...}]``. A batch is bounded by the limit, and so
    is what one task of Spark holds of it. Rows with the same base and position are one: the least by id and text.
    """
    own = rows.where(F.col(base).isNotNull() & F.col(pos).isNotNull()).groupBy(F.col(base).cast("string").alias("grp"), F.col(pos).cast("long").alias("pos"))
    sized = own.agg(F.min(F.struct(F.col(identifier).alias("i"), F.col(text).alias("t"))).alias("x")).select("grp", "pos", "x.i", "x.t", item_tokens(F.col("x.i"), F.col("x.t")).alias("size"))
    sized = cut_lineage(sized)  # read for the batches and for the payloads
    batched = sized.join(greedy_batches(sized, "grp", "pos", "size", limit, written=True), ["grp", "pos"])
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _object(F.col("i"), F.col("t"), key).alias("o")))), lambda x: x["o"]), ", ")
    return batched.groupBy("grp", "batch_no").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("tokens"), F.concat(F.lit("["), items, F.lit("]")).alias("payload")).select(
        F.concat_ws("_", F.lit(task_type), "grp", F.lit("part"), F.col("batch_no").cast("string")).alias("task_id"), F.lit(task_type).alias("task_type"), F.col("grp").alias("base_id"), F.col("batch_no").cast("int").alias("part"), "n_items", "tokens", "payload"
    )


def block_ids(chapter_pos: Column, block_pos: Column) -> Column:
    return F.concat(F.lit("chp"), chapter_pos.cast("string"), F.lit("-blk"), block_pos.cast("string"))


def base_chapter_id(chapter_id: Column) -> Column:
    """What stands before ``_split_``."""
    return F.substring_index(chapter_id, "_split_", 1)


def chapter_tasks(blocks: DataFrame, book: str, chapter_pos: str, chapter_id: str, title: str, block_pos: str, kind: str, html: str, limit: int = LIMIT) -> DataFrame:
    """``book, task_id, task_type, first_pos, n_chapters, tokens, payload`` of the chapters of each book, in order.

    A chapter without a heading but with a title gets one in front. A chapter within the limit joins the open batch; a
    larger one closes it and is split over its blocks, in parts ``split::chapter::part_n`` from 0. A block over the limit
    is a part of its own. Chapters without blocks have no task.
    """
    own = blocks.where(F.col(html).isNotNull()).select(
        F.col(book).alias("book"), F.col(chapter_pos).cast("long").alias("cp"), F.col(chapter_id).alias("cid"), F.col(title).alias("title"), F.col(block_pos).cast("long").alias("bp"), F.col(kind).alias("kind"), F.col(html).alias("html")
    )
    chapters = own.groupBy("book", "cp").agg(F.first("cid").alias("cid"), F.first("title").alias("title"), F.max((F.col("kind") == "heading").cast("int")).alias("has"))
    injected = chapters.where((F.col("has") == 0) & (F.coalesce("title", F.lit("")) != "")).select("book", "cp", "cid", "title", F.lit(-1).cast("long").alias("bp"), F.lit("heading").alias("kind"), F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>")).alias("html"))
    every = own.unionByName(injected)
    sizes = every.groupBy("book", "cp").agg(F.sum(F.length("html")).alias("chars"), F.max((F.col("bp") == -1).cast("int")).alias("inj"), F.max("cid").alias("cid"))
    sizes = sizes.withColumn("tokens", F.floor(F.col("chars") / 3).cast("long"))
    # An oversize chapter is as large as any batch may be and more, so it stands alone in the fold.
    folded = greedy_batches(sizes.withColumn("fold", F.least(F.col("tokens"), F.lit(limit + 1))), "book", "cp", "fold", limit)
    whole = every.join(sizes.select("book", "cp", "tokens", "inj"), ["book", "cp"])
    key = F.concat_ws("\x1f", F.col("book").cast("string"), F.col("cp").cast("string"))
    big = whole.where(F.col("tokens") > limit).withColumn("key", key).withColumn("size", html_tokens(F.col("html")))
    parts = big.join(greedy_batches(big.withColumn("at", F.col("bp") + 1), "key", "at", "size", limit).select(F.col("grp").alias("key"), (F.col("pos") - 1).alias("bp"), "batch_no"), ["key", "bp"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bp", "html"))), lambda x: x["html"]), "")
    split = parts.groupBy("book", "cp", "cid", "batch_no").agg(joined.alias("payload"), F.sum("size").alias("tokens")).select(
        "book", F.concat(F.lit("split::"), "cid", F.lit("::part_"), (F.col("batch_no") - 1).cast("string")).alias("task_id"), F.lit("split_part").alias("task_type"), F.col("cp").alias("first_pos"), F.lit(1).cast("long").alias("n_chapters"), "tokens", "payload"
    )
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1)
    small = whole.where(F.col("tokens") <= limit).groupBy("book", "cp", "cid", "tokens", "inj").agg(joined.alias("html"))
    item = F.concat(F.lit('{"id": '), quoted(F.col("cid")), F.lit(', "html_content": '), quoted(F.col("html")), F.when(F.col("inj") == 1, F.lit(', "injected_heading": true}')).otherwise(F.lit("}")))
    placed = small.join(folded.select(F.col("grp").alias("g"), F.col("pos").alias("p"), "batch_no"), (F.col("book").cast("string") == F.col("g")) & (F.col("cp") == F.col("p")))
    batch = placed.groupBy("book", "batch_no").agg(
        F.min_by("cid", "cp").alias("a"), F.max_by("cid", "cp").alias("z"), F.min("cp").alias("first_pos"), F.count(F.lit(1)).alias("n_chapters"), F.sum("tokens").alias("tokens"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cp", item.alias("o")))), lambda x: x["o"]), ", "), F.lit("]")).alias("payload")
    )
    whole_batches = batch.select("book", F.concat(F.lit("batch::"), "a", F.lit("::to::"), "z").alias("task_id"), F.lit("json_batch").alias("task_type"), "first_pos", "n_chapters", "tokens", "payload")
    return whole_batches.unionByName(split)


def first_tasks(tasks: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` tasks."""
    return tasks.orderBy(*order).limit(n)
