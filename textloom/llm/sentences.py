"""Sentence boundaries across languages and scripts, in texts that run on over the rows of a track, and in complete texts.

A row of a track is a chunk, and so is a part of a complete text (most have only one). A map over the rows (no shuffle of texts)
turns each chunk into the transducer's events (:mod:`textloom.llm.boundaries`), its state transition function and what it lets
the chunks before it see. Chunks are then composed by a prefix scan in three levels: blocks of chunks, blocks of blocks, and
what is left of a track; the entry states come back down the same way. A task of the scan holds one block, so a track with a
third of all rows is many tasks; only events and 54-byte functions are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import boundaries as B
from textloom.operators.grouped import Columns, map_groups
from textloom.tables import cut_lineage

#: Positions of a track in a block, and blocks in a block of blocks.
BLOCK, SUPER = 512, 512

_LINK = "fn binary, cls int, said int, marks int"
_EVENTS = f"track string, pos long, row_key long, text_hash long, begun long, events binary, edge int, {_LINK}"
_EVENT_NAMES = [x.split()[0] for x in _EVENTS.split(", ")]


def _chunk(text: str, whole: bool, last: bool) -> tuple[Any, ...]:
    """The last columns of :data:`_EVENTS`."""
    events = B.scan_events(text, whole, last)
    edge = B.edge_of(text, events)
    return (B.pack_events(events), edge, B.function_of(events, edge), *B.right_of(text, events))


def _row_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(track, pos, key, h, 0, *_chunk(text or "", False, False)) for track, pos, key, h, text in zip(batch["track"], batch["pos"], batch["row_key"], batch["text_hash"], batch["text"], strict=True)]
        yield pd.DataFrame(rows, columns=_EVENT_NAMES)


def _part_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, h, text in zip(batch["row_key"], batch["text_hash"], batch["text"], strict=True):
            track = f"{key}/{h}"
            yield pd.DataFrame([(track, n, key, h, a, *_chunk(text[a:b], True, b == len(text))) for n, (a, b) in enumerate(B.cut_text(text))], columns=_EVENT_NAMES)


def _rights(rows: Columns) -> list[B.Right]:
    return [B.Right(*x) for x in zip(rows["cls"], rows["said"], rows["marks"], strict=True)]


def _compose(key: tuple, rows: Columns) -> list[tuple]:
    """The function and right context of a run of chunks, for the run's number in the level above."""
    fn, right = B.IDENTITY, B.EMPTY
    for f in rows["fn"]:
        fn = B.compose(fn, f)
    for r in reversed(_rights(rows)):
        right = r.then(right)
    return [(*key, fn, *right)]


_ENTRY = "track string, at long, state int, cls int, said int, marks int"


def _entries(rows: Columns, numbers: list[int], state: int, after: B.Right) -> list[tuple[int, int, int, int, int]]:
    """The entry state and right context of each chunk of a run, given those of the run."""
    states: list[int] = []
    for f in rows["fn"]:
        states.append(state)
        state = f[state]
    behind: list[B.Right] = []
    for r in reversed(_rights(rows)):
        behind.append(after)
        after = r.then(after)
    behind.reverse()
    return [(n, x, *r) for n, x, r in zip(numbers, states, behind, strict=True)]


def _given(rows: Columns) -> tuple[int, B.Right]:
    return rows["state"][0], B.Right(rows["e_cls"][0], rows["e_said"][0], rows["e_marks"][0])


def _top(key: tuple, rows: Columns) -> list[tuple]:
    return [(key[0], *e) for e in _entries(rows, rows["over"], B.START, B.END)]


def _down(key: tuple, rows: Columns) -> list[tuple]:
    return [(key[0], *e) for e in _entries(rows, rows["block"], *_given(rows))]


_SENT = "track string, pos long, text_hash long, ends array<int>"


def _distinct(rows: Columns, columns: tuple[str, ...]) -> Columns:
    """Copies of a row that is stored twice are one chunk: the first stands for them."""
    first = [i for i, p in enumerate(rows["pos"]) if i == 0 or p != rows["pos"][i - 1]]
    return {c: [rows[c][i] for i in first] for c in columns}


def _emit(key: tuple, rows: Columns) -> list[tuple]:
    chunks = _distinct(rows, ("pos", "fn", "cls", "said", "marks"))
    at = {n: x for n, *x in _entries(chunks, chunks["pos"], *_given(rows))}
    out = []
    for pos, h, events, edge, own in zip(rows["pos"], rows["text_hash"], rows["events"], rows["edge"], _rights(rows), strict=True):
        state, *after = at[pos]
        if ends := B.replay(B.unpack_events(events), edge, state, own, B.Right(*after)):
            out.append((key[0], pos, h, ends))
    return out


def _compose_rows(key: tuple, rows: Columns) -> list[tuple]:
    return _compose(key, _distinct(rows, ("fn", "cls", "said", "marks")))


def _scan(events: DataFrame) -> DataFrame:
    """``track, pos, row_key, end_char`` of the chunks in ``events``, as :data:`_EVENTS`; ends count from where a chunk begins its text."""
    copies = cut_lineage(events)
    held = [F.first(c).alias(c) for c in ("events", "edge", "fn", "cls", "said", "marks")]
    chunks = copies.groupBy("track", "pos", "text_hash").agg(F.min("row_key").alias("row_key"), *held).withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    blocks = cut_lineage(map_groups(chunks, ["track", "block"], ["pos", "row_key"], _compose_rows, f"track string, block long, {_LINK}").withColumn("over", F.floor(F.col("block") / SUPER).cast("long")))
    supers = map_groups(blocks, ["track", "over"], ["block"], _compose, f"track string, over long, {_LINK}")
    entry = [F.col("cls").alias("e_cls"), F.col("said").alias("e_said"), F.col("marks").alias("e_marks"), "state"]
    top = map_groups(supers, ["track"], ["over"], _top, _ENTRY).select("track", F.col("at").alias("over"), *entry)
    down = map_groups(blocks.join(top, ["track", "over"]), ["track", "over"], ["block"], _down, _ENTRY).select("track", F.col("at").alias("block"), *entry)
    ends = map_groups(chunks.join(down, ["track", "block"]), ["track", "block"], ["pos", "row_key"], _emit, _SENT)
    found = ends.select("track", "pos", "text_hash", F.explode("ends").alias("end"))
    return found.join(copies.select("track", "pos", "text_hash", "row_key", "begun"), ["track", "pos", "text_hash"]).select("track", "pos", "row_key", (F.col("begun") + F.col("end")).alias("end_char"))


def run_on_ends(rows: DataFrame, track: str, pos: str, key: str, text: str) -> DataFrame:
    """``track, pos, row_key, end_char``: the ends of sentences in texts that run on over the rows of a track.

    The ends are those of the rows' texts joined by blanks. Rows with the same track and position are copies: one of them is
    read on, and each gets the ends of its text. A row in which no sentence ends, or whose text is null or empty, gives none; it
    doesn't interrupt the sentence around it. A row whose track or position is null stands for itself; one without a key is left
    out.
    """
    own = rows.where(F.col(key).isNotNull()).select(
        F.col(track).alias("track"),
        F.when(F.col(track).isNotNull(), F.col(pos)).cast("long").alias("pos0"),
        F.col(key).cast("long").alias("row_key"),
        F.col(text).alias("text"),
    )
    own = own.select(
        F.when(F.col("pos0").isNull(), F.concat(F.lit("\0"), F.col("row_key").cast("string"))).otherwise(F.col("track")).alias("track"),
        F.coalesce("pos0", F.lit(0).cast("long")).alias("pos"),
        "row_key",
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    return _scan(own.mapInPandas(_row_events, _EVENTS))


def _complete(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``row_key, text_hash, text`` of the rows with a key and a word, those of one chunk and the others."""
    own = rows.where(F.col(key).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(key).cast("long").alias("row_key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return own.where(F.length("text") <= B.CHUNK), own.where(F.length("text") > B.CHUNK)


def _short_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A scan over one chunk is its replay from the start."""
    for batch in batches:
        found = [B.whole_text_ends(t) for t in batch["text"]]
        yield pd.DataFrame({"row_key": [k for k, e in zip(batch["row_key"], found, strict=True) for _ in e], "end_char": [x for e in found for x in e]})


def whole_text_ends(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``row_key, end_char``: the ends of the sentences of texts that are complete in one row.

    The last sentence ends where the text ends, even if cut off. Null, blank and wordless texts have none, and so have rows
    without a key; rows stored twice have theirs twice. A text of more than :data:`boundaries.CHUNK` characters is cut into
    chunks that are scanned like the rows of a track, with the same ends.
    """
    short, long = _complete(rows, key, text)
    scanned = _scan(long.mapInPandas(_part_events, _EVENTS)).select("row_key", "end_char")
    return short.mapInPandas(_short_ends, "row_key long, end_char long").unionByName(scanned)


def whole_text_units(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``row_key, sentence_no, end_char, sentence``: the sentences of texts that are complete in one row, as
    :func:`whole_text_ends` finds them."""

    def cut(texts: DataFrame, ends: Column) -> DataFrame:
        start = lambda n: F.when(n == 0, F.lit(0)).otherwise(F.element_at(ends, n))
        pieces = F.transform(ends, lambda e, n: F.struct(e.alias("end_char"), F.trim(F.translate(F.substring(F.col("text"), (start(n) + 1).cast("int"), (e - start(n)).cast("int")), "\t\r\n", "   ")).alias("sentence")))
        return texts.select("row_key", F.posexplode(pieces).alias("n", "s")).select("row_key", (F.col("n") + 1).alias("sentence_no"), "s.end_char", "s.sentence")

    short, long = _complete(rows, key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row_key": batch["row_key"], "text": batch["text"], "ends": [B.whole_text_ends(t) for t in batch["text"]]})

    one = short.mapInPandas(run, "row_key long, text string, ends array<long>")
    ends = _scan(long.mapInPandas(_part_events, _EVENTS)).groupBy("track").agg(F.array_sort(F.collect_set("end_char")).alias("ends"))
    more = long.withColumn("track", F.concat_ws("/", F.col("row_key").cast("string"), F.col("text_hash").cast("string"))).join(ends, "track").select("row_key", "text", "ends")
    return cut(one.unionByName(more), F.col("ends"))


def run_on_units(rows: DataFrame, track: str, pos: str, key: str, text: str) -> DataFrame:
    """``track, sentence_no, first_pos, last_pos, sentence``: the sentences of a track, numbered from 1.

    A row's text is cut at its ends; what a row leaves open goes on in the next. Sentences are numbered in blocks whose
    counts are summed first, so no task holds a whole track. The text after a track's last mark is its last sentence.
    """
    base = rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    one = base.groupBy(F.col(track).alias("track"), F.col(pos).cast("long").alias("pos")).agg(F.min_by(F.col(text), F.col(key)).alias("text"), F.min(F.col(key).cast("long")).alias("row_key"))
    ends = run_on_ends(base, track, pos, key, text).groupBy("row_key").agg(F.array_sort(F.collect_set("end_char")).alias("ends"))
    cut = one.join(ends, "row_key", "left").select("track", "pos", "text", F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"), F.floor(F.col("pos") / BLOCK).alias("block"))
    cut = cut_lineage(cut)
    by_track = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("track", "block").agg(F.sum(F.size("ends")).alias("n")).select("track", "block", F.coalesce(F.sum("n").over(by_track), F.lit(0)).alias("offset"))
    before = F.coalesce(F.sum(F.size("ends")).over(Window.partitionBy("track", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cut.withColumn("before", before).join(offsets, ["track", "block"])
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), "ends", F.array(F.length("text").cast("bigint")))
    pieces = numbered.select(
        "track", "pos", F.posexplode(F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda b, i: F.substring(F.col("text"), (b + 1).cast("int"), (F.element_at(bounds, i + 2) - b).cast("int")))).alias("i", "piece"), "before", "offset"
    ).withColumn("sentence_no", F.col("offset") + F.col("before") + F.col("i") + 1)
    cjk = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "piece"))), lambda x: x["piece"]), "\n")
    sentence = F.trim(F.regexp_replace(F.regexp_replace(joined, f"(?<={cjk}|[，、。]) *\\n *(?={cjk}|[0-9，、。])", ""), "\\s+", " "))
    return pieces.where(F.trim("piece") != "").groupBy("track", "sentence_no").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), sentence.alias("sentence"))
