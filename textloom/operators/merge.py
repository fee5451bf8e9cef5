"""Re-segmenting timed rows into sentences with interpolated times.

The texts of a track, joined by blanks, are cut after sentence marks; what grows beyond a number of characters or seconds
is cut at the best delimiter. A row that ends in a mark ends a sentence whatever follows, so a track falls into runs of
rows that don't depend on each other: each run is one group, and a track of any length is many small groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import strip

MAX_CHARS, MAX_SECONDS = 250, 15.0
#: Positions of a track in a block, for numbering runs.
BLOCK = 1024

# Placeholders and the order of delimiters.
DECIMAL, PERIOD, SPECIAL = "<DECIMAL_DOT>", "<PERIOD>", "<SPECIALPUNC>"
DELIMITERS = (",", ";", ":", " and ", " but ", " or ", " so ")
TITLES = "Mr|Mrs|Miss|Ms|Dr|St"
# Fixed value: where a sentence is split.
_SPLIT = re.compile(rf"(?<!{SPECIAL})([.?!])[\"']?(?!{SPECIAL})(?=\s+|$)")


def protect(text: Column) -> Column:
    """The text with decimals, titles and runs of marks replaced or framed by placeholders, in this order."""
    # What is protected.
    t = F.regexp_replace(text, r"(\d)\.(\d)", f"$1{DECIMAL}$2")
    t = F.regexp_replace(t, "。。+", "...")
    t = F.regexp_replace(t, rf"({TITLES})\.", f"$1{PERIOD}")
    return F.regexp_replace(t, r"(?U)\s*([.?!]{2,})", f"{SPECIAL}$1{SPECIAL}")


def restore(text: str) -> str:
    return text.strip().replace(PERIOD, ".").replace(DECIMAL, ".").replace(SPECIAL, "")


def protect_text(text: str) -> str:
    t = re.sub(r"(\d)\.(\d)", rf"\1{DECIMAL}\2", text)
    t = re.sub("。。+", "...", t)
    t = re.sub(rf"({TITLES})\.", rf"\1{PERIOD}", t)
    return re.sub(r"\s*([.?!]{2,})", rf"{SPECIAL}\1{SPECIAL}", t)


def best_split(text: Column, limit: int = MAX_CHARS) -> Column:
    """Where a long text is cut: after the last of the first kind of delimiter found within ``limit``, else the last
    blank, else at ``limit``."""
    head = F.substring(text, 1, limit)
    back = F.reverse(head)

    def after(d: str) -> Column:
        # The place after the last whole occurrence: from the start of its mirror image.
        return F.length(head) - F.locate(d[::-1], back) + 1

    point = None
    for d in (*DELIMITERS, " "):
        found = F.locate(d[::-1], back) > 0
        point = F.when(found, after(d)) if point is None else point.when(found, after(d))
    return point.otherwise(F.lit(limit)).cast("int")


def best_split_text(text: str, limit: int = MAX_CHARS, begin: int = 0) -> int:
    """The same for a string, counted from ``begin``."""
    for d in (*DELIMITERS, " "):
        p = text.rfind(d, begin, begin + limit)
        if p >= 0:
            return p + len(d) - begin
    return limit


def segment_offsets(rows: DataFrame, track: str, pos: str, text: str, start: str, end: str, duration: str) -> DataFrame:
    """``track, pos, offset, n, start_s, end_s``: where each row's text stands in its track's joined text, and its time.

    Rows without words are left out; a missing start is the end of the row before. Offsets are summed over blocks of
    positions first, so one long track is many small windows.
    """
    clean = strip(F.coalesce(F.col(text), F.lit("")))
    base = rows.where(F.col(track).isNotNull() & F.col(pos).isNotNull()).select(
        F.col(track).alias("track"), F.col(pos).cast("long").alias("pos"), clean.alias("text"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(duration).alias("d"), F.floor(F.col(pos) / BLOCK).alias("block")
    )
    local = Window.partitionBy("track", "block").orderBy("pos")
    width = F.when(F.col("text") != "", F.length("text") + 1).otherwise(0)
    own = base.withColumn("before", F.coalesce(F.sum(width).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("stop", F.coalesce(F.col("s") + F.col("d"), F.col("e"), F.col("s")))
    known = Window.partitionBy("track", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("last", F.last("stop", ignorenulls=True).over(known))
    whole = own.groupBy("track", "block").agg(F.sum(width).alias("w"), F.max_by("stop", F.when(F.col("stop").isNotNull(), F.col("pos"))).alias("stop"))
    earlier = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("track", "block", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"), F.last("stop", ignorenulls=True).over(earlier).alias("stop0"))
    joined = own.join(carried, ["track", "block"]).where(F.col("text") != "")
    begin = F.coalesce("s", "last", "stop0", F.lit(0.0))
    return joined.select("track", "pos", (F.col("base") + F.col("before")).cast("long").alias("offset"), F.length("text").alias("n"), begin.alias("start_s"), (begin + F.coalesce(F.col("d"), F.coalesce(F.col("e"), begin) - begin)).alias("end_s"), "text")


def merge_run(rows: list[tuple[str, float, float]], max_chars: int = MAX_CHARS, max_seconds: float = MAX_SECONDS, compat: bool = False) -> list[tuple[str, float, float]]:
    """``(text, start, end)`` of the sentences of ``rows`` (text, start, end), in order.

    ``compat`` takes the times of the protected text's characters from the unprotected text's map by number, so
    placeholders shift them; otherwise each character keeps its own time.
    """
    raw, times = [], []
    for text, start, end in rows:
        step = (end - start) / len(text)
        raw.append(text)
        times += [start + i * step for i in range(len(text))] + [end]
    joined = " ".join(raw)
    shielded = protect_text(joined)
    if not compat:
        times = _times_of_protected(joined, shielded, times)
    out: list[tuple[str, float, float]] = []

    def emit(text: str, own: list[float]) -> None:
        if not compat:
            own = own[len(text) - len(text.lstrip()) : len(text.rstrip())]
        if shown := restore(text):
            out.append((shown, own[0] if own else 0.0, own[-1] if own else 0.0))

    at = 0
    parts: list[tuple[str, int]] = []
    for m in _SPLIT.finditer(shielded):
        parts += [(shielded[at : m.start(1)], at), (m[1], m.start(1))]
        at = m.end()
    parts.append((shielded[at:], at))
    held, own, taken = "", [], 0
    for part, place in parts:
        if not part:
            continue
        begin = taken if compat else place
        taken += len(part)
        held += part
        own += times[begin : begin + len(part)]
        # What has been cut off is passed over, not copied: a run may be one long part.
        c = t = 0
        while len(held) - c > max_chars or len(own) > t and own[-1] - own[t] > max_seconds:
            k = best_split_text(held, max_chars, c)
            if k == 0 or k >= len(held) - c:
                break
            piece = held[c : c + k].rstrip()
            emit(piece, own[t : t + len(piece)])
            start, c = c, c + k
            while c < len(held) and held[c].isspace():
                c += 1
            t += len(piece) if compat else c - start
        held, own = held[c:], own[t:]
        if part.strip() and part.strip()[-1] in ".?!":
            emit(held, own)
            held, own = "", []
    emit(held, own)
    return out


def _times_of_protected(raw: str, shielded: str, times: list[float]) -> list[float]:
    """The time of each character of the protected text: a placeholder has the time of what it stands for."""
    if shielded == raw:
        return times
    out: list[float] = []
    i = j = 0
    while j < len(shielded):
        if shielded[j] == raw[i : i + 1] and shielded[j] not in "<.。":
            out.append(times[i])
            i, j = i + 1, j + 1
            continue
        for mark in (DECIMAL, PERIOD, SPECIAL):
            if shielded.startswith(mark, j):
                out += [times[min(i, len(times) - 1)]] * len(mark)
                j += len(mark)
                i += mark != SPECIAL
                break
        else:
            while i < len(raw) and raw[i] != shielded[j] and raw[i].isspace():
                i += 1
            if shielded.startswith("...", j) and raw.startswith("。。", i):
                run = len(raw[i:]) - len(raw[i:].lstrip("。"))
                out += [times[min(i, len(times) - 1)]] * 3
                i, j = i + run, j + 3
                continue
            out.append(times[min(i, len(times) - 1)])
            i, j = i + 1, j + 1
    return out


def merge_sentences(rows: DataFrame, track: str, pos: str, text: str, start: str, end: str, duration: str, max_chars: int = MAX_CHARS, max_seconds: float = MAX_SECONDS, compat: bool = False) -> DataFrame:
    """``track, run, no, text, start_s, end_s, duration_s``: the sentences of each track, in order of run and number.

    An empty table gives no row. With ``compat`` a whole track is one run, since its shifted times depend on all text
    before: use it for small tracks only.
    """
    offsets = segment_offsets(rows, track, pos, text, start, end, duration).withColumn("block", F.floor(F.col("pos") / BLOCK))
    ends = F.col("text").rlike(r"(^|[^.?!])[.?!][\"']?$").cast("int") if not compat else F.lit(0)
    before = F.coalesce(F.sum(ends).over(Window.partitionBy("track", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = offsets.withColumn("before", before)
    base = offsets.groupBy("track", "block").agg(F.sum(ends).alias("n_ends"))
    base = base.select("track", "block", F.coalesce(F.sum("n_ends").over(Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    runs = local.join(base, ["track", "block"]).withColumn("run", (F.col("before") + F.col("base")).cast("long"))
    names = ["track", "run", "no", "text", "start_s", "end_s", "duration_s"]
    # Runs are short: a hash of track and run deals them out, and each task merges run after run.
    dealt = runs.select("track", "run", "pos", "text", "start_s", "end_s").repartition(F.xxhash64("track", "run")).sortWithinPartitions("track", "run", "pos")

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, []

        def done() -> list[tuple]:
            if key is None:
                return []
            return [(key[0], key[1], i, t, a, b, b - a) for i, (t, a, b) in enumerate(merge_run(own, max_chars, max_seconds, compat))]

        for batch in batches:
            out = []
            for t, r, x, a, b in zip(batch["track"], batch["run"], batch["text"], batch["start_s"], batch["end_s"], strict=True):
                if (t, r) != key:
                    out += done()
                    key, own = (t, r), []
                own.append((x, a, b))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(), columns=names)

    return dealt.mapInPandas(run_all, "track string, run long, no int, text string, start_s double, end_s double, duration_s double")


def sentence_positions(merged: DataFrame) -> DataFrame:
    """``merged``, as :func:`merge_sentences` gives it, with ``position``: from 0 within the track, in order of run and number.

    The sentences of the runs before are counted in blocks of runs first, so a run may have any number of them.
    """
    runs = merged.groupBy("track", "run").agg(F.count(F.lit(1)).alias("n_")).withColumn("b_", F.floor(F.col("run") / BLOCK))
    earlier = Window.partitionBy("track", "b_").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    local = runs.withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)))
    blocks = runs.groupBy("track", "b_").agg(F.sum("n_").alias("m_"))
    base = blocks.select("track", "b_", F.coalesce(F.sum("m_").over(Window.partitionBy("track").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    offsets = local.join(base, ["track", "b_"]).select("track", "run", (F.col("base_") + F.col("before_")).alias("offset_"))
    return merged.join(offsets, ["track", "run"]).withColumn("position", F.col("offset_") + F.col("no")).drop("offset_")


def segment_ids(rows: DataFrame, track: str, pos: str) -> DataFrame:
    """``rows`` with ``id``, ``seg_0000`` and so on by position within the track (counted in blocks first)."""
    block = F.floor(F.col(pos) / BLOCK)
    counts = rows.groupBy(F.col(track).alias("t_"), block.alias("b_")).agg(F.count(F.lit(1)).alias("n_"))
    offset = counts.select("t_", "b_", F.coalesce(F.sum("n_").over(Window.partitionBy("t_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_"))
    numbered = rows.withColumn("b__", block).withColumn("r_", F.row_number().over(Window.partitionBy(F.col(track), F.col("b__")).orderBy(pos)))
    joined = numbered.join(offset, F.col(track).eqNullSafe(F.col("t_")) & F.col("b__").eqNullSafe(F.col("b_")))
    return joined.withColumn("id", F.format_string("seg_%04d", F.col("o_") + F.col("r_") - 1)).drop("b__", "r_", "t_", "b_", "o_", "n_")
