"""Fitting translated text to the screen: dialogue and punctuation splits, times in proportion, lines and chunks.

Everything happens inside a row, in arrays: no shuffle, no Python. A child's duration is its share of the characters; the
last child ends where its parent does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, strip

MAX_LINE, MAX_LINES, LONG = 35, 2, 80
DECIMAL = "##DECIMAL##"
# Marks after which a line may break, the first kind that occurs counting.
BREAKS = ("。", "？", "！", "，", ".", "?", "!", ",")
STRONG, WEAK = "。？！.", "，；：—,;:\\-"


def protect_decimals(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d)\.(\d)", f"$1{DECIMAL}$2")


def restore_decimals(text: Column) -> Column:
    return F.replace(text, F.lit(DECIMAL), F.lit("."))


def dialogue_parts(text: Column, compat: bool = False) -> Column:
    """The speakers' parts of a text; those after the first begin with ``- ``.

    A dash parts speakers at the start of a line or between blanks; with ``compat`` any hyphen does, also inside words.
    """
    dash = r"(?U)\s*-\s*" if compat else r"(?U)(?:^|\s+)-\s+|(?:^|\n)\s*-\s*"
    parts = F.filter(F.transform(F.split(text, dash), strip), lambda p: p != "")
    return let(parts, lambda ps: F.when(F.size(ps) > 1, F.transform(ps, lambda p, i: F.when(i > 0, F.concat(F.lit("- "), p)).otherwise(p))).otherwise(F.array(strip(text))))


def marked_parts(text: Column, marks: str) -> Column:
    """Fragments that end in one of ``marks`` (or the text does), without blank ones."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)([^{marks}]*[{marks}]|[^{marks}]+$)"), 1)
    return F.filter(F.transform(found, strip), lambda p: p != "")


def weak_parts(text: Column, longer_than: int = LONG) -> Column:
    """Fragments at weak marks of a text that is longer than ``longer_than`` and has at least two; else the text."""
    return let(marked_parts(text, WEAK), lambda parts: F.when((F.length(text) > longer_than) & (F.size(parts) > 1), parts).otherwise(F.array(text)))


def _running_lengths(parts: Column) -> Column:
    """The number of characters up to each part's end, in one pass that carries the sum."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ends"))

    def step(a: Column, p: Column) -> Column:
        return let(a["n"] + F.length(p), lambda n: F.struct(n.alias("n"), F.concat(a["ends"], F.array(n)).alias("ends")))

    return F.aggregate(parts, begin, step, lambda a: a["ends"])


def allocate(start: Column, end: Column, parts: Column) -> Column:
    """``{start, end, text}`` of each of ``parts``, in proportion to their lengths; the last ends at ``end``."""

    def timed(ps: Column) -> Column:
        def shares(ends: Column) -> Column:
            total = F.greatest(F.element_at(ends, -1), F.lit(1))
            place = lambda i: start + (end - start) * F.element_at(ends, i) / total
            return F.transform(ps, lambda p, i: F.struct(F.when(i == 0, start).otherwise(place(i)).alias("start"), F.when(i == F.size(ps) - 1, end).otherwise(place(i + 1)).alias("end"), p.alias("text")))

        return let(_running_lengths(ps), shares)

    return let(parts, timed)


def _split_timed(timed: Column, parts_of: Callable[[Column], Column], least: int = 1) -> Column:
    """Each of ``timed`` cut into parts that share its time; one without a positive duration, or with fewer than ``least``
    parts, stays whole."""
    return F.flatten(F.transform(timed, lambda s: let(parts_of(s["text"]), lambda ps: F.when((s["end"] > s["start"]) & (F.size(ps) >= least), allocate(s["start"], s["end"], ps)).otherwise(F.array(s)))))


def wrap_lines(text: Column, width: int = MAX_LINE) -> Column:
    """Lines of at most ``width`` characters, broken after the last of the first kind of mark that a line holds."""

    def cut(rest: Column) -> Column:
        head = F.substring(rest, 1, width)
        at = None
        for b in BREAKS:
            hit = F.locate(b, F.reverse(head))
            here = F.length(head) - hit + 1
            at = F.when(hit > 0, here) if at is None else at.when(hit > 0, here)
        return at.otherwise(F.lit(width))

    begin = F.struct(F.array().cast("array<string>").alias("lines"), text.alias("rest"))

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        k = cut(rest)
        return F.when(
            F.length(rest) > width,
            F.struct(F.concat(state["lines"], F.array(strip(F.substring(rest, F.lit(1), k)))).alias("lines"), strip(F.substring(rest, k + 1, F.length(rest))).alias("rest")),
        ).otherwise(state)

    # A line takes up a mark, or the whole width, or is the last one.
    marks = F.length(text) - F.length(F.translate(text, "".join(BREAKS), ""))
    steps = F.sequence(F.lit(1), marks + F.ceil(F.length(text) / F.lit(width)).cast("int") + 1)
    return F.aggregate(steps, begin, step, lambda s: F.when(s["rest"] != "", F.concat(s["lines"], F.array(s["rest"]))).otherwise(s["lines"]))


def chunks(text: Column, width: int = MAX_LINE, lines: int = MAX_LINES) -> Column:
    """Chunks of at most ``lines`` wrapped lines."""

    def grouped(wrapped: Column) -> Column:
        n = F.ceil(F.size(wrapped) / F.lit(lines)).cast("int")
        return F.when(F.size(wrapped) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(wrapped, i * lines + 1, F.lit(lines)), "\n"))).otherwise(F.array().cast("array<string>"))

    return let(wrap_lines(text, width), grouped)


def screen_parts(start: Column, end: Column, text: Column, compat: bool = False, width: int = MAX_LINE, lines: int = MAX_LINES) -> Column:
    """``array<{start, end, text}>``: what is shown of a translated segment, and when.

    A null text counts as empty. An empty text or a duration that isn't positive gives the text as it is.
    """

    def stages(shielded: Column) -> Column:
        one = F.array(F.struct(start.alias("start"), end.alias("end"), shielded.alias("text")))
        plain = F.array(F.struct(start.alias("start"), end.alias("end"), restore_decimals(shielded).alias("text")))
        dialogue = _split_timed(one, lambda t: dialogue_parts(t, compat))
        strong = _split_timed(dialogue, lambda t: marked_parts(t, STRONG))
        weak = _split_timed(strong, weak_parts, 2)
        shown = _split_timed(F.transform(weak, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), restore_decimals(s["text"]).alias("text"))), lambda t: chunks(t, width, lines))
        return F.when((shielded == "") | ~F.coalesce(end > start, F.lit(False)), plain).otherwise(shown)

    return let(protect_decimals(strip(F.coalesce(text, F.lit("")))), stages)


def on_screen(rows: DataFrame, track: str, pos: str, start: str, end: str, text: str, compat: bool = False) -> DataFrame:
    """``track, pos, part_no, start_s, end_s, text``: the parts of each row, numbered from 0."""
    parts = screen_parts(F.col(start), F.col(end), F.col(text), compat)
    return rows.select(F.col(track).alias("track"), F.col(pos).alias("pos"), F.posexplode(parts).alias("part_no", "p")).select("track", "pos", "part_no", F.round("p.start", 3).alias("start_s"), F.round("p.end", 3).alias("end_s"), F.col("p.text").alias("text"))
