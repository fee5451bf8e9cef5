"""Times of subtitles: seconds, ``HH:MM:SS,mmm`` and ranges of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let, strip


def format_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; milliseconds are rounded half to even and carry. Hours may take more digits.

    Null for null, NaN and infinity; a negative time, which the format can't hold, is shown as zero.
    """
    shown = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(shown)
    ms = whole * 1000 + F.bround((shown - whole) * 1000.0, 0).cast("long")
    return F.when(
        seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e12),
        F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000),
    )


def time_range(start: Column, end: Column) -> Column:
    return F.concat(format_time(start), F.lit(" --> "), format_time(end))


def end_of(start: Column, end: Column, duration: Column) -> Column:
    """The end, else the start plus the duration (null: 0)."""
    return F.coalesce(end, start + F.coalesce(duration, F.lit(0.0)))


def duration_of(start: Column, end: Column, duration: Column) -> Column:
    """The duration, else the end (null: the start) minus the start."""
    return F.coalesce(duration, F.coalesce(end, start) - start)


def seconds_of(text: Column) -> Column:
    """Seconds of ``H:M:S,ms``; null if the text isn't three numbers and a fraction."""
    parts = F.split(F.element_at(F.split(text, ","), 1), ":")
    ms = F.try_element_at(F.split(text, ","), F.lit(2)).try_cast("long")
    h, m, s = (F.try_element_at(parts, F.lit(k)).try_cast("long") for k in (1, 2, 3))
    return F.when(F.size(parts) == 3, (h * 3600 + m * 60 + s).cast("double") + ms / F.lit(1000.0))


def time_part(text: Column) -> Column:
    """``{h, m, s, ms}`` of one to three colon-separated numbers, a comma and milliseconds; null if out of range."""

    def numbers(halves: Column) -> Column:
        hms = F.transform(F.split(F.element_at(halves, 1), ":", -1), lambda x: F.trim(x).try_cast("long"))
        # One to three numbers, aligned at the seconds.
        full = F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(3 - F.size(hms), F.lit(0))), hms, F.array(F.trim(F.try_element_at(halves, F.lit(2))).try_cast("long")))
        return F.when((F.size(halves) == 2) & F.size(hms).between(1, 3), full)

    def checked(n: Column) -> Column:
        parts = [F.element_at(n, k) for k in (1, 2, 3, 4)]
        fits = parts[0].between(0, 99) & parts[1].between(0, 59) & parts[2].between(0, 59) & parts[3].between(0, 999)
        return F.when(fits, F.struct(*[p.alias(k) for p, k in zip(parts, ("h", "m", "s", "ms"), strict=True)]))

    return let(F.split(text, ",", -1), lambda halves: let(numbers(halves), checked))


def normalize_range(text: Column) -> Column:
    """``HH:MM:SS,mmm --> HH:MM:SS,mmm`` for a range in any accepted form, else one of four error codes and the text."""

    def shown(p: Column) -> Column:
        return F.format_string("%02d:%02d:%02d,%03d", p["h"], p["m"], p["s"], p["ms"])

    def judged(parts: Column) -> Column:
        both = F.transform(parts, lambda x: time_part(strip(x)))
        # The error codes.
        return let(
            both,
            lambda p: F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("ERROR_NORM_INVALID_INPUT_TYPE__"), F.coalesce(text, F.lit("None"))))
            .when(F.size(p) != 2, F.concat(F.lit("ERROR_NORM_NO_ARROW_SEPARATOR__"), strip(text)))
            .when(F.element_at(p, 1).isNull(), F.concat(F.lit("ERROR_NORM_START_PARSE_FAILED__"), strip(text)))
            .when(F.element_at(p, 2).isNull(), F.concat(F.lit("ERROR_NORM_END_PARSE_FAILED__"), strip(text)))
            .otherwise(F.concat(shown(F.element_at(p, 1)), F.lit(" --> "), shown(F.element_at(p, 2)))),
        )

    return let(F.split(strip(F.coalesce(text, F.lit(""))), "-->", -1), judged)
