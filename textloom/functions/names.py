"""Names: file names, video ids, titles, and which pipeline an input belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let

MAX_NAME = 100


def sanitize_filename(name: Column) -> Column:
    """A valid file name: other characters become underscores, runs of them one, at most 100 characters.

    A longer name is cut at its last underscore within the limit. Null and empty become ``untitled``, a name of which
    nothing is left ``untitled_video``.
    """
    runs = F.regexp_replace(F.regexp_replace(name, r"[^\-_.() A-Za-z0-9]", "_"), "__+", "_")

    def cut(safe: Column) -> Column:
        head = F.regexp_replace(F.substring(safe, 1, MAX_NAME), "_[^_]*$", "")
        return F.when(F.length(safe) > MAX_NAME, let(head, lambda h: F.when(h == "", F.substring(name, 1, MAX_NAME // 2)).otherwise(h))).otherwise(safe)

    short = let(let(F.regexp_replace(runs, "^[_ ]+|[_ ]+$", ""), cut), lambda x: F.when(x == "", F.lit("untitled_video")).otherwise(x))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("untitled")).otherwise(short)


def video_id(url: Column) -> Column:
    """The id in a watch or short address, else the input itself."""
    watch = F.substring_index(F.substring_index(url, "watch?v=", -1), "&", 1)
    short = F.substring_index(F.substring_index(url, "youtu.be/", -1), "?", 1)
    return F.when(url.contains("watch?v="), watch).when(url.contains("youtu.be/"), short).otherwise(url)


def title_or_id(title: Column, identifier: Column) -> Column:
    return F.coalesce(F.when(F.trim(title) != "", title), identifier)


def input_kind(path: Column) -> Column:
    """``book``, ``subtitle`` or null for what no pipeline reads."""
    low = F.lower(F.trim(path))
    return (
        F.when(low.rlike(r"\.epub$"), F.lit("book"))
        .when(low.rlike(r"^(https?://)?([\w\-]+\.)?(youtube\.com|youtu\.be)/") | low.rlike(r"\.(srt|vtt|ass)$"), F.lit("subtitle"))
    )
