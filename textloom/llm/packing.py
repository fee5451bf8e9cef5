"""Filling containers of fixed capacity with the items of a group: hierarchical residual packing.

Items are dealt to parts of bounded size, in order of size, so that each part gets the same share of every size and what
fits together is found in one part. Each part packs its items by best fit, largest first, emits its nearly full bins, and
hands underfull bins on as items. Parts are then merged eight to one and the bins handed on are packed again, until one
part is left.

No task holds a whole group, and yet no bin that could still be filled is lost. After best fit any two bins of a part
exceed the capacity together, so one at most is half empty; a merge of eight parts can therefore put bins into bins seven
times at most, and what a part emits could be of use only if more than seven times the merges to come were emptier. So a part
hands on that many of its emptiest bins and one more (:func:`kept`), which grows with the logarithm of the group.

How many rounds a group needs follows from its number of rows, which is counted first. Only keys and sizes are moved; texts
aren't, but for items over the capacity, which are cut first.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.pieces import CHARS_PER_UNIT, split_text
from textloom.operators.grouped import Columns, map_groups
from textloom.tables import cut_lineage

CAPACITY = 2000
#: Items of a part, and parts merged to one. A bin this full is not handed on.
PART, FAN, FULL = 1024, 8, 0.985

_BIN = "grp string, part long, bin string, size long, carried long, items array<struct<item_key:bigint,piece_no:int,size:bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of the numbers of ``sizes``, packed largest first into the fullest bin that has room; ties go to the first."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        bisect.insort(room, (free - s, b))
    return bins


def kept(rounds: int) -> int:
    """How many bins a part hands on that has so many rounds above it: one may be half empty, the others may take one in."""
    return 1 + (FAN - 1) * rounds if rounds else 0


def _pack(capacity: int, rounds: int) -> Callable[[tuple, Columns], list[tuple]]:
    def run(key: tuple, rows: Columns) -> list[tuple]:
        sizes, carried, names, items = rows["size"], rows["carried"], rows["bin"], rows["items"]
        made = [(sum(sizes[i] for i in b), sum(carried[i] for i in b), names[min(b)], [x for i in b for x in items[i]]) for b in best_fit(sizes, capacity)]
        emptiest = {k for _, k in heapq.nsmallest(kept(rounds), [(m[0], k) for k, m in enumerate(made)])}
        return [(key[0], key[1] if k in emptiest and m[0] < FULL * capacity else -1, m[2], m[0], m[1], m[3]) for k, m in enumerate(made)]

    return run


def cut_to_capacity(df: DataFrame, key: str, group: str, text: str, carried: str, capacity: int = CAPACITY, chars_per_unit: int = CHARS_PER_UNIT) -> DataFrame:
    """``grp, item_key, piece_no, size, carried``: the items of ``df``, those over the capacity cut at natural boundaries.

    Sizes are units of ``chars_per_unit`` characters, rounded down; a null text has size 0. ``carried`` (null: 0) is a
    number that comes along, with the first piece of a cut item. A null group is a group of its own; rows without
    a key are left out.
    """
    size = F.coalesce(F.floor(F.length(text) / F.lit(chars_per_unit)), F.lit(0)).cast("long")
    base = df.where(F.col(key).isNotNull()).select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(key).cast("long").alias("item_key"), size.alias("size"), F.coalesce(F.col(carried).cast("long"), F.lit(0)).alias("carried"), F.col(text).alias("t"))
    whole = base.where(F.col("size") <= capacity).select("grp", "item_key", F.lit(1).alias("piece_no"), "size", "carried")
    most = (capacity + 1) * chars_per_unit - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[Any] = []
            for g, k, c, t in zip(b["grp"], b["item_key"], b["carried"], b["t"], strict=True):
                for n, (begin, _, end) in enumerate(split_text(t, most, 0), 1):
                    rows.append((g, k, n, (end - begin) // chars_per_unit, c if n == 1 else 0))
            yield pd.DataFrame(rows, columns=["grp", "item_key", "piece_no", "size", "carried"])

    return whole.unionByName(base.where(F.col("size") > capacity).select("grp", "item_key", "carried", "t").mapInPandas(run, "grp string, item_key long, piece_no int, size long, carried long"))


def _deal(named: DataFrame) -> DataFrame:
    """``named`` with ``part``: the place of an item among its group's, largest first, dealt out to the parts in turn.

    Places are counted in blocks that a hash makes, as large as parts: within a block, then over the blocks for each size,
    then over the sizes, of which there are no more than the capacity. So no task holds a whole group, or all of one size.
    """
    own = Window.partitionBy("grp", "block", "size").orderBy("bin")
    placed = cut_lineage(named.withColumn("place", F.row_number().over(own) - 1))
    held = placed.groupBy("grp", "size", "block").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("grp", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    larger = Window.partitionBy("grp").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    begun = held.groupBy("grp", "size").agg(F.sum("m").alias("k")).withColumn("begun", F.coalesce(F.sum("k").over(larger), F.lit(0)))
    at = held.join(begun, ["grp", "size"]).select("grp", "size", "block", (F.col("begun") + F.col("before")).alias("at"))
    return placed.join(at, ["grp", "size", "block"]).withColumn("part", F.pmod(F.col("at") + F.col("place"), F.col("parts")))


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART, seed: int = 1) -> DataFrame:
    """``grp, bin, size, carried, items``: the bins of each group of ``items`` (``grp, item_key, piece_no, size, carried``).

    No bin exceeds ``capacity``, and every item is in exactly one bin, those of size 0 too. Which bin an item comes into
    depends on the data and ``seed`` alone. An empty table gives no bin. Rows that repeat a key are separate items.
    """
    items = cut_lineage(items)
    counts = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(part)).cast("long")
    most = counts.agg(F.max(parts)).first()[0] or 0  # one number: parts of the largest group
    rounds = 0
    while FAN**rounds < most:
        rounds += 1
    name = F.concat_ws("/", F.lpad(F.col("item_key").cast("string"), 20, "0"), F.lpad(F.col("piece_no").cast("string"), 6, "0"))
    named = items.join(counts.select("grp", parts.alias("parts")), "grp").withColumn("bin", name).withColumn("block", F.pmod(F.xxhash64("item_key", "piece_no", F.lit(seed)), F.col("parts")))
    dealt = (_deal(named) if rounds else named.withColumn("part", F.lit(0).cast("long"))).select("grp", "part", "bin", "size", "carried", F.array(F.struct("item_key", "piece_no", "size")).alias("items"))
    done: DataFrame | None = None
    while most:
        last = rounds == 0
        packed = map_groups(dealt, ["grp", "part"], ["bin"], _pack(capacity, rounds), _BIN)
        if not last:
            packed = cut_lineage(packed)
        final = packed.where("part < 0").drop("part")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        dealt = packed.where("part >= 0").withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        rounds -= 1
    return done if done is not None else items.limit(0).select("grp", F.lit("").alias("bin"), "size", "carried", F.array(F.struct("item_key", "piece_no", "size")).alias("items"))
