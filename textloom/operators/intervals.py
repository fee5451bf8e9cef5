"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Two levels keep one huge entity from becoming one huge task.

1. Time is cut into shards of ``shard_ms``. An interval is clipped into the shard it begins in and the one it ends in;
   whole shards between the two stay one coarse interval, so an interval of any length gives three pieces at most.
   Pieces with the same entity, shard and start are first reduced to the longest (a map-side combine), so a shard holds
   ``shard_ms`` rows at most, however many rows its entity has.
2. Each shard merges its own pieces by a running maximum and leaves one row: its first start, its last end, and the gaps
   inside it, of which there can be no more than ``shard_ms / min_gap_ms``. Stitching then reads one row for each shard
   that holds anything: the running maximum of ends over the shards before says where coverage touches or breaks off.

Everything is built from Spark's own expressions; nothing is collected, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 600_000
MIN_GAP_MS = 500
#: The most gaps that a block of an entity's time can hold, for numbering periods.
BLOCK_GAPS = 8192


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds; null for null, NaN, infinity and what a long can't hold."""
    fits = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e14))
    return F.when(fits, F.bround(seconds * 1000.0, 0).cast("long"))


def interval_bounds(df: DataFrame, entity: str, start: str, end: str, duration: str | None = None) -> DataFrame:
    """``entity, a, b``: the rows of ``df`` as intervals in whole milliseconds.

    A null ``end`` is replaced by ``start + duration``. A row has no interval if its entity or start is null, if it has
    no end, or if its end isn't after its start. Other columns, whatever their names, are ignored.
    """
    last = F.col(end) if duration is None else F.coalesce(F.col(end), F.col(start) + F.col(duration))
    return df.select(F.col(entity).alias("entity"), milliseconds(F.col(start)).alias("a"), milliseconds(last).alias("b")).where(F.col("entity").isNotNull() & (F.col("b") > F.col("a")))


def _shards(bounds: DataFrame, min_gap_ms: int, shard_ms: int) -> DataFrame:
    """``entity, first, last, inner``: one row for each shard (or run of whole shards) with what it covers.

    ``inner`` holds its own gaps as ``{g, h}``.
    """
    w = F.lit(shard_ms).cast("long")
    lo, hi = F.floor(F.col("a") / w), F.floor((F.col("b") - 1) / w)

    def piece(coarse: bool, shard: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(coarse).alias("coarse"), shard.alias("shard"), a.alias("a"), b.alias("b"))

    pieces = F.when(lo == hi, F.array(piece(False, lo, F.col("a"), F.col("b")))).otherwise(
        F.filter(F.array(piece(False, lo, F.col("a"), (lo + 1) * w), piece(False, hi, hi * w, F.col("b")), piece(True, lo, (lo + 1) * w, hi * w)), lambda x: x["b"] > x["a"])
    )
    own = ["entity", "coarse", "shard"]
    longest = bounds.select("entity", F.explode(pieces).alias("p")).select("entity", "p.*").groupBy(*own, "a").agg(F.max("b").alias("b"))
    reach = F.max("b").over(Window.partitionBy(*own).orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    return (
        longest.withColumn("g", F.when(F.col("a") - reach > min_gap_ms, reach))
        .groupBy(*own)
        .agg(F.min("a").alias("first"), F.max("b").alias("last"), F.collect_list(F.when(F.col("g").isNotNull(), F.struct(F.col("g"), F.col("a").alias("h")))).alias("inner"))
        .drop("coarse", "shard")
    )


def interval_gaps(bounds: DataFrame, min_gap_ms: int = MIN_GAP_MS, shard_ms: int = SHARD_MS) -> DataFrame:
    """``entity, gap_start_ms, gap_end_ms``: every stretch between two intervals of an entity that none of its intervals
    covers and that is longer than ``min_gap_ms``. ``bounds`` is what :func:`interval_bounds` gives.

    Intervals that touch, nest or repeat leave no gap; an entity with one interval has none; an empty table gives no row.
    """
    before = Window.partitionBy("entity").orderBy("first", F.desc("last"), F.size("inner")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(before)
    # A gap inside a shard that an earlier coarse interval covers is no gap: what the shards before reach lies beyond it.
    stitched = _shards(bounds, min_gap_ms, shard_ms).withColumn("reach", reach)
    joint = F.when(F.col("first") - F.col("reach") > min_gap_ms, F.array(F.struct(F.col("reach").alias("g"), F.col("first").alias("h"))))
    own = F.filter("inner", lambda x: F.col("reach").isNull() | (x["g"] >= F.col("reach")))
    none = F.array().cast("array<struct<g:bigint,h:bigint>>")
    return stitched.select("entity", F.explode(F.concat(F.coalesce(joint, none), own)).alias("x")).select("entity", F.col("x.g").alias("gap_start_ms"), F.col("x.h").alias("gap_end_ms"))


def interval_periods(bounds: DataFrame, min_gap_ms: int = MIN_GAP_MS, shard_ms: int = SHARD_MS) -> DataFrame:
    """``entity, period_no, period_start_ms, period_end_ms``: the continuous periods of each entity, numbered from 1.

    Periods are what lies between the gaps of :func:`interval_gaps`, so a stretch of up to ``min_gap_ms`` that nothing
    covers doesn't end a period. One entity with intervals has at least one period.
    """
    gaps = interval_gaps(bounds, min_gap_ms, shard_ms)
    # Gaps are disjoint and longer than ``min_gap_ms``, so a block of time holds a bounded number of them.
    width = BLOCK_GAPS * max(min_gap_ms, 1)
    ends = bounds.groupBy("entity").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = gaps.select("entity", F.col("gap_start_ms").alias("stop"), F.col("gap_end_ms").alias("go")).unionByName(ends.select("entity", F.col("b").alias("stop"), F.lit(None).cast("long").alias("go")))
    cuts = cuts.withColumn("block", F.floor(F.col("stop") / width))
    own = Window.partitionBy("entity", "block").orderBy("stop")
    begun = cuts.withColumns({"prev": F.lag("go").over(own), "n": F.row_number().over(own)})
    # One row for each block that holds a cut carries the number of periods and the start of the next one on.
    over = Window.partitionBy("entity").orderBy("block")
    blocks = cuts.groupBy("entity", "block").agg(F.count(F.lit(1)).alias("m"), F.max_by("go", "stop").alias("last"))
    blocks = blocks.select("entity", "block", F.coalesce(F.sum("m").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(over).alias("left"))
    first = ends.select("entity", F.col("a").alias("first"))
    joined = begun.join(blocks, ["entity", "block"]).join(first, "entity")
    start = F.coalesce("prev", F.when(F.col("n") == 1, F.col("left")), "first")
    return joined.select("entity", (F.col("before") + F.col("n")).cast("int").alias("period_no"), start.alias("period_start_ms"), F.col("stop").alias("period_end_ms"))
