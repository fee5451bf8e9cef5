"""Mixing sources to target shares of all tokens, with a cap on repeats.

Tokens are counted once, with a public tokenizer whose vocabulary file each Python worker loads. Capped water-filling
over the (few) sources then says how often each is gone through: sources are clamped at their maximum of epochs and what
they can't hold is shared out among the others in proportion, until nothing is over. A source gets its whole epochs from
each document and the fraction from a seeded order of its documents, cut where the tokens it still needs are reached:
buckets of the order are summed first, and only the documents of the one bucket the cut falls into are ranked.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import cut_lineage

#: Where the vocabulary files of the public tokenizers are, and which one counts.
TOKENIZER_DIR, TOKENIZER = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
SEED, BUCKETS = 7, 1 << 14

_ENCODINGS: dict[str, Any] = {}


def encoding(folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> Any:
    """The byte-level BPE of a file of ranks."""
    path = os.path.join(folder, name)
    if path not in _ENCODINGS:
        import tiktoken
        from public_tokenizers import PATTERN  # the pattern these vocabularies were made with

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def source_name(source: Column) -> Column:
    """One spelling for each source: lower case, words joined by underscores; null for null and blank."""
    plain = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.nullif(F.regexp_replace(plain, r"^_+|_+$", ""), F.lit(""))


def token_counts(df: DataFrame, key: str, text: str, source: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``doc_key, source, tokens``: the size of each document; a null or empty text has 0 tokens, a row without a
    key is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]
            yield pd.DataFrame({"doc_key": b["k"], "source": b["s"], "tokens": sizes})

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), source_name(F.col(source)).alias("s"), F.col(text).alias("t")).mapInPandas(run, "doc_key long, source string, tokens long")


def water_fill(targets: dict[str, float], held: dict[str, int], repeats: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens of each source in the mix.

    Without ``total`` the mix is the largest in which every source that has a share and tokens keeps exactly its share.
    With it, sources that would exceed their maximum are clamped and the others take the rest in proportion; the mix is
    smaller than ``total`` only if all are clamped. Sources without tokens get none.
    """
    open_, out = {s: t for s, t in targets.items() if t > 0 and held.get(s, 0) > 0}, {s: 0.0 for s in targets}
    room = {s: held[s] * max(0.0, repeats.get(s, 0)) for s in open_}
    open_ = {s: t for s, t in open_.items() if room[s] > 0}
    if not open_:
        return out
    if total is None:
        total = min(room[s] / t for s, t in open_.items()) * sum(open_.values())
    while open_:
        weight = sum(open_.values())
        over = {s for s, t in open_.items() if total * t / weight > room[s] * (1 + 1e-12)}
        if not over:
            out.update({s: total * t / weight for s, t in open_.items()})
            break
        for s in over:
            out[s] = room[s]
            total -= room[s]
            del open_[s]
    return out


def _allocate(counts: DataFrame, targets: DataFrame, total: float | None) -> list[tuple[str, float, float, int, float]]:
    """``source, target share, max repeats, tokens held, tokens in the mix``: one for each listed source."""
    listed = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0))).where(F.col("source").isNotNull())
    rows = [tuple(r) for r in listed.collect()]  # the stated mix, one row for each source
    names = [r[0] for r in rows]
    held = {r[0]: int(r[1]) for r in counts.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens")).collect()}
    share: dict[str, float] = {}
    caps: dict[str, float] = {}
    for s, t, m in rows:
        share[s], caps[s] = share.get(s, 0.0) + (t or 0.0), max(caps.get(s, 0.0), m)
    filled = water_fill(share, held, caps, total)
    return [(s, share[s], caps[s], held.get(s, 0), filled[s]) for s in share]


_PLAN = "source string, target_share double, max_repeats double, held long, wanted double"


def mix_documents(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_key, source, tokens, repeats``: how often each document is used; those not used are left out.

    ``counts`` is what :func:`token_counts` gives (materialised: it is read three times). Every document of a source is
    used the source's whole number of epochs; a seeded part of them once more, until the source has its tokens, to within
    one document. No document is used more than its source's maximum. Sources without a target aren't used.
    """
    spark = counts.sparkSession
    plan = spark.createDataFrame(_allocate(counts, targets, total), _PLAN)
    # One row for each source of the stated mix.
    epochs = F.coalesce(F.try_divide(F.col("wanted"), F.col("held")), F.lit(0.0))
    whole = F.least(F.floor(epochs + 1e-9), F.floor("max_repeats"))
    plan = F.broadcast(plan.select(F.col("source").alias("s"), whole.alias("whole"), F.greatest(F.col("wanted") - whole * F.col("held"), F.lit(0.0)).alias("rest"), (whole < F.floor("max_repeats")).alias("more")))
    order = F.xxhash64(F.lit(seed), "doc_key")
    placed = counts.join(plan, F.col("source") == F.col("s")).drop("s").withColumn("h", order).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket", "rest").agg(F.sum("tokens").alias("n"))  # at most ``buckets`` rows a source
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("begun"), "n", "rest")
    cut = F.broadcast(starts.where((F.col("begun") < F.col("rest")) & (F.col("begun") + F.col("n") >= F.col("rest"))).groupBy("source").agg(F.min("bucket").alias("cut_bucket"), F.min("begun").alias("begun")))  # one row a source
    joined = placed.join(cut, "source", "left")
    edge = joined.where("bucket = cut_bucket")
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("extra", (F.col("begun") + within + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    beyond = joined.where(~F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False)))
    beyond = beyond.withColumn("extra", F.when(F.col("rest") <= 0, 0).when(F.col("cut_bucket").isNull(), 1).otherwise((F.col("bucket") < F.col("cut_bucket")).cast("int")))
    used = edge.select("doc_key", "source", "tokens", "whole", "more", "extra").unionByName(beyond.select("doc_key", "source", "tokens", "whole", "more", "extra"))
    repeats = (F.col("whole") + F.when(F.col("more"), F.col("extra")).otherwise(0)).cast("long")
    return used.select("doc_key", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_shares(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``source, target_share, max_repeats, held_tokens, wanted_tokens, mix_tokens, documents, most_repeats, actual_share`` of
    each source of the mix; ``wanted_tokens`` is what water-filling gives it, and ``mix_tokens`` is that to within one document."""
    plan = counts.sparkSession.createDataFrame(_allocate(counts, targets, total), _PLAN)
    got = mix_documents(counts, targets, total, seed).groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most"))
    mix = F.coalesce("mix", F.lit(0))
    return plan.join(got, F.col("source") == F.col("s"), "left").select(
        "source", "target_share", "max_repeats", F.col("held").alias("held_tokens"), F.col("wanted").alias("wanted_tokens"), mix.alias("mix_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide(mix, F.sum(mix).over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("actual_share")
    )


def held_tokens(counts: DataFrame, targets: DataFrame) -> int:
    """All tokens of the sources that ``targets`` lists."""
    listed = targets.select(source_name(F.col("source")).alias("source")).distinct()  # one row for each source of the stated mix
    return counts.join(F.broadcast(listed), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0


def char_counts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """As :func:`token_counts`, with characters for tokens."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_key"), source_name(F.col(source)).alias("source"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("tokens"))


def counted(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """:func:`token_counts`, written once."""
    return cut_lineage(token_counts(df, key, text, source))
