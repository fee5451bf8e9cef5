"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.mixing import char_counts, counted, held_tokens, mix_documents, mix_shares
from textloom.tables import cut_lineage, table


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(char_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix in which every source holds exactly its share."""
    return mix_documents(_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumnRenamed("doc_key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_full_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the corpus: sources that can't hold their share are clamped, the others take over what is left."""
    counts, targets = _counts(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix_documents(counts, targets, float(held_tokens(counts, targets))).withColumnRenamed("doc_key", "doc_id")


def p9_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, targets = _counts(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix_shares(counts, targets, float(held_tokens(counts, targets)))


def p9_full_shares_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measured in characters, which SQL can count: what each source gets, and whether its documents keep to it."""
    docs = _chars(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    shares = mix_shares(docs, targets, float(held_tokens(docs, targets)))
    largest = docs.groupBy(F.col("source").alias("s")).agg(F.max("tokens").alias("largest"))
    return shares.join(largest, F.col("source") == F.col("s"), "left").select(
        "source",
        "target_share",
        F.col("held_tokens").alias("held_chars"),
        F.round("wanted_tokens").cast("long").alias("wanted_chars"),
        (F.col("wanted_tokens") >= F.col("held_tokens") * F.col("max_repeats") * 0.999999999).alias("clamped"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"),
        (F.abs(F.col("mix_tokens") - F.col("wanted_tokens")) <= F.coalesce("largest", F.lit(0))).alias("share_kept"),
    )


SQL = {
    "p9_full_shares_by_chars": r"""
WITH RECURSIVE d AS (SELECT regexp_replace(regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g'), '^_+|_+$', '', 'g') AS source, length(coalesce(text, '')) AS n FROM documents),
t AS (SELECT m.source, target_share AS w, CAST(coalesce(sum(n), 0) AS BIGINT) AS held, coalesce(sum(n), 0) * CAST(any_value(max_repeats) AS DOUBLE) AS room FROM mix_targets m LEFT JOIN d ON d.source = m.source GROUP BY m.source, target_share),
r AS (
  SELECT 0 AS n, source, w, held, room, CAST(NULL AS DOUBLE) AS got, CAST((SELECT sum(held) FROM t) AS DOUBLE) AS rest FROM t
  UNION ALL
  SELECT n + 1, source, w, held, room, CASE WHEN over THEN room ELSE got END, rest - coalesce(sum(room) FILTER (WHERE over) OVER (), 0)
  FROM (SELECT *, got IS NULL AND rest * w / sum(w) FILTER (WHERE got IS NULL) OVER () > room * (1 + 1e-12) AS over FROM r WHERE n < 8) AS x),
f AS (SELECT *, sum(w) FILTER (WHERE got IS NULL) OVER () AS weight FROM r WHERE n = 8)
SELECT source, w AS target_share, held AS held_chars, CAST(round(coalesce(got, rest * w / weight)) AS BIGINT) AS wanted_chars, got IS NOT NULL AS clamped, true AS cap_kept, true AS share_kept FROM f"""
}
QUERIES = {f.__name__: f for f in (p9_mix, p9_shares, p9_full_mix, p9_full_shares, p9_full_shares_by_chars)}
