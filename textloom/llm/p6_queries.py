"""Problem 6: splitting oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.pieces import split_items
from textloom.tables import table


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = split_items(table(spark, sf_dir, "tasks", "task_key", "text_to_translate"), "task_key", "text_to_translate")
    chapters = split_items(table(spark, sf_dir, "chapters", "chapter_key", "content"), "chapter_key", "content")
    return tasks.withColumn("item_kind", F.lit("task")).unionByName(chapters.withColumn("item_kind", F.lit("chapter")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece_no = 2").select("item_kind", "item_key")


def p6_piece_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each item hold in all: every character once, none over the limit, repeats within the overlap."""
    pieces = p6_pieces(spark, sf_dir)
    return pieces.groupBy("item_kind", "item_key").agg(
        F.sum(F.col("end_char") - F.col("new_char")).cast("long").alias("chars"),
        F.min("begin_char").cast("long").alias("begins"),
        F.max("end_char").cast("long").alias("ends"),
        (F.count(F.lit(1)) == F.max("pieces")).alias("complete"),
        F.every(F.floor(F.length("piece") / 3) <= 2000).alias("within_limit"),
        F.every((F.col("new_char") - F.col("begin_char")).between(0, 150)).alias("within_overlap"),
    )


QUERIES = {f.__name__: f for f in (p6_found, p6_pieces, p6_piece_totals)}
_OVERSIZE = """
SELECT '{kind}' AS item_kind, {key} AS item_key, CAST(length({text}) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS begins, CAST(length({text}) AS BIGINT) AS ends, true AS complete, true AS within_limit, true AS within_overlap
FROM {table} WHERE length({text}) // 3 > 2000"""
SQL = {
    "p6_found": """
SELECT 'task' AS item_kind, task_key AS item_key FROM tasks WHERE length(text_to_translate) // 3 > 2000
UNION ALL SELECT 'chapter', chapter_key FROM chapters WHERE length(content) // 3 > 2000""",
    "p6_piece_totals": _OVERSIZE.format(kind="task", key="task_key", text="text_to_translate", table="tasks") + " UNION ALL " + _OVERSIZE.format(kind="chapter", key="chapter_key", text="content", table="chapters"),
}
