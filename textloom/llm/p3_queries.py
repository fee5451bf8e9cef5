"""Problem 3: gathering the texts of a book's tasks into requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.packing import CAPACITY, cut_to_capacity, pack
from textloom.tables import table


def p3_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each request: its tasks (with the pieces of a cut one), its units and the sum of chapter_count.

    A task is a row of the table; a retry is another task. A null text takes no room and still is in a request.
    """
    tasks = table(spark, sf_dir, "tasks", "task_key", "book_id", "text_to_translate", "chapter_count")
    return _requests(pack(cut_to_capacity(tasks, "task_key", "book_id", "text_to_translate", "chapter_count"), CAPACITY))


def p3_shared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all tasks of the table in one group."""
    tasks = table(spark, sf_dir, "tasks", "task_key", "text_to_translate", "chapter_count").withColumn("one", F.lit(0))
    return _requests(pack(cut_to_capacity(tasks, "task_key", "one", "text_to_translate", "chapter_count"), CAPACITY)).drop("book_id")


def _requests(bins: DataFrame) -> DataFrame:
    return bins.select(
        F.expr("try_cast(substring(grp, 2) AS bigint)").alias("book_id"),
        F.col("bin").alias("request_id"),
        F.array_sort(F.transform("items", lambda x: F.struct(x["item_key"].alias("task_key"), x["piece_no"].alias("piece_no"), x["size"].alias("units")))).alias("tasks"),
        F.size("items").alias("n_tasks"),
        F.col("size").alias("units"),
        F.col("carried").alias("chapter_count"),
    )


def p3_book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requests of each book hold in all, for a check against the tasks: none is lost, none is there twice."""
    requests = p3_requests(spark, sf_dir).select("book_id", "units", "chapter_count", "tasks")
    return requests.groupBy("book_id").agg(
        F.sum(F.size(F.filter("tasks", lambda x: x["piece_no"] == 1))).alias("tasks"),
        F.sum("chapter_count").alias("chapter_count"),
        F.sum(F.aggregate(F.filter("tasks", lambda x: x["units"] <= 0), F.lit(0).cast("long"), lambda a, x: a + 1)).alias("weightless"),
        F.count_if(F.col("units") > CAPACITY).alias("overfull"),
    )


SQL = {
    "p3_book_totals": """
SELECT book_id, count(*) AS tasks, CAST(sum(coalesce(chapter_count, 0)) AS BIGINT) AS chapter_count, count(*) FILTER (WHERE coalesce(length(text_to_translate), 0) < 3) AS weightless, CAST(0 AS BIGINT) AS overfull
FROM tasks GROUP BY book_id"""
}
QUERIES = {f.__name__: f for f in (p3_requests, p3_shared_requests, p3_book_totals)}
