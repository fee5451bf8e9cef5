"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; only ``columns`` of it, if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that ``spark.checkpoint.dir`` names, and read from there.

    The folder must be shared by all executors, so a lost executor costs no recomputation of what was written. Where the
    session names none, a temporary folder is set if the master is this process (tests, a laptop); on a cluster, whose
    executors couldn't read it, that is an error. Files are removed with their DataFrames where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, else with the folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with ``names`` (compared as Spark does, regardless of case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
