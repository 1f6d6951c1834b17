"""Readers of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned by the queries that follow."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that pass between Spark and Python at once.
TEXT_ROWS = 1024


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands no more than TEXT_ROWS rows to Python at once, so tasks hold little text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)
