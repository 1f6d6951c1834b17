"""Intermediate tables in the folder that the cluster shares.

Iterative jobs cut their lineage by writing a table and reading it back.  The folder is the one that
``spark.checkpoint.dir`` names; only where that is unset (tests, a laptop) a folder of its own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, visible to the driver and to every executor."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


ROWS_PER_TASK = 50_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The frame in no more tasks than narrow rows of this number need; a large one stays as it is dealt."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


class Scratch:
    """Tables of one run: ``keep`` writes a frame and reads it back, ``drop`` deletes one that was superseded."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{name}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
