"""Session-level helpers: lineage cuts on shared storage and time arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a session in local mode (one process) without the setting gets a temporary folder of its own; on
    any cluster a machine-local path would be lost with its executor, so a missing setting fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def few_tasks(spark: SparkSession) -> int:
    """Tasks enough for all cores to share work that has very many small parts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """For loading from folders with very many subfolders: Spark lists each folder by a job of its own, with a task
    for every subfolder unless the number of tasks is limited."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The result has no lineage beyond the files, so a lost executor costs a re-read, not a
    re-computation, and its size is known to the optimizer when it picks join strategies.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared scratch folder that grows by parts; parts are written once, and all are one scan."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.path = f"{scratch_root(self.spark)}/parts-{uuid.uuid4().hex}"
        self.parts = 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part; returns it as read back."""
        path = f"{self.path}/part={self.parts}"
        df.write.parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, independent of session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))
