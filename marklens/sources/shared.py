"""Where intermediate tables and written files go: the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none and runs on one machine (tests) is one made here."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; it is removed when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written and read back. Unlike Spark's own checkpoint, the result has the size of its files, not an estimate that
    grows with every join before it, so loops plan by what is there."""
    return write_table(df, "checkpoint")


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``checkpoint`` in buckets by the keys, as many as a shuffle has partitions, so that a join by all of them moves only the other side."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "buckets")
    jvm, name = spark.sparkContext._jvm, "marklens_" + uuid.uuid4().hex
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


class Grown:
    """Rows that come in rounds, in buckets by the keys: what is there stays as written, only what comes moves, and ``latest`` reads no more than the last round."""

    def __init__(self, spark: SparkSession, *keys: str):
        self.spark, self.keys, self.path, self.name, self.rounds = spark, keys, new_path(spark, "grown"), "marklens_" + uuid.uuid4().hex, 0
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)

    def add(self, df: DataFrame) -> None:
        self.rounds += 1
        out = df.withColumn("round", F.lit(self.rounds)).write.mode("append").partitionBy("round")
        out.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *self.keys).sortBy(*self.keys).option("compression", "zstd").option("path", self.path).saveAsTable(self.name)

    def all(self) -> DataFrame:
        return self.spark.table(self.name).drop("round")

    def latest(self) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("round") == self.rounds).drop("round")
