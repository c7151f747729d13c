"""Rows kept per file, replaced as files change: runs of rows, and a log that says which run holds a file's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "path string, version bigint, run string, batch bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def put(store: str, number: int, changed: DataFrame, rows: DataFrame) -> None:
    """Replace the rows of the ``changed(path)`` files by ``rows(path, ...)``, as batch ``number``; a file without new rows keeps none.

    The rows of an attempt go to a run of their own. The log entry, written after them, makes them count, all at once: readers never see half a
    batch, and an attempt that fails leaves the old state. A batch whose entry is there is done, so a replay changes nothing. Rows of
    files outside ``changed`` are left out. Batches count upwards. ``changed`` may have a ``version``, a long that the log keeps; of repeated paths the highest.
    """
    spark, entry, run = changed.sparkSession, f"{store}/log/batch={number}", uuid.uuid4().hex
    if _exists(spark, f"{entry}/_SUCCESS"):
        return
    version = F.max("version") if "version" in changed.columns else F.max(F.lit(None))
    files = changed.filter("path IS NOT NULL").groupBy("path").agg(version.cast("long").alias("version"))
    rows.join(files, "path", "left_semi").write.parquet(f"{store}/rows/run={run}")
    files.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(entry)


def get(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of every file's latest batch; ``schema`` is that of the rows put, also for a store without any."""
    if not _exists(spark, f"{store}/log"):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(LOG).parquet(f"{store}/log")
    latest = log.groupBy("path").agg(F.max_by("run", "batch").alias("run"))
    rows = spark.read.schema(StructType([*schema.fields]).add("run", "string")).parquet(f"{store}/rows")
    return rows.join(latest, ["path", "run"]).select(*schema.names)


def versions(spark: SparkSession, store: str) -> DataFrame:
    """``(path, version)`` of every file's latest batch; files put without a version aren't there."""
    if not _exists(spark, f"{store}/log"):
        return spark.createDataFrame([], "path string, version bigint")
    log = spark.read.schema(LOG).parquet(f"{store}/log")
    return log.groupBy("path").agg(F.max_by("version", "batch").alias("version")).filter("version IS NOT NULL")


def compact(spark: SparkSession, store: str, into: str, schema: StructType) -> None:
    """The present state of a store as the first batch of a new one, so that old runs can go."""
    log = spark.read.schema(LOG).parquet(f"{store}/log")
    files = log.groupBy("path").agg(F.max_by("version", "batch").alias("version"))
    put(into, 0, files, get(spark, store, schema))
