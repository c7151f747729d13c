"""Sources and incremental ingest: scanning, guards, overlays, snapshot diffs, staleness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared, store


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mtime, size, text)`` of all ``.tex`` files under a ``source`` folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").load(root)
    own = raw.filter(F.col("path").contains("/source/")).dropDuplicates(["path"])
    return own.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def glob_to_regex(glob: Column) -> Column:
    """``*`` and ``?`` within a path part, ``**`` across parts."""
    out = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/?", "\u0001")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(out, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def ignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths that a pattern ignores, themselves or by an ancestor, and that no ``!`` pattern takes back.

    ``patterns(line)`` is a project file of a few lines: it becomes one array column, not a join per path.
    """
    rules = patterns.filter("line <> '' AND line NOT LIKE '#%'").select(F.col("line").startswith("!").alias("keep"), glob_to_regex(F.regexp_replace("line", "^!", "")).alias("re"))
    rules = rules.agg(F.collect_list(F.when(~F.col("keep"), F.col("re"))).alias("drop"), F.collect_list(F.when(F.col("keep"), F.col("re"))).alias("back"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = lambda c: F.exists(c, lambda r: F.exists(up, lambda p: F.rlike(p, r)))
    return paths.join(F.broadcast(rules), F.lit(True)).filter(hit("drop") & ~hit("back")).select(paths.columns)


def path_columns(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.select(
        "*", F.regexp_extract(p, r"^(.*/source)/", 1).alias("source_dir"), F.regexp_extract(p, r"([^/]+)/source/", 1).alias("repository"),
        F.regexp_extract(p, r"/source/(.*)\.tex$", 1).alias("rel"), F.regexp_extract(p, r"\.([a-z]{2})\.tex$", 1).alias("file_lang"), F.regexp_extract(p, r"([^/.]+)[^/]*\.tex$", 1).alias("stem"),
    )


def within_size(files: DataFrame, limit_kb: int) -> DataFrame:
    """Files of at most ``limit_kb`` whole KB; 0: no limit."""
    return files if not limit_kb else files.filter(F.floor(F.col("size") / 1024) <= limit_kb)


def first_files(files: DataFrame, n: int) -> DataFrame:
    return files if n < 0 else files.orderBy("path").limit(n)


def newest_first(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "path").limit(n)


def overlay(files: DataFrame, buffers: DataFrame) -> DataFrame:
    """Open buffers win over what is on disk, text and time."""
    b = buffers.select("path", F.col("text").alias("b_text"), F.col("ts").alias("b_ts"))
    out = files.join(b, "path", "left")
    return out.select("path", F.coalesce("b_text", "text").alias("text"), F.coalesce("b_ts", "mtime").alias("mtime"), F.col("b_ts").isNotNull().alias("open"))


def snapshot_diff(old: DataFrame, new: DataFrame, include: str | None = None, ignore: str | None = None) -> DataFrame:
    """``(path, change)``: created, modified or deleted, of paths that match ``include`` and don't match ``ignore`` (patterns found anywhere in them)."""
    watched = (F.lit(True) if include is None else F.col("path").rlike(include)) & (F.lit(True) if ignore is None else ~F.col("path").rlike(ignore))
    o, n = old.filter(watched).select("path", F.col("mtime").alias("o")), new.filter(watched).select("path", F.col("mtime").alias("n"))
    change = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def stale(files: DataFrame, builds: DataFrame) -> DataFrame:
    """Files never built, or built before they changed."""
    return files.join(builds.select("path", "built_at"), "path", "left").filter(F.col("built_at").isNull() | (F.col("built_at") < F.col("mtime")))


def build_or_reuse(files: DataFrame, builds: DataFrame, now: Column) -> DataFrame:
    """The build log after rebuilding what is stale: ``(path, built_at, rebuilt)``."""
    own = files.join(builds.select("path", "built_at"), "path", "left")
    old = F.coalesce(F.col("built_at") < F.col("mtime"), F.lit(True))
    return own.select("path", F.when(old, now).otherwise(F.col("built_at")).alias("built_at"), old.alias("rebuilt"))


def rebuild(files: DataFrame, folder: str, number: int, build: Callable[[DataFrame], DataFrame], schema: StructType) -> DataFrame:
    """The artifacts of ``files(path, mtime, ...)`` in the store ``folder``, brought up to date as batch ``number``.

    ``build(stale)`` gives ``(path, ...)`` rows of ``schema`` and gets only files that were never built or changed since; the others' rows
    stay as written. Files that are gone lose theirs. A build that fails leaves the old state, the same number again does nothing. Files without a time
    count as stale, files without a path don't count; of repeated paths all rows are built if one is newer.
    """
    spark = files.sparkSession
    own = files.filter("path IS NOT NULL").withColumn("version", F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(0)))
    built = store.versions(spark, folder).withColumnRenamed("version", "__built")
    newest = own.groupBy("path").agg(F.max("version").alias("version"), F.bool_or(F.col("mtime").isNull()).alias("timeless")).join(built, "path", "full_outer")
    changes = newest.filter("timeless OR __built IS NULL OR version IS NULL OR version > __built").select("path", "version")
    changes = shared.checkpoint(changes)
    stale = files.join(changes.filter("version IS NOT NULL").select("path"), "path", "left_semi")
    store.put(folder, number, changes, build(stale))
    return store.get(spark, folder, schema)


def relink(linked: DataFrame, related: DataFrame, builds: DataFrame) -> DataFrame:
    """Linked results older than the newest build among their related files."""
    newest = related.join(builds.select(F.col("path").alias("related"), "built_at"), "related").groupBy("path").agg(F.max("built_at").alias("newest"))
    return older(linked, newest)


def older(linked: DataFrame, newest: DataFrame) -> DataFrame:
    """Linked results older than ``newest(path, newest)`` of their file."""
    return linked.join(newest, "path").filter("newest > linked_at")


def version_gate(artifacts: DataFrame, expected: str) -> DataFrame:
    """Artifacts to throw away: all of them if any is older than the expected version or has no readable one, else none."""
    parse = lambda c: F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    v = parse(F.col("version"))
    bad = F.col("version").isNull() | F.exists(v, lambda x: x.isNull()) | F.coalesce(v < parse(F.lit(expected)), F.lit(True))
    any_bad = artifacts.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("__bad"))  # one row
    return artifacts.join(F.broadcast(any_bad), F.lit(True)).filter("__bad").drop("__bad")


def sentences(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Token-per-line text: a blank line ends a sentence, and what no blank line ends is dropped."""
    w = W.partitionBy(group).orderBy(order)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    out = lines.select("*", blank.alias("blank"), F.coalesce(F.sum(blank.cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("sentence"), F.sum(blank.cast("long")).over(W.partitionBy(group)).alias("ends"))
    out = out.filter(~F.col("blank") & (F.col("sentence") < F.col("ends")))
    return out.groupBy(group, "sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("tokens"))


def embeddings_text(spark: SparkSession, path: str, size: int, first: int | None = None) -> DataFrame:
    """``(token, vec)`` from lines of a word and its numbers, or of the ``first`` of them in order of the files."""
    parts = F.split("value", " ")
    out = spark.read.text(path).filter(F.size(parts) == size + 1)
    out = out.orderBy(F.monotonically_increasing_id()).limit(first) if first else out
    return out.select(F.get(parts, F.lit(0)).alias("token"), F.slice(parts, 2, size).cast("array<float>").alias("vec"))


def report(diagnostics: DataFrame, path: str) -> None:
    """Write one line per diagnostic of ``checks.formatted`` as text files."""
    diagnostics.select("line").write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; where there is none yet, ``build()`` is written there first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
