"""Document edits: latest buffers, rejected updates, sessions and queues, as batch queries and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.sources import store


def latest_buffers(edits: DataFrame) -> DataFrame:
    """The highest version of each document; works on a batch, and on a stream in complete or update mode."""
    return edits.groupBy("path").agg(F.max("version").alias("version"), F.max_by("kind", "version").alias("kind"), F.max_by("value", "version").alias("value"))


def rejected(edits: DataFrame) -> DataFrame:
    """Edits that arrive (by time) after one with a higher version."""
    w = W.partitionBy("path").orderBy("ts", "version").rowsBetween(W.unboundedPreceding, -1)
    return edits.withColumn("seen", F.max("version").over(w)).filter("version < seen")


def lifecycle(edits: DataFrame) -> DataFrame:
    """Opens of open files and closes of closed ones: ``(path, version, kind, previous)``."""
    own = edits.filter(F.col("kind").isin("open", "close"))
    out = own.withColumn("previous", F.lag("kind").over(W.partitionBy("path").orderBy("version")))
    return out.filter((F.col("kind") == F.col("previous")) | (F.col("previous").isNull() & (F.col("kind") == "close")))


def debounce(edits: DataFrame, seconds: int) -> DataFrame:
    """Sessions of a file's edits with no gap over ``seconds``: ``(path, started, ended, n)``."""
    w = W.partitionBy("path").orderBy("ts", "version")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = edits.withColumn("new", F.coalesce((gap > seconds * 1_000_000).cast("long"), F.lit(1)))
    marked = marked.withColumn("session", F.sum("new").over(w))
    return marked.groupBy("path", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def debounce_stream(edits: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: session windows behind a watermark. ``ts`` is cast to a zoned timestamp, as watermarks ask."""
    own = edits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("path", F.session_window("ts", f"{seconds} seconds").alias("session")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def queue(sessions: DataFrame) -> DataFrame:
    """One pending entry per file, by its last request: high priority first, then newest."""
    last = sessions.groupBy("path").agg(F.max(F.struct("priority", "ts", "version")).alias("x"))
    return last.select("path", "x.priority", "x.ts", "x.version")


def recheck_on_save(edits: DataFrame, users: DataFrame) -> DataFrame:
    """Files to check again after saves: the saved ones and their users. ``users(used, user)`` may be a static table of a stream."""
    saved = edits.filter("kind = 'save'").select("path").distinct()
    return saved.union(saved.join(users, F.col("path") == F.col("used")).select(F.col("user").alias("path"))).distinct()


STATE = "version long, open boolean"
VERDICTS = "path string, version long, kind string, verdict string"


def verdicts_stream(edits: DataFrame) -> DataFrame:
    """``(path, version, kind, verdict)`` of each edit on a stream: the document's highest version and whether it is
    open are the state. ``late``: a lower version than seen. ``duplicate-open``, ``not-open``: by the life
    cycle. Else ``accepted``. A close frees the document, its version stays known.

    Within a micro-batch a document's edits go by ``(ts, version)``; only one document's new edits are in
    memory at a time, as Arrow batches.
    """
    import pandas as pd

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["ts", "version"])
        seen, is_open = state.get if state.exists else (None, False)
        out = []
        for v, kind in zip(rows["version"].tolist(), rows["kind"]):
            if seen is not None and v < seen:
                verdict = "late"
            elif kind == "open" and is_open:
                verdict = "duplicate-open"
            elif kind == "close" and not is_open:
                verdict = "not-open"
            else:
                verdict = "accepted"
                is_open = kind == "open" or (is_open and kind != "close")
            seen = v if seen is None else max(seen, v)
            out.append((key[0], v, kind, verdict))
        state.update((seen, is_open))
        yield pd.DataFrame(out, columns=["path", "version", "kind", "verdict"])

    return edits.groupBy("path").applyInPandasWithState(run, VERDICTS, STATE, "append", "NoTimeout")


def run_all(stream: DataFrame, table: str | None, checkpoint: str, each=None) -> DataFrame:
    """Process all that a stream has now into ``table`` and read it, or by ``each(batch, number)``."""
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", table).outputMode("append")
    w.start().awaitTermination()
    return stream if each else stream.sparkSession.read.parquet(table)


def publish(batch: DataFrame, number: int, table: str, check) -> None:
    """A micro-batch's diagnostics, ``check(batch)``, replacing those of its files only; for ``foreachBatch``. A file found clean loses its rows;
    ``store.get`` reads the table."""
    store.put(table, number, batch.select("path"), check(batch))
