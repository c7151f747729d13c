"""Rebuilds by version: only stale files are built, the rest stays as written, failures change nothing."""

import hashlib
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from marklens.sources import ingest, store

SCHEMA = StructType().add("path", StringType()).add("size", IntegerType()).add("batch", IntegerType())
T0 = datetime(2024, 1, 1)


def _files(spark, rows):
    return spark.createDataFrame([(p, None if m is None else T0 + timedelta(minutes=m), t) for p, m, t in rows], "path string, mtime timestamp_ntz, text string")


def _build(k, seen=None):
    def build(stale):
        if seen is not None:
            seen.extend(sorted(r.path for r in stale.collect()))
        return stale.select("path", F.length("text").alias("size"), F.lit(k).alias("batch"))

    return build


def _sums(folder):
    return {f: hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(folder, "rows").rglob("*.parquet")}


def test_only_stale_files_are_built(spark, tmp_path):
    folder, rows = str(tmp_path / "a"), lambda df: sorted(tuple(r) for r in df.collect())
    first = _files(spark, [("a", 0, "x"), ("b", 0, "xx"), ("c", 0, None), (None, 0, "y"), ("d", None, "dd")])
    assert rows(ingest.rebuild(first, folder, 0, _build(0), SCHEMA)) == [("a", 1, 0), ("b", 2, 0), ("c", None, 0), ("d", 2, 0)]
    old, seen = _sums(folder), []
    second = _files(spark, [("a", 0, "ignored: not newer"), ("b", 5, "xxxx"), ("e", 1, "e"), ("d", None, "d")])
    want = [("a", 1, 0), ("b", 4, 1), ("d", 1, 1), ("e", 1, 1)]
    assert rows(ingest.rebuild(second, folder, 1, _build(1, seen), SCHEMA)) == want
    assert seen == ["b", "d", "e"]  # c is gone, a fresh, d has no time to go by
    assert old.items() <= _sums(folder).items()  # what was written stays byte for byte
    assert rows(ingest.rebuild(second, folder, 1, _build(9), SCHEMA)) == want  # the same batch again
    # a file that was gone comes back with its old time
    assert rows(ingest.rebuild(_files(spark, [("c", 0, "ccc"), ("a", 0, "x")]), folder, 2, _build(2), SCHEMA)) == [("a", 1, 0), ("c", 3, 2)]


def test_failed_build_leaves_the_old_state(spark, tmp_path):
    folder, files = str(tmp_path / "a"), _files(spark, [("a", 0, "x")])
    ingest.rebuild(files, folder, 0, _build(0), SCHEMA)
    newer = _files(spark, [("a", 1, "xyz"), ("b", 1, "")])
    fails = lambda stale: stale.select("path", F.raise_error(F.lit("no")).cast("int").alias("size"), F.lit(1).alias("batch"))
    with pytest.raises(Exception, match="no"):
        ingest.rebuild(newer, folder, 1, fails, SCHEMA)
    assert [tuple(r) for r in store.get(spark, folder, SCHEMA).collect()] == [("a", 1, 0)]
    assert sorted(tuple(r) for r in ingest.rebuild(newer, folder, 1, _build(1), SCHEMA).collect()) == [("a", 3, 1), ("b", 0, 1)]
    again = str(tmp_path / "b")
    store.compact(spark, folder, again, SCHEMA)
    assert store.versions(spark, again).count() == 2
    assert ingest.rebuild(newer, again, 1, _build(7), SCHEMA).filter("batch = 7").isEmpty()
    assert ingest.rebuild(_files(spark, []), again, 2, _build(8), SCHEMA).isEmpty()
