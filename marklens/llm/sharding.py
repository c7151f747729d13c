"""Uniform shuffle with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import write_table

SHARDS = 24
BUCKET_ROWS = 1_000_000  # rows of a shard that one task permutes
SOURCES = 10_000  # source partitions at most; more are joined, unmoved, so the matrix has a bound


def _log_factorial(n: int) -> np.longdouble:
    """ln n! in extended precision: Stirling's series from 64 on."""
    if n < 64:
        return np.log(np.longdouble(math.factorial(n)))
    x = np.longdouble(n)
    return x * np.log(x) - x + np.log(2 * np.longdouble(math.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows out of ``good + bad`` are good: inversion outward from the mode.

    The mode's probability is right to some 8 digits at 10^10 rows and 12 at 10^6; the steps taken grow with the
    standard deviation, so with the root of ``drawn``.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> np.longdouble:
        return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    up = down = mode
    p_up = p_down = float(np.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn)))
    u = rng.random() - p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(sources: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows each source sends to each shard, as a uniform shuffle into shards of exact sizes would."""
    rng, total = random.Random(seed), sum(sources)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in sources:
        row, rest = [], total
        total -= n
        for s in range(shards):
            k = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            left[s] -= k
            n -= k
            row.append(k)
        matrix.append(row)
    return matrix


def _table(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table, written so that no later plan carries it: one row per source partition."""
    return write_table(df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))), "matrix")


def shuffle_exact(df: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``df`` plus ``shard`` (0..shards-1, sizes at most one row apart) and ``slot`` (gapless from 0 in each shard).

    Every row goes to a uniformly drawn place. Each source partition orders its rows by a keyed hash,
    its exact row of the matrix says how many of them go where, they are exchanged once, and each shard
    orders what it got by a second hash, in buckets of near-equal size, so no task holds a whole shard
    of a large table. The driver gets one count per source partition and draws the matrix, ``SOURCES`` rows at most,
    which becomes a table. The input is written
    once with its row numbers, so both passes and any retry see the same rows. Null values, repeated
    rows and an empty table need nothing special; columns named shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    free = lambda name: name if name not in df.columns else free("_" + name)
    mid, src, cum, bucket, second, before = (free(f"__{n}") for n in ("row", "source", "ends", "bucket", "second", "before"))
    first: Column = F.xxhash64(F.lit(seed), *df.columns) if df.columns else F.lit(0)
    numbered = df.coalesce(SOURCES).sortWithinPartitions(first).withColumn(mid, F.monotonically_increasing_id())
    rows = write_table(numbered, "shard-input").withColumn(src, F.shiftright(mid, 33))
    counts = sorted(rows.groupBy(src).count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = [{"s": p, "c": list(accumulate(m))[:-1]} for (p, _), m in zip(counts, matrix)]
    where = _table(df, ends, "s bigint, c array<bigint>").select(F.col("s").alias(src), F.col("c").alias(cum))
    place = F.col(mid).bitwiseAND((1 << 33) - 1)
    # SOURCES rows at most: a proven bound
    out = rows.join(F.broadcast(where), src).withColumn("shard", F.size(F.filter(cum, lambda c: c <= place)))
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    out = out.withColumn(second, F.xxhash64(F.lit(seed + 1), mid)).withColumn(bucket, F.pmod(F.shiftright(second, 20), F.lit(buckets)))
    got = out.groupBy("shard", bucket).count()
    offsets = got.select("shard", bucket, F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    in_bucket = F.row_number().over(W.partitionBy("shard", bucket).orderBy(second, mid))
    ranked = out.withColumn("slot", in_bucket.cast("long") - 1)
    if buckets > 1:
        ranked = ranked.join(F.broadcast(offsets) if buckets * shards < 100_000 else offsets, ["shard", bucket]).withColumn("slot", F.col("slot") + F.col(before))
    return ranked.select(*df.columns, "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own = docs.select("doc_id", (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shuffle_exact(own)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
