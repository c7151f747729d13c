"""Host-level quality rules: rule failures by domain, shrunk with an empirical beta prior, joined back."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, write_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_LIMIT, HOST_TIMES = 0.5, 3  # a host is rejected where its failure rate is surely above the lower of this rate and so many times the corpus rate
SURE = 1.6448536  # standard deviations of the posterior that a rate must be above the limit: 95 of 100
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text's UTF-8 bytes."""
    words = data.split()
    chars = len(data.translate(None, _SPACES + _CONTINUATION))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), 0
    if n >= 6:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        counts = Counter(grams)
        if len(counts) < len(grams):
            last = 0  # end of what is counted so far
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeat += i + 5 - max(i, last)
                    last = i + 5
    return n, chars, symbols, dup, repeat


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0, x1...)`` of each whole text; x0, x1 are ``carry``."""
    bounded_batches(docs.sparkSession)
    names = [f"x{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(v or b"") for v in b.column(2).cast(pa.binary()).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            rest = iter(b.columns[3:])
            kept = [b.column(2) if c == text_col else next(rest) for c in carry]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, *kept], ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *names])

    types = "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry, names))
    own = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("data"), *(F.col(f"`{c}`").alias(x) for c, x in zip(carry, names) if c != text_col))
    out = own.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint" + types)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(host, n_docs, n_failed, shrunk_rate, host_rejected)``: a host is rejected if its shrunk rate, less ``SURE`` standard deviations of its
    posterior, is above the lower of ``limit`` and ``HOST_TIMES`` the corpus rate; one failure among several documents never does.

    The beta prior has the corpus rate; its weight comes from the hosts' spread around that rate, weighted by their
    documents and less what sampling alone gives, so that hosts of few documents don't pass for different ones. If sampling explains
    all spread, the prior weighs as much as all documents; with one host, two documents. One grouped aggregate makes one row per
    host; the prior is one row.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs"), F.col("n_failed")
    sums = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"))
    rate = F.col("f") / F.col("n")
    spread = F.try_divide(F.col("ff") - F.col("f") * rate, rate * (1 - rate)) - (F.col("k") - 1)
    share = F.try_divide(spread, F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))  # of the variance, what isn't sampling
    weight = F.when(F.col("k") < 2, F.lit(2.0)).when(share > 0, F.greatest(1 / share - 1, F.lit(0.0))).otherwise(F.col("n").cast("double"))
    prior = sums.filter("n > 0").select((rate * weight).alias("alpha"), weight.alias("weight"), F.least(F.lit(limit), HOST_TIMES * rate).alias("limit"))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("weight"))
    # the prior is one row, so this adds two constants to each host
    joined = hosts.join(F.broadcast(prior), F.lit(True), "left")
    low = shrunk - SURE * F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + F.col("weight") + 1))
    return joined.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (F.round(low, 9) > F.round("limit", 9)).alias("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, carry: Sequence[str] = ()) -> DataFrame:
    """Rule results of every document with its ``host`` and that host's verdict: ``kept`` is false if the document itself
    fails the base rules or its host is rejected, which hangs on base failures alone.

    Null text: no words, so it fails. Null host: all such rows form one host. Repeated rows count and
    return as often as they occur. Empty table: no rows. Columns in ``carry`` travel with their row; others are not read.
    """
    measured = write_table(document_rules(docs, id_col, text_col, host_col, carry), "rules")
    verdicts = host_verdicts(measured, limit).withColumnRenamed("host", "v_host")
    out = measured.join(verdicts, F.col("host").eqNullSafe(F.col("v_host")), "left")
    names = [f"x{i}" for i in range(len(carry))]
    out = out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "shrunk_rate", "host", *names)
    return out.toDF(id_col, *out.columns[1:10], *carry)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("shrunk_rate", "host")


SQL = r"""
WITH w AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i+4] AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS t(i) WHERE len(ws) >= 5),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
d AS (SELECT doc_id, sum(n - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS rate, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
s AS (SELECT *, ((ff - f * rate) / nullif(rate * (1 - rate), 0) - (k - 1)) / nullif(n - nn / n - (k - 1), 0) AS share FROM p),
q AS (SELECT rate, CASE WHEN k < 2 THEN 2.0 WHEN share > 0 THEN greatest(1 / share - 1, 0.0) ELSE n END AS weight FROM s),
t AS (SELECT source, h.n + weight AS total, (h.f + rate * weight) / (h.n + weight) AS shrunk, least(0.5, 3 * rate) AS most FROM h, q),
v AS (SELECT source, round(shrunk - 1.6448536 * sqrt(shrunk * (1 - shrunk) / (total + 1)), 9) > round(most, 9) AS bad FROM t)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
