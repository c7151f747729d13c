"""The cleaning pipeline: toxicity, quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.llm import packing, quality, simhash, storage, suffix, tokens, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, scores below 0.5; each row on its own, so null and
    repeated ids need nothing special."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected; each row on its own."""
    return quality.judge(docs, carry=["text", "lang", "n_chars"]).filter("kept").select("doc_id", "text", "lang", F.col("host").alias("source"), "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Documents without words are one group. Repeated rows: one stays. A null id stays where its group has no other.
    """
    return simhash.keep_first(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has.

    A cut through a character leaves out the rest of it. Documents stay, if only with an empty text.
    """
    own = docs.withColumn("no_text", F.col("text").isNull())
    out = suffix.remove_repeats(own, carry=("lang", "source", "n_chars", "no_text"), whole_characters=True)
    text = F.when(~F.col("no_text"), F.col("kept").cast("string"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    packed = packing.pack(docs, tokens.vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("packing", pack)]

#: SQL can't express a trained model or a fitted fingerprint threshold; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = storage.write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
