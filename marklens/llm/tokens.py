"""Token ids of documents, and training-order materialisation as fixed-stride binary shards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import bounded_batches, drop_table, new_path, without_old_exchanges, write_table

END_ID = 2
LONG_SPACE = 100_000  # white space that tiktoken's split, which backtracks over it, isn't given; it fails at some million
_ENCODERS: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str):
    """``text -> list of ids`` for a byte-level BPE vocabulary file (``.json``), as its own library gives with ``add_special_tokens=False``.

    The ranks are read from the file and tiktoken runs the merges. Texts that hold one of the vocabulary's added
    tokens, such as ``<|endoftext|>``, or very long white space go to the file's own library.
    """
    if path not in _ENCODERS:
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        # fixed values: the printable stand-ins that byte-level vocabularies use for bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        # fixed value: the split pattern of this vocabulary
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        short = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        space, library = re.compile(r"\s{%d}" % LONG_SPACE), []

        def encode(text: str) -> list[int]:
            if not any(x in text for x in added) and (len(text) < LONG_SPACE or not space.search(text)):
                return short(text)
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(path))
            return library[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


# --- keyed Feistel permutation ------------------------------------------------------------------


def feistel(index: np.ndarray, domain: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0..domain-1: a balanced Feistel network over the next even power of two,
    walked along its cycle until it is back inside the domain."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    rng = np.random.default_rng(key)
    keys = rng.integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
                left, right = right, left ^ (f & mask)
        return (left << shift) | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= domain).any():
        out[far] = once(out[far])
    return out


# --- shards -------------------------------------------------------------------------------------

SEQUENCE = 1024  # tokens of a record
NO_ID = -(1 << 63)  # stands for a null id
HEADER = np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("n", "<u2")])
SHARD_BYTES = (8 << 20, 64 << 20)  # of one shard, least and most; between them it follows the size of all
WAVES = 3  # parts of the shards that are exchanged one after the other


def record_type(length: int = SEQUENCE) -> np.dtype:
    """One record: header, ids (two bytes each), and the line end that Spark's text writer puts after a row."""
    return np.dtype([("head", HEADER), ("ids", "<u2", (length,)), ("end", "u1")])


def sequences(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, k, record, held)``: each input partition's documents as one token stream, each closed by the
    end id, cut every ``length`` ids, each record compressed; ``held`` lists the documents that begin in the record, ``(doc_id, offset, n)``.

    Null or empty text: its end id alone. A null id stays null in ``held``; ids are whole numbers, others raise.
    Repeated rows are written each; an empty table gives no rows. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)
    rec = record_type(length)
    pair = pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        part, done, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids, owner, offset, begun = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int32), []

        def flush(n: int) -> pa.RecordBatch:
            nonlocal ids, owner, offset, begun, done
            out = np.zeros(n, rec)
            full = min(len(ids), n * length)
            padded = np.zeros(n * length, np.uint16)
            padded[:full] = ids[:full]
            out["ids"] = padded.reshape(n, length)
            first = np.arange(n) * length
            out["head"]["doc_id"], out["head"]["start"] = owner[first], offset[first]
            out["head"]["n"] = np.minimum(length, len(ids) - first)
            data, size = out.tobytes(), rec.itemsize
            rows = [pack.compress(data[i * size : (i + 1) * size - 1]) for i in range(n)]  # the writer adds the line end itself
            held = [[] for _ in range(n)]
            for d, at, m in begun:
                if at < full:
                    held[at // length].append((d, at % length, m))
            begun = [(d, at - full, m) for d, at, m in begun if at >= full]
            ids, owner, offset = ids[full:], owner[full:], offset[full:]
            done += n
            k = np.arange(done - n, done)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(k), pa.array(rows, pa.binary()), pa.array(held, pa.list_(pair))], ["part", "k", "record", "held"])

        for b in batches:
            parts, own, off, size = [ids], [owner], [offset], len(ids)
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = np.array([*encode(t or ""), END_ID], np.uint16)
                begun.append((d, size, len(e)))
                size += len(e)
                parts.append(e)
                own.append(np.full(len(e), NO_ID if d is None else d, np.int64))
                off.append(np.arange(len(e), dtype=np.int32))
            ids, owner, offset = np.concatenate(parts), np.concatenate(own), np.concatenate(off)
            if n := len(ids) // length:
                yield flush(n)
        if len(ids):
            yield flush(1)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "part int, k bigint, record binary, held array<struct<doc_id:bigint,offset:int,n:bigint>>")


def _before(counts: DataFrame) -> DataFrame:
    """``(part, before)``: how many records the partitions before have; two levels, so no task ranks all partitions."""
    blocks = counts.withColumn("block", F.shiftright("part", 10))
    whole = blocks.groupBy("block").agg(F.sum("n").alias("all"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select("block", earlier("all", W.orderBy("block")).alias("base"))
    return blocks.join(whole, "block").select("part", (F.col("base") + earlier("n", W.partitionBy("block").orderBy("part"))).alias("before"))


def materialise(docs: DataFrame, path: str, tokenizer: str, key: int = 42, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all sequences in training order as ``path/shards/shard=K/part-*``: fixed-stride records in order of slot.

    The records are written once and counted; record i of all n gets slot ``feistel(i, n)``, a keyed bijection of 0..n-1, so the
    permuted index is the slot and shard K holds slots K * R to K * R + R - 1. Each record is exchanged once, those of a
    third of the shards (``WAVES``) at a time, so that a third of the exchange is on disk; Spark's commit protocol makes the files appear once and whole. ``path/layout`` holds n, R and the length; the result, at ``path/documents``, is
    ``(doc_id, slot, offset, n)``: where each document begins and how many ids it has.
    Nulls, repeats, empty tables: as ``sequences``.
    """
    spark = docs.sparkSession
    rows = write_table(sequences(docs, tokenizer, length, id_col, text_col), "records")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stride, parts = record_type(length).itemsize, int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = min(SHARD_BYTES[1], max(SHARD_BYTES[0], total * stride // (8 * parts))) // stride

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = feistel(np.asarray(b.column(0)).astype(np.uint64), total, key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *b.columns[1:]], ["slot", *b.schema.names[1:]])

    # one short row per input partition; written, so Spark knows its size and sends it to the records if it is small
    before = write_table(_before(counts).withColumnRenamed("part", "p"), "before")
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([plain.decompress(v) for v in b.column(1).to_pylist()], pa.binary()), b.column(2)], ["slot", "record", "shard"])

    at = rows.join(before, F.col("part") == F.col("p")).withColumn("index", F.col("before") + F.col("k"))
    records = at.select("index", "record").mapInArrow(permute, "slot bigint, record binary").withColumn("shard", F.expr(f"slot div {per_shard}"))
    shards = max(1, -(-total // per_shard))
    # a binary value cast to string keeps its bytes; the text writer adds one line end, part of the stride
    with without_old_exchanges(spark):
        for low, high in zip(ends := [shards * w // WAVES for w in range(WAVES + 1)], ends[1:]):
            if low < high:
                own, n = records.filter(F.col("shard").between(low, high - 1)), min(high - low, 8 * parts)
                dealt = own.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int"))
                dealt = dealt.mapInArrow(unpack, "slot bigint, record binary, shard bigint").sortWithinPartitions("shard", "slot")
                dealt.select("shard", F.col("record").cast("string").alias("value")).write.mode("append").partitionBy("shard").text(f"{path}/shards")
    held = at.filter(F.size("held") > 0).select("index", "held").mapInArrow(permute, "slot bigint, held array<struct<doc_id:bigint,offset:int,n:bigint>>")
    held.select("slot", F.explode("held").alias("x")).select("x.doc_id", "slot", "x.offset", "x.n").write.parquet(f"{path}/documents")
    spark.range(1).select(F.lit(total).alias("records"), F.lit(per_shard).alias("per_shard"), F.lit(length).alias("length")).write.parquet(f"{path}/layout")
    drop_table(rows)
    return spark.read.schema("doc_id long, slot long, offset int, n long").parquet(f"{path}/documents")


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Records in training order from ``from_slot`` on: ``(slot, shard, position, doc_id, start, n_tokens, ids)``.

    A reader that stopped at a slot resumes there: earlier shards are not opened, and in its own shard, which is read whole (``SHARD_BYTES``
    at most), records are skipped by stride. ``doc_id`` and ``start`` tell the document that a record begins in. A path
    without records gives no rows.
    """
    total, per_shard, length = spark.read.parquet(f"{path}/layout").first()
    rec = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(content.as_buffer(), rec)
                for at in range(max(0, from_slot - shard * per_shard), len(data), 2000):
                    c = data[at : at + 2000]
                    pos = np.arange(at, at + len(c))
                    n, doc = c["head"]["n"].astype(np.int64), c["head"]["doc_id"].astype(np.int64)
                    ids = [row[:k].tobytes() for row, k in zip(c["ids"], n)]
                    cols = [pa.array(pos + shard * per_shard), pa.array(np.full(len(c), shard)), pa.array(pos), pa.array(doc, mask=doc == NO_ID), pa.array(c["head"]["start"].astype(np.int64)), pa.array(n), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "position", "doc_id", "start", "n_tokens", "ids"])

    schema = "slot bigint, shard bigint, position bigint, doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not total:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    own = files.filter(F.col("shard") >= from_slot // per_shard).select(F.col("shard").cast("long"), "content")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return own.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents' token sequences, written in training order and read back: one row per global slot."""
    path = new_path(spark, "order")
    materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_path("byte_bpe_50k.json"))
    return read_shards(spark, path).select("slot", "shard", "position", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
