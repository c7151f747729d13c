"""Bounded-space online best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .tokens import END_ID, byte_bpe, vocabulary_path

CAPACITY = 1024
OPEN_BINS = 4096
STREAM_BYTES = 8 << 20  # of input by the plan's own estimate, which for files is their stored size


class BestFit:
    """At most ``open_bins`` open sequences, found by a bitset whose bit f is set while some bin has f free places.

    A piece goes to the bin with the least free space that holds it. If none does, a new bin opens; if
    that is one too many, the fullest closes first.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first_id
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        own = self.bins[free]
        found = own.pop()
        self.count -= 1
        if not own:
            self.bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq, self.next = self.capacity, self.next, self.next + 1
        left = free - length
        if left:
            if self.count == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # the bin at hand is the fullest
                    return seq, self.capacity - free
                self._take(fullest)
            self.bins[left].append(seq)
            self.count += 1
            self.bits |= 1 << left
        return seq, self.capacity - free


def streams(docs: DataFrame, least_bytes: int = STREAM_BYTES) -> DataFrame:
    """``docs`` with small partitions put together, as many as make ``least_bytes``, without an exchange; larger ones stay as they are."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.coalesce(min(max(1, -(-size // least_bytes)), (1 << 31) - 1))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``(id, piece, start, length, ids, sequence_id, offset)``: one row per piece, ``ids`` as little-endian 32-bit.

    A stream is a partition, or many small ones put together (``streams``), with its own bins, so there is no exchange and memory is
    ``open_bins`` at most; each stream leaves at most that many sequences part-filled, most of them
    nearly full. How many sequences there are hangs on the input's size, not on how many partitions it lies in. A document longer than ``capacity`` is cut so that its first piece takes the rest.
    Null or empty text: the end id alone. Repeated rows are packed each. Only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        for b in batches:
            owner, piece, start, length, data, seqs, offs = [], [], [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(t or ""), END_ID], "<u4")
                cut = len(ids) % capacity or capacity
                at, k = 0, 0
                while at < len(ids):
                    seq, off = fit.place(cut - at)
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(cut - at)
                    data.append(ids[at:cut].tobytes())
                    seqs.append(seq)
                    offs.append(off)
                    at, cut, k = cut, cut + capacity, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())], [id_col, "piece", "start", "length", "ids", "sequence_id", "offset"])

    typed = docs.schema[id_col].dataType.simpleString()
    return streams(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {typed}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
