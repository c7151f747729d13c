"""Harmonic packing: pieces in classes of one length each, a fixed number of them to a sequence."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .tokens import byte_bpe, vocabulary_path

CAPACITY = 2048
END_ID = 1
ROW_TOKENS = 1 << 20  # tokens after which rows leave the task


class Piece(NamedTuple):
    owner: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    sequence: int
    offset: int


def class_sizes(capacity: int, smallest: int = 1) -> list[int]:
    """capacity / k for each k that divides it, falling, down to ``smallest``; class k's sequences hold k pieces and no padding."""
    return [capacity // k for k in range(1, capacity + 1) if capacity % k == 0 and capacity // k >= smallest]


def cut(length: int, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(size of the class, length of the piece), the largest class that the rest fills first. Below the smallest class the rest is one piece of it."""
    for size in sizes:
        while length >= size:
            yield size, size
            length -= size
    if length:
        yield sizes[-1], length


class Harmonic:
    """One open sequence for each class. The pieces of an open one are held, ``capacity`` tokens a class at most."""

    def __init__(self, capacity: int, sizes: list[int], first_id: int = 0):
        self.capacity, self.next = capacity, first_id
        self.open: dict[int, list[Piece]] = {s: [] for s in sizes}

    def _close(self, pieces: list[Piece]) -> list[Piece]:
        at, out = 0, []
        for p in pieces:
            out.append(p._replace(sequence=self.next, offset=at))
            at += len(p.ids)
        self.next += 1
        return out

    def add(self, size: int, piece: Piece) -> list[Piece]:
        """The sequence that this piece closes, if it does."""
        own = self.open[size]
        own.append(piece)
        if len(own) < self.capacity // size:
            return []
        self.open[size] = []
        return self._close(own)

    def end(self) -> Iterator[list[Piece]]:
        """What is left of all classes, the longest first, as full sequences; the last tokens go by powers of two, which need no padding."""
        rest = deque(sorted((p for own in self.open.values() for p in own), key=lambda p: -len(p.ids)))
        total = sum(len(p.ids) for p in rest)
        while rest:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            if len(rest[0].ids) > room:
                room = self.capacity
            own, used = [], 0
            while rest and used + len(rest[0].ids) <= room:
                own.append(rest.popleft())
                used += len(own[-1].ids)
            total -= used
            yield self._close(own)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, smallest: int = 1) -> DataFrame:
    """``(id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece, ``ids`` as little-endian 32-bit.

    A document's ids, its end id included, are cut into pieces of capacity / k tokens, k dividing the capacity, the longest first; k
    pieces of one class make a sequence, so it has no padding. Each task fills its own classes: no exchange, no common state, and a task
    that runs again gives the same rows. What its classes have left, under ``capacity`` tokens each, is packed together at its end; the
    last of it makes sequences of a power of two of tokens, so nothing is padded where the capacity is one. ``smallest`` bounds the number of
    pieces: a rest below it is one piece, and its class's sequences are padded.
    Null or empty text: the end id alone. Null ids stay null. Repeated rows are packed each; an empty table gives no rows. Only
    the two named columns are read.
    """
    bounded_batches(docs.sparkSession)
    sizes, names = class_sizes(capacity, smallest), [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, kind = byte_bpe(tokenizer), Harmonic(capacity, sizes, TaskContext.get().partitionId() << 36), None

        def rows(pieces: list[Piece]) -> pa.RecordBatch:
            ints = ([p.start for p in pieces], [len(p.ids) for p in pieces], [p.doc_tokens for p in pieces], [p.sequence for p in pieces], [p.offset for p in pieces])
            start, length, tokens, seq, at = (pa.array(v, pa.int64()) for v in ints)
            return pa.RecordBatch.from_arrays([pa.array([p.owner for p in pieces], kind), start, length, pa.array([p.ids.tobytes() for p in pieces], pa.binary()), tokens, seq, at], names)

        out, held = [], 0
        for b in batches:
            kind = b.schema.field(0).type
            for owner, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at = 0
                for size, n in cut(len(ids), sizes):
                    out += (done := bins.add(size, Piece(owner, at, ids[at : at + n].copy(), len(ids), 0, 0)))
                    at, held = at + n, held + sum(len(p.ids) for p in done)
                    if held >= ROW_TOKENS:
                        yield rows(out)
                        out, held = [], 0
        for done in bins.end():
            out += done
        if out:
            yield rows(out)

    typed = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
