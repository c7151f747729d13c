"""Suffix-array deduplication: byte strings that repeat from an earlier document are cut out.

The sort is deep-shallow: suffixes are ordered by multikey quicksort to a shallow depth, and groups that
still agree there by blind tries over the rest. It need not see every suffix. A string of 50 bytes holds
35 windows of 16 bytes; the least hash of them is a property of the string alone, so equal strings meet
under that hash. Consecutive starts with the same least hash form a segment, some 7 for 100 bytes. Only
segments whose hash turns up in two documents matter; equal ones (a second hash, of their bytes) first
become one, and what still differs under a hash is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, write_table

LENGTH = 50
GRAM = 16
RUN = 64  # starts of one segment at most
SHALLOW = 32  # bytes that multikey quicksort looks at, eight at a time
CROWD = 2_000  # distinct segments of one least hash beyond which its strings are dealt one by one
PIECE = 1 << 17  # starts whose hashes are made at a time, some 60 bytes each
PER_BUCKET = 1_000_000  # keys of a bucket
SORTED = 200_000  # suffixes sorted together, some 150 bytes each; one key's are never parted


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes, a multiple of eight, at each place of ``data``."""
    m = len(data) - GRAM + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, GRAM, 8):
            h += word[at : at + m]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, length: int) -> np.ndarray:
    """For each start of a ``length``-byte string: the least hash of the grams inside it."""
    width, span = length - GRAM + 1, 1
    if len(h) < width:
        return np.empty(0, np.uint64)
    while span * 2 <= width:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (least hash, hash of the bytes, text number, first start in the text, number of starts) of each segment."""
    grams = gram_hashes(data)
    least = window_minima(grams, length)
    starts = np.maximum(np.diff(offsets) - length + 1, 0)
    if not len(least) or not starts.sum():
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty, empty
    begin, end = offsets[:-1][starts > 0], (offsets[:-1] + starts)[starts > 0]
    edge = np.zeros(len(least) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    valid = np.cumsum(edge, dtype=np.int8)[:-1] > 0
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    new[begin] = new[end] = True
    cut = np.flatnonzero(new)
    at, count = cut[:-1], np.diff(cut)
    at, count = at[valid[at]], count[valid[at]]
    if (count > RUN).any():
        parts = -(-count // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, count = np.repeat(at, parts) + k * RUN, np.minimum(RUN, np.repeat(count, parts) - k * RUN)
    # bytes of a segment by the polynomial of its grams' hashes, shifted to the segment's start
    power, inverse = _powers(1 << (len(grams) - 1).bit_length())
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * power[: len(grams)])])
        own = (total[at + count + length - GRAM] - total[at]) * inverse[at]
        own = (own ^ own >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64)
    text = np.searchsorted(offsets, at, "right") - 1
    return least[at], own.view(np.int64), text, at - offsets[text], count


def _binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, nulls empty."""
    if col.null_count:
        col = pa.array([v or b"" for v in col.to_pylist()], pa.binary())
    raw = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if raw[-1] == raw[0]:
        return np.empty(0, np.uint8), raw - raw[0]
    return np.frombuffer(col.buffers()[2], np.uint8)[raw[0] : raw[-1]], raw - raw[0]


# --- deep-shallow sort ------------------------------------------------------------------------


class BlindTrie:
    """Orders byte strings of one length, as integers: inner nodes keep only the bit where their branches part."""

    def __init__(self, bits: int):
        self.bits, self.root = bits, None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = (value, [item])
            return
        node = self.root
        while len(node) == 3:  # blind descent: bits between the nodes are skipped
            node = node[2][value >> node[0] & 1]
        part = value ^ node[0]
        if not part:
            node[1].append(item)
            return
        bit = part.bit_length() - 1
        leaf = (value, [item])
        above, side, node = None, 0, self.root
        while len(node) == 3 and node[0] > bit:
            above, side, node = node, value >> node[0] & 1, node[2][value >> node[0] & 1]
        fork = (bit, None, [leaf, node] if not value >> bit & 1 else [node, leaf])
        if above is None:
            self.root = fork
        else:
            above[2][side] = fork

    def ordered(self) -> list[list[int]]:
        """Items in order of their strings, equal strings in one list."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 3:
                todo += [node[2][1], node[2][0]]
            else:
                out.append(node[1])
        return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(order, first)``: the suffixes at ``starts`` by group and their first ``length`` bytes, and where in that order each
    class of equal ones begins. ``group`` doesn't decrease.

    Multikey quicksort takes all groups forward at once: in a round each group parts three ways at a pivot of its own, and what equals
    it goes on to the next eight bytes. Groups that agree in ``SHALLOW`` bytes are ordered by blind tries.
    """
    n, depths = len(starts), min(SHALLOW, length) // 8
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.ndarray((len(data) + length,), ">u8", padded, strides=(1,))
    chars = [word[starts + 8 * k].astype(np.uint64) for k in range(depths)]
    order, new, depth = np.arange(n), np.ones(n + 1, bool), np.zeros(n, np.int8)
    new[1:-1] = group[1:] != group[:-1]
    first = np.flatnonzero(new[:-1])
    rounds = 0
    while len(first):
        size = np.flatnonzero(new)[np.searchsorted(np.flatnonzero(new), first, "right")] - first
        live = (size > 1) & (depth[first] < depths)
        first, size, rounds = first[live], size[live], rounds + 1
        if not len(first):
            break
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        base = np.cumsum(size) - size
        items, level = order[at], depth[first]
        c = np.empty(len(at), np.uint64)
        of = np.repeat(level, size)
        for k in np.unique(level).tolist():
            own = of == k
            c[own] = chars[k][items[own]]
        pivot = np.repeat(c[base + (first * 0x9E3779B1 + rounds * 0x85EBCA6B >> 7) % size], size)
        less, equal = c < pivot, c == pivot
        n_less, n_equal = (np.add.reduceat(x.astype(np.int64), base) for x in (less, equal))
        ranks = [np.cumsum(x) - 1 for x in (less, equal, ~(less | equal))]
        before = [np.repeat(r[base] + 1 - x[base], size) for r, x in zip(ranks, (less, equal, ~(less | equal)))]
        skip = (0, np.repeat(n_less, size), np.repeat(n_less + n_equal, size))
        place = np.where(less, ranks[0] - before[0], np.where(equal, ranks[1] - before[1] + skip[1], ranks[2] - before[2] + skip[2]))
        order[np.repeat(first, size) + place] = items
        begin = [first, first + n_less, first + n_less + n_equal]
        some = [n_less > 0, n_equal > 0, size > n_less + n_equal]
        for b, ok, more in zip(begin, some, (0, 1, 0)):
            new[b[ok]] = True
            depth[b[ok]] = level[ok] + more
        first = np.unique(np.concatenate([b[ok] for b, ok in zip(begin, some)]))
    first = np.flatnonzero(new[:-1])
    size = np.diff(np.append(first, n))
    deep = length - 8 * depths
    long = size > 1
    if deep and long.any():
        at = np.flatnonzero(np.repeat(long, size))
        inner = at[~new[at]]  # all but a group's first
        rest = starts + 8 * depths
        unlike = np.zeros(len(inner), bool)
        for k in [*range(0, deep - 7, 8), max(0, deep - 8)] if deep >= 8 else []:
            unlike |= word[rest[order[inner]] + k] != word[rest[order[inner - 1]] + k]
        for k in range(deep if deep < 8 else 0):
            unlike |= padded[rest[order[inner]] + k] != padded[rest[order[inner - 1]] + k]
        raw = padded.tobytes()
        for g in np.unique(np.searchsorted(first, inner[unlike], "right") - 1).tolist():
            trie, own = BlindTrie(8 * deep), order[first[g] : first[g] + size[g]].tolist()
            for i in own:
                trie.add(int.from_bytes(raw[rest[i] : rest[i] + deep], "big"), i)
            put = first[g]
            for same in trie.ordered():
                order[put : put + len(same)] = same
                new[put] = True
                put += len(same)
        first = np.flatnonzero(new[:-1])
    return order, first


def deep_shallow(data: bytes, starts: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Numbers of the suffixes at ``starts`` sorted by their first ``length`` bytes, equal ones in one list."""
    order, first = sort_suffixes(np.frombuffer(data, np.uint8), np.asarray(starts), np.zeros(len(starts), np.int8), length)
    return [x.tolist() for x in np.split(order, first[1:])] if len(order) else []


# --- Spark ------------------------------------------------------------------------------------
#
# Four exchanges of packed arrays, all sizes in proportion to the texts:
#   chunks of whole rows (a written table)  -> hashes by bucket   -> which of them are shared, by chunk
#   -> shared segments with bytes by bucket -> byte runs to remove, by chunk -> cut rows


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, each by byte planes, so high bytes that agree cost nothing."""
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.compress(head + b"".join(planes), 3)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, "<u4", len(kinds)).tolist(), kinds):
        size = n * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).view(kind).reshape(n) if n else np.empty(0, kind))
        at += size
    return out


def _chunk_bytes(total: int, parts: int) -> int:
    return min(8 << 20, max(1 << 17, total // (8 * parts)))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """``(chunk, rows)``: about ``size`` bytes of texts a row, as a compressed Arrow stream. Written once, so a chunk's number stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, held_size
            own = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(own, max_chunksize=max(1, own.num_rows))
            held, held_size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

        for b in batches:
            sizes = np.cumsum(np.diff(_binary(b.column(1))[1]) + 16)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size - held_size, "right")))
                held.append(b.slice(at, end - at))
                held_size += int(sizes[min(end, b.num_rows) - 1] - (sizes[at - 1] if at else 0))
                at = end
                if held_size >= size or at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    return write_table(rows.mapInArrow(run, "rows binary").select(F.monotonically_increasing_id().alias("chunk"), "rows"), "chunks")


def _open(rows: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows; the texts' bytes and offsets; ids; which rows have one."""
    b = pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]
    ids = b.column(0)
    return b, *_binary(b.column(1)), np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads least hashes, which crowd at the low end, over all values."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)


def _buckets(v: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((v >> np.uint64(bits - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


class _Segments:
    """A chunk's segments in order of key and bytes' hash, and its distinct keys ``v``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, valid: np.ndarray, bits: int, length: int):
        parts = []
        for at in range(0, max(1, len(data) - length + 1), PIECE):  # a piece's windows end in the next one's bytes
            h, k, text, start, count = segments(data[at : at + PIECE + length - 1], np.clip(offsets - at, 0, min(PIECE + length - 1, len(data) - at)), length)
            start = start + np.maximum(offsets[text] - at, 0) + at
            has = valid[text]
            parts.append((_mix(h[has]) >> np.uint64(64 - bits), k[has], ids[text[has]], start[has], count[has]))
        v, k, self.id, self.start, self.count = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((k, v))
        self.key, self.k, self.id, self.start, self.count = v[order], k[order], self.id[order], self.start[order], self.count[order]
        self.first = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if len(v) else np.empty(0, np.int64)
        self.v = self.key[self.first]


def _hash_blobs(chunks: DataFrame, bits: int, buckets: int, length: int) -> DataFrame:
    """``(bucket, chunk, blob)``: a chunk's distinct keys, with how many distinct segments have them (up to 127), whether
    two documents do, and a byte of the first such segment's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows in zip(b.column(0).to_pylist(), b.column(1)):
                s = _Segments(*_open(rows.as_py())[1:], bits, length)
                if not len(s.v):
                    continue
                new = np.append(True, (s.key[1:] != s.key[:-1]) | (s.k[1:] != s.k[:-1]))
                kinds = np.minimum(np.add.reduceat(new.astype(np.int64), s.first), 127)
                more = np.minimum.reduceat(s.id, s.first) < np.maximum.reduceat(s.id, s.first)
                about, sign = (kinds << 1 | more).astype(np.uint8), (s.k[s.first] >> 40).astype(np.uint8)
                own = _buckets(s.v, bits, buckets)
                cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                blobs = [_pack(np.diff(s.v[a:z], prepend=np.uint64(0)), about[a:z], sign[a:z]) for a, z in zip(cut, np.append(cut[1:], len(own)))]
                yield pa.RecordBatch.from_arrays([pa.array(own[cut].astype(np.int32)), pa.array(np.full(len(cut), chunk)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    return chunks.mapInArrow(run, "bucket int, chunk bigint, blob binary")


def _by_bucket(blobs: DataFrame, parts: int, buckets: int, solve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``(chunk, bucket, blob)``: ``solve`` turns all blobs of a bucket into one answer each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, now = [], [], None

        def answers() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([now] * len(of), pa.int32()), pa.array(solve(held) if held else [], pa.binary())], ["chunk", "bucket", "blob"])

        for b in batches:
            for bucket, chunk, blob in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield answers()
                    held, of = [], []
                now = bucket
                held.append(blob)
                of.append(chunk)
        yield answers()

    dealt = blobs.repartitionById(parts, (F.col("bucket").cast("long") * parts / buckets).cast("int")).sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk bigint, bucket int, blob binary")


def _with_chunks(chunks: DataFrame, answers: DataFrame, use: Callable[[int, bytes, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``use(chunk, rows, answers in order of bucket)`` for every chunk. The chunks' exchange is the same each time, so Spark makes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows, blobs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                yield from use(chunk, rows.as_py(), [x["blob"] for x in blobs or ()])

    each = answers.groupBy(F.col("chunk").alias("of")).agg(F.array_sort(F.collect_list(F.struct("bucket", "blob"))).alias("blobs"))
    return chunks.join(each, F.col("chunk") == F.col("of"), "left").select("chunk", "rows", "blobs").mapInArrow(run, schema)


def _shared(blobs: list[bytes], crowd: int) -> list[bytes]:
    """For each key of each blob: 1 if two documents have it, 2 if moreover over ``crowd`` distinct segments do."""
    each = [_unpack(x, "<u8", "u1", "u1") for x in blobs]
    v = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _, _ in each])
    about, sign = (np.concatenate([x[i] for x in each]) for i in (1, 2))
    order = np.argsort(v, kind="stable")
    new = np.append(True, v[order][1:] != v[order][:-1])
    first = np.flatnonzero(new)
    shared = (np.diff(np.append(first, len(v))) > 1) | (np.bitwise_or.reduceat(about[order], first) & 1 > 0)
    unlike = (np.minimum.reduceat(sign[order], first) < np.maximum.reduceat(sign[order], first)) | (np.maximum.reduceat(about[order], first) > 3)
    crowded = unlike & (np.add.reduceat((about[order] >> 1).astype(np.int64), first) > crowd)
    state = np.empty(len(v), np.uint8)
    state[order] = (shared.astype(np.uint8) * (1 + crowded))[np.cumsum(new) - 1]
    return [_pack(x) for x in np.split(state, np.cumsum([len(d) for d, _, _ in each])[:-1])]


def _rows_of(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes at each start, zeros past the end."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[start]


def _segment_blobs(bits: int, buckets: int, length: int) -> Callable:
    """Of a chunk's shared segments: one blob for each bucket with keys, numbers of starts, occurrences and bytes of the distinct ones.

    A crowded key's segments are taken apart into their strings of ``length`` bytes, each under a key of its own,
    so no bucket holds all that stands around a common phrase.
    """

    def use(chunk: int, rows: bytes, states: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, data, offsets, ids, valid = _open(rows)
        s = _Segments(data, offsets, ids, valid, bits, length)
        state = np.concatenate([_unpack(x, "u1")[0] for x in states]) if states else np.empty(0, np.uint8)
        of = np.repeat(state, np.diff(np.append(s.first, len(s.key)))) if len(s.v) else state
        one, many = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        key, k, at, count, owner = s.key[one], s.k[one], s.start[one], s.count[one], s.id[one]
        if len(many):
            n = s.count[many]
            begin = np.repeat(s.start[many] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.zeros(len(begin), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(0, length, 8):
                    word = _rows_of(data, begin + i, min(8, length - i))
                    word = np.pad(word, ((0, 0), (0, 8 - word.shape[1])))
                    own = (own ^ np.ascontiguousarray(word).view("<u8").ravel()) * np.uint64(0x9E3779B97F4A7C15)
                    own ^= own >> np.uint64(29)
            key, k = np.concatenate([key, _mix(own) >> np.uint64(64 - bits)]), np.concatenate([k, own.view(np.int64)])
            at, count, owner = np.concatenate([at, begin]), np.concatenate([count, np.ones(len(begin), np.int64)]), np.concatenate([owner, np.repeat(s.id[many], n)])
        if not len(key):
            return
        order = np.lexsort((k, key))
        key, k, at, count, owner = key[order], k[order], at[order], count[order], owner[order]
        like = np.flatnonzero((key[1:] == key[:-1]) & (k[1:] == k[:-1]) & (count[1:] == count[:-1])) + 1
        for i in range(0, len(like), 20_000):  # equal hashes: their bytes decide
            pick = like[i : i + 20_000]
            wide = int(count[pick].max()) + length - 1
            same = (_rows_of(data, at[pick], wide) == _rows_of(data, at[pick - 1], wide)) | (np.arange(wide) >= (count[pick] + length - 1)[:, None])
            like[i : i + 20_000] = np.where(same.all(1), pick, 0)
        new = np.ones(len(key), bool)
        new[like[like > 0]] = False
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key)))
        size = count[first] + length - 1
        text = data[np.repeat(at[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        bucket = _buckets(key[first], bits, buckets)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends, row, byte = np.append(cut[1:], len(bucket)), np.append(first, len(key)), np.append(0, np.cumsum(size))
        blobs = [
            _pack(np.diff(key[first[a:z]], prepend=np.uint64(0)), count[first[a:z]].astype(np.uint8), times[a:z].astype("<u4"), owner[row[a] : row[z]], at[row[a] : row[z]].astype("<u4"), text[byte[a] : byte[z]])
            for a, z in zip(cut, ends)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), chunk)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    return use


def _owners(keys: np.ndarray, low: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of distinct segments, in order of key: runs ``(segment, first start, starts, owner)``, the owner being the smallest id that has those strings.

    Segments alone under their key own their strings. The others' suffixes are sorted, and equal ones share the smallest id.
    """
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    mixed = np.flatnonzero(~(new & np.append(new[1:], True)))
    alone = np.flatnonzero(new & np.append(new[1:], True))
    sizes = np.array([len(t) for t in texts], np.int64)
    count = sizes - length + 1
    runs = [(alone, np.zeros(len(alone), np.int64), count[alone], low[alone])]
    cut = np.flatnonzero(np.append(True, np.diff(keys[mixed]) > 0)) if len(mixed) else np.empty(0, np.int64)
    done = np.add.reduceat(count[mixed], cut).cumsum() // SORTED if len(mixed) else cut
    for part in np.split(mixed, cut[1:][np.diff(done) > 0]) if len(mixed) else []:
        n, size = count[part], sizes[part]
        seg = np.repeat(np.arange(len(part)), n)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        text = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        group = np.cumsum(np.append(False, np.diff(keys[part]) > 0))[seg]
        order, first = sort_suffixes(text, (np.cumsum(size) - size)[seg] + off, group, length)
        best = np.empty(len(seg), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(low[part][seg][order], first), np.diff(np.append(first, len(order))))
        new = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (best[1:] != best[:-1])))
        runs.append((part[seg[new]], off[new], np.diff(np.append(new, len(seg))), best[new]))
    return tuple(np.concatenate(x) for x in zip(*runs))


def _runs(blobs: list[bytes], length: int) -> list[bytes]:
    """For each blob: the byte runs (start, length) of its chunk to remove, of the strings that a smaller id has."""
    each = [_unpack(x, "<u8", "u1", "<u4", "<i8", "<u4", "u1") for x in blobs]
    found: dict[bytes, int] = {}
    entry, key, texts = [], [], []
    for d, count, _, _, _, text in each:
        ends = np.cumsum(count.astype(np.int64) + length - 1)
        raw, own = text.tobytes(), np.cumsum(d, dtype=np.uint64)
        begin = 0
        for i, end in enumerate(ends.tolist()):
            t = raw[begin:end]
            begin = end
            n = found.setdefault(t, len(found))
            if n == len(texts):
                texts.append(t)
                key.append(own[i])
            entry.append(n)
    times = np.concatenate([x[2] for x in each]).astype(np.int64)
    of = np.repeat(np.array(entry, np.int64), times)
    ids, start = np.concatenate([x[3] for x in each]), np.concatenate([x[4] for x in each]).astype(np.int64)
    chunk = np.repeat(np.arange(len(each)), [len(x[3]) for x in each])
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, of, ids)
    order = np.argsort(np.array(key, np.uint64), kind="stable")
    seg, off, n, owner = _owners(np.array(key, np.uint64)[order], low[order], [texts[i] for i in order], length)
    seg = order[seg]
    back = np.argsort(seg, kind="stable")
    seg, off, n, owner = seg[back], off[back], n[back], owner[back]
    first = np.searchsorted(seg, np.arange(len(texts) + 1))
    many = np.diff(first)[of]
    run = np.repeat(first[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    occ = np.repeat(np.arange(len(of)), many)
    gone = owner[run] < ids[occ]
    run, occ = run[gone], occ[gone]
    at, size, chunk = start[occ] + off[run], n[run] + length - 1, chunk[occ]
    order = np.lexsort((at, chunk))
    cut = np.searchsorted(chunk[order], np.arange(1, len(each)))
    return [_pack(np.diff(a, prepend=0).astype("<u4"), z.astype("<u4")) for a, z in zip(np.split(at[order], cut), np.split(size[order], cut))]


def _cut(whole: bool, names: list[str]) -> Callable:
    def use(chunk: int, rows: bytes, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        b, data, offsets, _, _ = _open(rows)
        edge = np.zeros(len(data) + 1, np.int32)
        for x in runs:
            a, size = (y.astype(np.int64) for y in _unpack(x, "<u4", "<u4"))
            np.add.at(edge, a := np.cumsum(a), 1)
            np.add.at(edge, a + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        if whole and gone.any():  # a character that loses a byte goes
            begin = np.flatnonzero((data & 0xC0) != 0x80)
            if len(begin):
                gone = np.repeat(np.bitwise_or.reduceat(gone, begin), np.diff(np.append(begin, len(data))))
        total = np.append(0, np.cumsum(gone))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
        ends = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        n_spans = np.searchsorted(starts, offsets)
        spans = pa.ListArray.from_arrays(pa.array(n_spans.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts - offsets[text]), pa.array(ends - offsets[text])], ["s", "e"]))
        left = (offsets - total[offsets]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(data[~gone].tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), spans, kept, *b.columns[2:]], ["id", "n_bytes", "n_removed", "spans", "kept", *names])

    return use


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept, *carry)``, a row for each row: ``spans`` are the maximal byte runs ``[s, e)``
    that go, in order, and ``kept`` is the rest of the text's bytes.

    A byte goes if a ``length``-byte string over it also starts in a document with a smaller id (whole numbers;
    others raise). With ``whole_characters`` a character goes with any of its bytes. Null and short texts
    lose nothing (null: no bytes), nor do rows with a null id, which own nothing either; rows that repeat an id are one document. An empty table
    gives no rows. Columns in ``carry`` travel with their row, whatever their names; others are not read.
    """
    bounded_batches(docs.sparkSession, 5000)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    # chance meetings of keys stay rare at any size, and a bucket holds about PER_BUCKET of them, one in 14 bytes
    bits = min(62, 14 + max(22, int(total).bit_length()))
    buckets = parts * max(1, -(-total // (14 * PER_BUCKET * parts)))
    names = [f"x{i}" for i in range(len(carry))]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")).alias("data"), *(F.col(f"`{c}`").alias(x) for c, x in zip(carry, names)))
    chunks = _chunks(own, _chunk_bytes(total, parts))
    crowd = CROWD
    states = _by_bucket(_hash_blobs(chunks, bits, buckets, length), parts, buckets, lambda blobs: _shared(blobs, crowd))
    shared = _with_chunks(chunks, states, _segment_blobs(bits, buckets, length), "bucket int, chunk bigint, blob binary")
    runs = _by_bucket(shared, parts, buckets, lambda blobs: _runs(blobs, length))
    types = "".join(f", {x} {own.schema[x].dataType.simpleString()}" for x in names)
    out = _with_chunks(chunks, runs, _cut(whole_characters, names), "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<s:bigint,e:bigint>>, kept binary" + types)
    return out.toDF(id_col, "n_bytes", "n_removed", "spans", "kept", *carry)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract by a dictionary of all strings, for small fixtures."""
    first: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], d)
    out = []
    for d, t in data.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(v for v, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)
