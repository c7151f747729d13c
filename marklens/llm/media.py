"""Ogg media columns: write payloads as Ogg, verify, demultiplex, reassemble and time them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import bounded_batches

RATE = 8000  # samples of 8 bits per second and stream
PACKET = 1000  # samples per packet, so packets need several lacing values
PAGE_SEGMENTS = 12  # lacing values per page, so long packets cross pages
STREAMS = 2  # logical streams; packets alternate between them
MAGIC = b"\x01pcm8"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum (polynomial 04c11db7, no reflection, start 0) through zlib's reflected one."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, serial, seq)
    tail = bytes([len(lacing)]) + lacing + body
    return head + struct.pack("<I", page_crc(head + b"\0\0\0\0" + tail)) + tail


def _stream_pages(serial: int, packets: list[bytes]) -> list[bytes]:
    pages = [_page(2, 0, serial, 0, bytes([len(packets[0])]), packets[0])]
    lacing, body, done, cont, seq = bytearray(), bytearray(), -1, False, 1
    samples = 0
    for i, p in enumerate(packets[1:]):
        left = [255] * (len(p) // 255) + [len(p) % 255]
        at = 0
        for j, v in enumerate(left):
            if len(lacing) == PAGE_SEGMENTS:
                pages.append(_page(int(cont), done, serial, seq, bytes(lacing), bytes(body)))
                seq, cont, done = seq + 1, j > 0, -1
                lacing.clear()
                body.clear()
            lacing.append(v)
            body += p[at : at + v]
            at += v
        samples += len(p)
        done = samples
    pages.append(_page(4 | int(cont), samples, serial, seq, bytes(lacing), bytes(body)))
    return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file with the payload's bytes as 8-bit samples, dealt in packets to ``STREAMS`` logical streams."""
    base = zlib.crc32(payload) & 0x7FFFFFFF
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for k in range(STREAMS):
        own = cut[k::STREAMS]
        head = MAGIC + struct.pack("<BBIQ", k, STREAMS, RATE, sum(map(len, own)))
        streams.append(_stream_pages(base + k, [head, *own]))
    out = [s[0] for s in streams]  # all first pages come first
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


class OggError(ValueError):
    pass


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """Packets of each logical stream: (data, granule at the packet's end or -1, page count so far).

    Raises ``OggError`` on a bad checksum, a missing page, a lost continuation or a truncated file.
    """
    at, streams, state = 0, {}, {}
    view = memoryview(media)
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at {at}")
        _, version, flags, granule, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise OggError(f"truncated page at {at}")
        if page_crc(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"checksum of the page at {at}")
        if flags & 2:
            streams[serial], state[serial] = [], [0, b"", False]
        if serial not in state or state[serial][0] != seq:
            raise OggError(f"page {seq} of stream {serial} is out of order")
        own = state[serial]
        own[0] = seq + 1
        if bool(flags & 1) != own[2]:
            raise OggError(f"continuation at {at}")
        pos, part, finished = at + 27 + n, [own[1]] if own[2] else [], []
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                part.append(media[pos : pos + run])
                finished.append(b"".join(part))
                pos, run, part = pos + run, 0, []
        open_packet = n > 0 and lacing[-1] == 255
        if open_packet:
            part.append(media[pos : pos + run])
        own[1], own[2] = (b"".join(part), True) if open_packet else (b"", False)
        # the page's granule position is that of the last packet ending on it; earlier ones count back
        g = granule
        ends = []
        for p in reversed(finished):
            ends.append(g)
            g = g - len(p) if g >= 0 else -1
        streams[serial] += [(p, e, seq) for p, e in zip(finished, reversed(ends))]
        at = end
    if any(s[2] for s in state.values()):
        raise OggError("a packet has no end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload read back, and facts of the container: streams, packets, pages, seconds."""
    streams = demultiplex(media)
    by_channel, facts = {}, {"streams": len(streams), "packets": 0, "pages": 0, "seconds": 0.0}
    for packets in streams.values():
        head = packets[0][0]
        if head[: len(MAGIC)] != MAGIC:
            raise OggError("unknown codec")
        k, _, rate, total = struct.unpack_from("<BBIQ", head, len(MAGIC))
        data = packets[1:]
        if sum(len(p) for p, _, _ in data) != total or (data and data[-1][1] != total):
            raise OggError("granule position and samples differ")
        by_channel[k] = [p for p, _, _ in data]
        facts["packets"] += len(data)
        facts["pages"] += packets[-1][2] + 1
        facts["seconds"] = max(facts["seconds"], (data[-1][1] if data else 0) / rate)
    n = max((len(v) for v in by_channel.values()), default=0)
    order = [by_channel[k][i] for i in range(n) for k in sorted(by_channel) if i < len(by_channel[k])]
    return b"".join(order), facts


def features(payload: bytes) -> dict:
    """Features of the samples (unsigned, centred at 128)."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    if not x.size:
        return {"mean": 0.0, "rms": 0.0, "crossings": 0}
    return {"mean": float(x.mean(dtype=np.float64)), "rms": float(np.sqrt(np.mean(np.square(x), dtype=np.float64))), "crossings": int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}


def pad(data: bytes, unit: int = 64) -> bytes:
    return data + bytes((-len(data)) % unit if data else unit)


def to_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an Ogg file.

    Null text: empty (64 zero bytes). Other columns are not read, so clashing names are harmless;
    repeated rows stay repeated; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s = b.slice(at, 200)
                raw = [v or b"" for v in s.column(1).to_pylist()]
                media = [encode(pad(v)) for v in raw]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([len(v) for v in raw], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    typed = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"encode(`{text_col}`, 'UTF-8') AS data").mapInArrow(run, f"`{id_col}` {typed}, n_bytes bigint, media binary")


def from_ogg(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read an Ogg column back: ``(id, payload, streams, packets, pages, seconds, feature, error)``.

    Every page's checksum and order is verified; a null or damaged value gives null results and the reason in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s, rows = b.slice(at, 200), []
                for v in s.column(1).to_pylist():
                    try:
                        if v is None:
                            raise OggError("no media")
                        payload, f = decode(v)
                        x = features(payload)
                        f |= {"payload": payload, "error": None, "feature": f"streams={f['streams']};packets={f['packets']};pages={f['pages']};seconds={f['seconds']:.6f};mean={x['mean']:.6f};rms={x['rms']:.6f};crossings={x['crossings']}"}
                    except OggError as e:
                        f = {"error": str(e)}
                    rows.append(f)
                cols = [pa.array([r.get(k) for r in rows], t) for k, t in (("payload", pa.binary()), ("streams", pa.int32()), ("packets", pa.int32()), ("pages", pa.int32()), ("seconds", pa.float64()), ("feature", pa.string()), ("error", pa.string()))]
                extra = [s.column(i) for i in range(2, s.num_columns)]
                yield pa.RecordBatch.from_arrays([s.column(0), *cols, *extra], [id_col, "payload", "streams", "packets", "pages", "seconds", "feature", "error", *s.schema.names[2:]])

    own = media.select(id_col, media_col, *(c for c in media.columns if c not in (id_col, media_col, "payload", "streams", "packets", "pages", "seconds", "feature", "error")))
    rest = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:])
    schema = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, payload binary, streams int, packets int, pages int, seconds double, feature string, error string{rest}"
    return own.mapInArrow(run, schema)


def packet_times(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per data packet: ``(id, serial, packet, start_s, end_s, data)``; null or damaged media gives no rows, one bad page
    fails its whole file. Repeated rows give their packets again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for key, v in zip(ids, b.column(1).to_pylist()):
                try:
                    for serial, packets in demultiplex(v or b"").items():
                        rate = struct.unpack_from("<BBI", packets[0][0], len(MAGIC))[2]
                        rows += [(key, serial, i, (g - len(p)) / rate, g / rate, p) for i, (p, g, _) in enumerate(packets[1:])]
                except OggError:
                    continue
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))], [id_col, "serial", "packet", "start_s", "end_s", "data"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, serial bigint, packet bigint, start_s double, end_s double, data binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through Ogg and back, with digests of what was read back."""
    from pyspark.sql import functions as F

    stored = to_ogg(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stored = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    p = F.col("payload")
    return from_ogg(stored).select(
        "doc_id", "n_bytes", F.length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "streams", "pages", "seconds", "error",
    )


def payload_digest(text: str | None) -> str:
    return hashlib.sha256(pad((text or "").encode())).hexdigest()
