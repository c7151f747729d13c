"""WARC archives with revisit records, and a two-level capture index over them."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, new_path, write_table

BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"  # pages have no capture time


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://m.a.org:80/x?y#z`` becomes ``org,a,m:80)/x?y``; no url: ``-``."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return "-" + url.replace("\n", "%0A")
    if not u.hostname:
        return "-" + url.replace("\n", "%0A")
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(u.hostname.lower().split("."))) + port + ")" + tail.replace("\n", "%0A")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id, url: str | None, payload: bytes, first, first_url: str | None) -> bytes:
    """One compressed WARC record: a response, or a revisit where another page holds the payload."""
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    clean = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Refers-To-Target-URI: {clean(first_url)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(data: bytes) -> dict:
    """Fields of one compressed record; a response's payload must match its digest."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    own = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (digest(payload) != own or len(payload) != length):
        raise ValueError("payload and digest differ")
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
    return {"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": own, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")), "payload": payload if head["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row to ``path/*.warc.gz`` and return the captures ``(key, id, file, offset, length)``.

    Of rows with equal payloads the smallest id is the response and the others revisit it. Null payload:
    empty; null url: key ``-``; a null id is written as a response. Each task writes its own file, named
    by attempt: files of lost attempts are never named by a capture, and stay as orphans. Tasks write and read ranges through
    ``pyarrow.fs``, so ``path`` must lie in a store that it knows (local, HDFS, S3, GCS, Azure). Only the three named columns are read.
    """
    bounded_batches(pages.sparkSession, 200)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    first = own.filter("id IS NOT NULL").groupBy(F.col("sha").alias("f_sha"), F.col("size").alias("f_size")).agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"))
    # hot payloads sit on the left, where AQE can split them; the right has one row per payload
    joined = own.join(first, (F.col("sha") == F.col("f_sha")) & (F.col("size") == F.col("f_size")), "left").select("id", "url", "payload", "first", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(x["id"], x["url"], x["payload"], x["first"] if x["id"] is not None else None, x["first_url"])
                out.write(data)
                rows.append((surt(x["url"]), x["id"], name, at, len(data)))
                at += len(data)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write_table(joined.mapInArrow(run, "key string, id bigint, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """The two-level index: captures sorted by key in compressed blocks, each file ending in a sparse
    directory of its blocks' first keys. Returns ``(file, first_key, last_key, blocks)``, one row per index file.
    Repeated captures stay; no captures, no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        name, out, at, directory, pending, last = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush() -> None:
            nonlocal out, at, pending
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join(pending).encode())
            out.write(data)
            directory.append((pending[0].split("\t", 1)[0], at, len(data)))
            at, pending = at + len(data), []

        for b in batches:
            for x in b.to_pylist():
                last = x["key"].replace("\t", "%09")
                pending.append(f"{last}\t{x['file']}\t{x['offset']}\t{x['length']}")
                if len(pending) == BLOCK_LINES:
                    flush()
        if pending:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, directory[0][0], last, len(directory))], ["file", "first_key", "last_key", "blocks"])

    # the id splits a key that holds many captures over several files
    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset")
    return write_table(ordered.mapInArrow(run, "file string, first_key string, last_key string, blocks bigint"), "index")


def lookup(keys: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """``(key, file, offset, length)`` of every capture of the given distinct ``key`` values.

    The index files' key ranges route each key to the files that may hold it; they are the first level of the index, one short row
    for each of its files (as many as shuffle partitions), and go through the driver to all tasks. There, a
    binary search in the directory finds the block, one range read gets it, and a second search the lines.
    A key that isn't there, or is null, gives no row; a key asked for twice gives its captures twice.
    """
    files = sorted((r.first_key, r.last_key, r.file) for r in index.collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, f = [], []
            for key in filter(None, b.column(0).to_pylist()):
                a, z = bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)
                k += [key] * max(0, z - a)
                f += [files[i][2] for i in range(a, z)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(f, pa.string())], ["key", "file"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name = f = None
        starts, directory, held, lines, line_keys = [], [], -1, [], []
        for b in batches:
            rows = []
            for key, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    if f:
                        f.close()
                    f, name, held = store.open_input_file(f"{base}/{file}"), file, -1
                    size = f.size()
                    n = struct.unpack("<Q", f.read_at(8, size - 8))[0]
                    directory = json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))
                    starts = [d[0] for d in directory]
                i = max(0, bisect.bisect_left(starts, key) - 1)
                while i < len(directory) and starts[i] <= key:
                    if held != i:
                        lines = zlib.decompress(f.read_at(directory[i][2], directory[i][1])).decode().split("\n")
                        line_keys, held = [x.split("\t", 1)[0] for x in lines], i
                    for j in range(bisect.bisect_left(line_keys, key), bisect.bisect_right(line_keys, key)):
                        _, archive, at, length = lines[j].split("\t")
                        rows.append((key, archive, int(at), int(length)))
                    i += 1
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])
        if f:
            f.close()

    routed = keys.select(F.regexp_replace("key", "\t", "%09").alias("key")).mapInArrow(route, "key string, file string")
    return routed.repartition("file").sortWithinPartitions("file", "key").mapInArrow(search, "key string, file string, offset bigint, length bigint")


def read_records(found: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """Range-read and parse the records at ``(file, offset, length)``; each archive's reads go in order.

    Repeated places give repeated records; no places, no rows. A record whose payload and digest differ raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name = f = None
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["file"] != name:
                    if f:
                        f.close()
                    f, name = store.open_input_file(f"{base}/{x['file']}"), x["file"]
                rows.append(parse(f.read_at(x["length"], x["offset"])))
            types = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())) + ((("payload", pa.binary()),) if with_payload else ())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types], [k for k, _ in types])
        if f:
            f.close()

    # a number of its own, as these rows are far smaller than what they make tasks read
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = found.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives, the archives indexed, every url looked up in the index and its records read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives, blocks = new_path(spark, "warc"), new_path(spark, "cdx")
    captures = write_archives(pages, archives)
    index = write_index(captures, blocks)
    found = write_table(lookup(captures.select("key").distinct(), index, blocks), "found")
    return read_records(found, archives, with_payload=False).drop("url")

