"""SimHash near-duplicates by anchor points of a covering code.

The code: fingerprints whose set bits' positions XOR to zero, an extended Hamming code. Its covering
radius is 1: flipping bit s, the XOR of the positions, always reaches it. Two fingerprints at most
d = 2 bits apart have a point between them at most 1 bit from both, so each lies within
radius + d/2 = 2 of that point's anchor. Sending every fingerprint to all anchors within 2 (33 of
them, or 2) therefore brings every linked pair together; sending it as far as radius + d would
only add copies (about 680) that meet the same pairs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import bounded_batches, drop_table, without_old_exchanges, write_table

SHINGLE = 3
SEED = 42
DISTANCE = 2


def _shingles(data: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of words in the text's bytes, A-Z lowered."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends - 1).tolist()[size - 1 :])), np.uint64, len(words) - size + 1)


def _majority(h: np.ndarray) -> np.ndarray:
    """For each column of hashes the fingerprint: a bit is set if it is in over half of the rows; no rows: 0."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 1 << 13):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 13)]).view(np.uint8), axis=1, bitorder="little")
        # eight bits' counters side by side in a word; 255 rows can't overflow one
        part = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        ones += part.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return int(_majority(_shingles((text or "").encode(), size)[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(id, fp)``: signed 64-bit fingerprint of each whole text; null or wordless text: 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_majority(_shingles(v.as_py() or b"", size)[:, None])[0] for v in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("data")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _syndrome(fp, bits: int = 64):
    """XOR of the positions of the set bits: one parity per bit of a position."""
    out = F.lit(0)
    for j in range((bits - 1).bit_length()):
        mask = _signed(sum(1 << p for p in range(bits) if p >> j & 1))
        out = out + F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask))).bitwiseAND(1), j)
    return out


def anchors(df: DataFrame, fp: str = "fp", bits: int = 64) -> DataFrame:
    """``df`` with one row per anchor within radius + distance/2 of its fingerprint: column ``anchor``."""
    v = F.col(fp)
    # flip masks by syndrome: bit s alone, or any two bits whose positions XOR to s; for 0, nothing or bit 0
    flips = [[0, 1]] + [[_signed(1 << s)] + [_signed(1 << i | 1 << (i ^ s)) for i in range(bits) if i < i ^ s] for s in range(1, bits)]
    table = F.array(*(F.array(*(F.lit(m).cast("long") for m in own)) for own in flips))
    return df.withColumn("anchor", F.explode(F.get(table, _syndrome(v, bits)))).withColumn("anchor", v.bitwiseXOR(F.col("anchor")))


def _forest(values: list[int], distance: int) -> list[tuple[int, int]]:
    """Links that join what is within ``distance`` among a few values: a spanning forest, not all pairs."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(values)):
        for j in range(i):
            if (a := find(i)) != (b := find(j)) and ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= distance:
                root[max(a, b)] = min(a, b)
                out.append((values[j], values[i]))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that join all that are within ``distance``.

    An anchor's group holds distinct fingerprints within 2 bits of it, so 2081 at most whatever the
    input; each group gives a spanning forest of its own links.
    """
    if distance > DISTANCE:
        raise ValueError("the code's radius covers distances up to 2")
    held = anchors(distinct).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [e for v in b.column(0).to_pylist() for e in _forest(sorted(v), distance)]
            a, c = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return held.select("fps").mapInArrow(run, "a bigint, b bigint").distinct()


def _contract(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: in each partition every node links to the smallest one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root.setdefault(u, u)
                root.setdefault(v, v)
                x, y = find(u), find(v)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        for at in range(0, len(nodes), 100_000):
            own = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], ["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint").filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: smallest node reachable, for all nodes of ``edges(a, b)``.

    Alternating large-star and small-star rounds over what each partition leaves of its edges; each round's
    edges are a written table, and the loop ends when a round changes nothing. Grouping only takes minima, so a
    node of many links is combined before the exchange.
    """
    e = write_table(_contract(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours, and the node, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        before, e = e, write_table(small, "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_table(before)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(id, fp, component)``: each row's fingerprint and the smallest id reachable over links of
    ``distance`` bits or fewer, itself included.

    Equal fingerprints are one class, linked by their smallest id; only classes are compared. Null and
    wordless texts share fingerprint zero and link like any other. Repeated rows stay repeated. A null
    id joins a component but never names one (its own is null if no other id is there). Only the two
    named columns are read; an empty table gives no rows.
    """
    fps = write_table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    comp = components(links(classes.select("fp"), distance))
    known = classes.join(comp, classes.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = known.groupBy("root").agg(F.min("low").alias("component"))
    named = known.join(lows, "root").select(F.col("fp").alias("c_fp"), "component")
    return fps.join(named, F.col("fp") == F.col("c_fp")).select(F.col("id").alias(id_col), "fp", "component")


# --- similarity of 0.8 or more on five-word shingles -----------------------------------------------

WORDS = 10  # 64-bit words of a sketch, each two 32-bit fingerprints
SIMILAR = 0.8
TURNS = (4, 16)  # how many of the 32-bit fingerprints are compared at a time
BLOCK, BLOCK_BYTES = 1024, 4 << 20  # rows of a crowded anchor or group that meet others in one unit of work, and bytes of what they are compared by
FAR = 12  # of 32 further bits: rows that differ in more meet by chance (at 0.8 five differ, two more or less; unlike rows: 16)
LENIENT = 0.1  # three standard errors of the sketches' estimate at 0.8; shingles decide what passes


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """64-bit hashes of a text's distinct shingles of ``size`` words, A-Z lowered, in order (fewer words: all of them as one)."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(size, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(found: np.ndarray) -> list[int]:
    """``WORDS`` independent fingerprints of a set of shingles, as signed integers."""
    with np.errstate(over="ignore"):
        x = found[:, None] + np.array([(0x9E3779B97F4A7C15 * (i + 1)) & ((1 << 64) - 1) for i in range(WORDS)], np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return _majority(x ^ x >> np.uint64(31)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sets have that Jaccard similarity; two empty ones do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a).clip(max=max(0, len(b) - 1))
    both = int((b[at] == a).sum()) if len(b) else 0
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _like_sketches(limit: int) -> Callable:
    """For a unit's rows: which of ``others`` have sketches within ``limit`` bits of row ``i``."""

    def prepare(held: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sks = np.frombuffer(b"".join(held), np.uint64).reshape(-1, WORDS)
        return lambda i, others: others[np.bitwise_count(sks[others] ^ sks[i]).sum(1, dtype=np.int64) <= limit]

    return prepare


def _like_sets(least: float) -> Callable:
    """For a unit's rows: which of ``others`` have sets of similarity ``least`` or more with row ``i``."""

    def prepare(held: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        size = np.array([len(x) // 8 for x in held])
        item = np.unique(np.frombuffer(b"".join(held), np.uint64), return_inverse=True)[1]
        begin = np.cumsum(size) - size
        flag = np.zeros(len(item) + 1, bool)

        def hits(i: int, others: np.ndarray) -> np.ndarray:
            near = others[np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i])]
            if not len(near) or not size[i]:
                return near  # empty sets are alike
            own = item[begin[i] : begin[i] + size[i]]
            flag[own] = True
            n = size[near]
            at = np.repeat(begin[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(flag[item[at]].astype(np.int64), np.cumsum(n) - n)
            flag[own] = False
            return near[both >= least * (n + size[i] - both) - 1e-9]

        return hits

    return prepare


def _cross_links(rows: DataFrame, payload: DataFrame, prepare: Callable) -> DataFrame:
    """``(a, b)``: links that join, at each spot, all of ``rows(spot, node, root, main, bytes)`` that are alike by what ``payload(node, value)`` has of them.

    Rows of one root are joined already, and so are those with ``main`` set; every other pair of a spot is
    compared. A spot's rows fall into blocks of some ``BLOCK``, the ``main`` ones into blocks of their own, and a
    unit of work is two blocks, so what a task holds doesn't grow with the spot.
    """
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy(F.col("spot").alias("at")).agg(blocks(~F.col("main")).alias("n"), blocks(F.col("main")).alias("n_main"))
    rows = rows.join(sizes, F.col("spot") == F.col("at"))
    own = F.when(F.col("main"), F.col("n") + F.pmod(F.xxhash64("node"), "n_main")).otherwise(F.pmod(F.xxhash64("node"), "n")).cast("int")
    rows = rows.withColumn("k", own)
    # a block meets every other one, but no two of main; units of two hold the pairs inside a block as well
    met = F.when(F.col("main"), F.sequence(F.lit(0), F.col("n") - 1)).when(F.col("n") + F.col("n_main") == 1, F.array("k")).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") + F.col("n_main") - 1), lambda x: x != F.col("k")))
    rows = rows.withColumn("m", F.explode(met)).select("spot", F.least("k", "m").alias("k"), F.greatest("k", "m").alias("m"), "node", "root", "main")
    rows = rows.join(payload, "node").select("spot", "k", "m", "node", "root", "main", "value")

    def solve(held: list[tuple]) -> list[tuple]:
        names: dict = {}
        label = np.array([names.setdefault(r[1], len(names)) for r in held])
        main = np.array([r[2] for r in held])
        label[main] = label[main].min(initial=len(names))
        hits = prepare([r[3] for r in held])
        out = []
        for i in np.flatnonzero(~main):
            apart = np.flatnonzero(label != label[i])
            for j in hits(i, apart) if len(apart) else ():
                if label[j] != label[i]:
                    out.append((held[i][0], held[j][0]))
                    label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            x, y = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for b in batches:
            out = []
            for *at, node, root, main, value in zip(*(c.to_pylist() for c in b.columns)):
                if at != unit:
                    out += solve(held) if len(held) > 1 else []
                    unit, held = at, []
                held.append((node, root, main, value))
            yield batch(out)
        if len(held) > 1:
            yield batch(solve(held))

    return rows.repartition("spot", "k", "m").sortWithinPartitions("spot", "k", "m", "node").mapInArrow(run, "a bigint, b bigint")


def _rooted(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``nodes`` with the root of each, a node without links being its own."""
    if comp is None:
        return nodes.withColumn("root", F.col("node"))
    comp = comp.select(F.col("node").alias("of"), F.col("root").alias("its"))
    return nodes.join(comp, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("its", "node")).drop("of", "its")


def _left_open(meets: DataFrame, compared: DataFrame) -> DataFrame:
    """``(spot, node, root, main, bytes)``: of ``meets(spot, node, root, n, head, main, far)`` the rows at spots where, after ``compared(a, b, alike, spots)``,
    some row isn't joined to the smallest, and others stand beside it. Only these rows are looked up: where all are alike, as in a group of copies, none is."""
    here = W.partitionBy("spot")
    unsettled = meets.filter("far AND NOT main AND n > 2").select("spot").union(compared.filter("NOT alike").select(F.explode("spots").alias("spot"))).distinct()
    like = compared.filter("alike").select("a", "b", F.lit(True).alias("like"))
    rest = meets.filter("n > 2").join(unsettled, "spot", "left_semi").join(like, (F.col("node") == F.col("a")) & (F.col("head") == F.col("b")), "left")
    rest = rest.select("spot", "node", "root", (F.col("main") | F.col("like").isNotNull()).alias("main"))
    return rest.select("*", F.min("main").over(here).alias("settled")).filter("NOT settled").select("spot", "node", "root", "main", F.lit(8 * WORDS).alias("bytes"))


def _candidates(classes: DataFrame, similarity: float) -> DataFrame | None:
    """``(node, root)`` over pairs of ``classes(node, sk)`` that meet at an anchor and whose sketches are alike, with leniency."""
    low, high = (lambda w: w.bitwiseAND(0xFFFFFFFF)), (lambda w: F.shiftrightunsigned(w, 32))
    other = lambda i: F.element_at("sk", F.pmod(i + 3, F.lit(WORDS)) + 1)  # noqa: E731  bits that this print doesn't have
    pair = lambda w, i: F.array(*(F.struct((2 * i + k).alias("t"), half(w).alias("fp"), half(other(i)).alias("check")) for k, half in enumerate((low, high))))
    halves = F.flatten(F.transform("sk", pair))
    # the cosine of the angle and the similarity s of sets: 2s / (1 + s)
    least = similarity - LENIENT
    limit = int(64 * WORDS * np.arccos(2 * least / (1 + least)) / np.pi)
    a, b = classes.select(F.col("node").alias("a"), F.col("sk").alias("sa")), classes.select(F.col("node").alias("b"), F.col("sk").alias("sb"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    little = lambda w: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(w, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8))))
    packed = classes.select("node", F.concat(*(little(F.col("sk")[i]) for i in range(WORDS))).alias("value"))
    comp, first = None, 1
    for many in TURNS:
        prints = _rooted(classes, comp).select("node", "root", F.explode(F.slice(halves, first, many)).alias("x")).select("node", "root", "x.t", "x.fp", F.shiftright(F.shiftleft("x.check", 32), 32).cast("int").alias("check"))
        first += many
        at = anchors(prints, bits=32).select("node", "root", "check", (F.col("anchor") + F.shiftleft(F.col("t").cast("long"), 32)).alias("spot"))
        # each spot is one of some hundred copies of a row, so a hot group's spots are small beside a task
        here = W.partitionBy("spot")
        head = F.min(F.struct("node", "root", "check")).over(here)
        at = at.select("spot", "node", "root", "check", head.alias("head"), (F.min("root").over(here) < F.max("root").over(here)).alias("mixed"), F.count("*").over(here).alias("n"))
        far = (F.bit_count(F.col("check").bitwiseXOR(F.col("head.check")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) > FAR).alias("far")
        meets = at.filter("mixed AND node <> head.node").select("spot", "node", "root", "n", F.col("head.node").alias("head"), (F.col("root") == F.col("head.root")).alias("main"), far)
        meets = write_table(meets.filter("NOT (n = 2 AND far)"), "meets")  # two rows that met by chance
        # a pair carries the spots where others stand beside it, so those of pairs that aren't alike come from the pairs and not from a look-up of every row
        pairs = meets.filter("NOT main AND NOT far").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.collect_list(F.when(F.col("n") > 2, F.col("spot"))).alias("spots"))
        compared = pairs.join(a, "a").join(b, "b").withColumn("alike", differ <= limit)
        compared = write_table(compared.select("a", "b", "alike", F.when(~F.col("alike"), F.col("spots")).alias("spots")), "compared")
        edges = compared.filter("alike").select("a", "b").union(_cross_links(_left_open(meets, compared), packed, _like_sketches(limit)))
        comp = components(edges if comp is None else edges.union(comp))
        drop_table(meets)
        drop_table(compared)
    return comp


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(id, digest, sk, print)`` and their classes ``(node, sk, print, low, low_digest, root)``: rows of equal sets are one
    class, and classes of one root are a group."""
    bounded_batches(docs.sparkSession)
    typed = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    own = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(data)).alias("digest"), data.alias("data"))

    def fingers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(v.as_py(), size) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sketch(x) for x in sets], pa.list_(pa.int64())), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())], ["id", "digest", "sk", "print"])

    rows = write_table(own.mapInArrow(fingers, f"id {typed}, digest binary, sk array<bigint>, print binary"), "sketches")
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("low")
    classes = rows.groupBy("print").agg(lowest, F.min("sk").alias("sk"))
    classes = write_table(classes.select(F.monotonically_increasing_id().alias("node"), "print", "sk", F.col("low.id").alias("low"), F.col("low.digest").alias("low_digest")), "classes")
    comp = _candidates(classes, similarity)
    # what passed the sketches is held against whole sets: first every row of a group with the group's smallest
    met = _rooted(classes, comp)
    wide = met.groupBy("root").count().filter("count > 1").select(F.col("root").alias("group"))
    met = met.join(wide, F.col("root") == F.col("group")).select("group", "node", F.col("low").alias("m_id"), F.col("low_digest").alias("m_digest"))
    texts = own.join(met, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest"))).select("group", "node", "data")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(v.as_py(), size).tobytes() for v in b.column(2)], pa.binary())], ["group", "node", "value"])

    # rows that repeat id and text give the same set more than once; one stays
    sets = texts.mapInArrow(to_sets, "group bigint, node bigint, value binary").groupBy("node").agg(F.min("group").alias("group"), F.min("value").alias("value"))
    sets = write_table(sets, "sets")

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (2, 3))
            alike = [similar(p, q, similarity) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_()), pa.array([8 * len(p) for p in x], pa.int32())], ["spot", "node", "main", "bytes"])

    head = sets.filter("group = node").select(F.col("group").alias("h"), F.col("value").alias("head"))
    held = sets.join(head, F.col("group") == F.col("h")).select("group", "node", "value", "head").mapInArrow(with_head, "spot bigint, node bigint, main boolean, bytes int")
    held = write_table(held, "held")
    open_groups = held.groupBy("spot").agg(F.count("*").alias("n"), F.min("main").alias("all")).filter("n > 2 AND NOT all").select(F.col("spot").alias("o"))
    rest = held.join(open_groups, F.col("spot") == F.col("o")).select("spot", "node", F.col("node").alias("root"), "main", "bytes")
    edges = held.filter("main").select(F.col("node").alias("a"), F.col("spot").alias("b")).union(_cross_links(rest, sets.select("node", "value"), _like_sets(similarity)))
    return rows, _rooted(classes, components(edges))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """``(id, component)``: smallest id reachable over pairs whose sets of five-word shingles have a Jaccard similarity
    of ``similarity`` or more, for all rows.

    At 0.8, 64 bits differ in 10 places, beyond any code's reach, so a sketch of 640 bits is cut into 20
    fingerprints of 32 bits: at 0.8 each is within 2 bits with probability 0.12, some one of the 20 with 0.92
    (0.85: 0.99). Equal sets are one before; each fingerprint goes to its anchors. There, every row is
    compared by whole sketches with the anchor's smallest, which settles groups of copies of any size.
    Rows unlike that one are then compared with all others of the anchor, those like it too, so every pair
    that meets is compared or joined by others. The fingerprints take turns: rows of one group by then
    are not compared again. The sketches are lenient; within the groups they give, the shingles themselves
    decide, again first with the smallest and then, in blocks, whatever that leaves open.

    Null and wordless texts have the empty set, and are alike. Repeated rows stay repeated. A null id joins a
    group but never names one (its own is null if no other id is there). An empty table gives no rows;
    only the two named columns are read.
    """
    with without_old_exchanges(docs.sparkSession):
        rows, classes = _groups(docs, id_col, text_col, size, similarity)
    lows = classes.groupBy("root").agg(F.min("low").alias("component"))
    named = classes.join(lows, "root").select(F.col("print").alias("c_print"), "component")
    return rows.join(named, F.col("print") == F.col("c_print")).select(F.col("id").alias(id_col), "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``similar_groups`` the one with the smallest id.

    Of rows that repeat that id, the one whose text's digest is smallest; of rows that repeat both, one.
    A null id stays only where its group has no other. All columns return, whatever their names.
    """
    with without_old_exchanges(docs.sparkSession):
        _, classes = _groups(docs, id_col, text_col, size, similarity)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "low_digest")).alias("x")
    kept = classes.groupBy("root").agg(first).select(F.col("x.low").alias("__k_id"), F.col("x.low_digest").alias("__k_digest"))
    digest = F.unhex(F.md5(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))))
    own = docs.withColumn("__digest", digest).join(kept, F.col(id_col).eqNullSafe(F.col("__k_id")) & (F.col("__digest") == F.col("__k_digest")), "left_semi")
    return own.dropDuplicates([id_col, "__digest"]).drop("__digest")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
