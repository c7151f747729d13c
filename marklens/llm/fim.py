"""Fill-in-middle: texts cut at token boundaries that a compressed set of positions selects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 20  # bytes of a text that are looked at together
FULL = 1 << 16  # values of a container


class ArrayContainer:
    """Few values: their low 16 bits in order."""

    def __init__(self, low: np.ndarray):
        self.values = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """Many scattered values: a bit for each of 65,536, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(FULL, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        rest = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            rest &= rest - 1
        return 64 * word + (rest & -rest).bit_length() - 1


class RunContainer:
    """Values in runs: each run's first value, with the number of values before it."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts, self.before = low[first].astype(np.uint16), first.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for these low 16 bits, in rising order."""
    runs = int((np.diff(low) != 1).sum()) + 1
    size, kind = min((2 * len(low), 0), (FULL // 8, 1), (4 * runs, 2))
    return (ArrayContainer, BitmapContainer, RunContainer)[kind](low)


class BoundarySet:
    """A set of positions as containers by their high bits, with cumulative cardinalities.

    ``select(k)`` finds the container by binary search over the cardinalities and asks it for the rest.
    """

    def __init__(self, parts: Iterable[np.ndarray]):
        self.highs: list[int] = []
        self.boxes: list = []
        self.before = [0]
        rest = np.empty(0, np.int64)
        for part in parts:
            rest = np.concatenate([rest, part])
            if len(rest) and rest[0] >> 16 != rest[-1] >> 16:  # only the last container may still grow
                cut = int(np.searchsorted(rest, rest[-1] >> 16 << 16))
                self._add(rest[:cut])
                rest = rest[cut:]
        self._add(rest)
        self.cumulative = np.array(self.before)

    def _add(self, positions: np.ndarray) -> None:
        high = positions >> 16
        for own in np.split(positions, np.flatnonzero(np.diff(high)) + 1):
            if len(own):
                self.highs.append(int(own[0] >> 16))
                self.boxes.append(container(own & 0xFFFF))
                self.before.append(self.before[-1] + len(own))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The position with k smaller ones."""
        at = int(np.searchsorted(self.cumulative, k, "right")) - 1
        return (self.highs[at] << 16) + self.boxes[at].select(k - self.before[at])


def word_ends(text: np.ndarray) -> Iterator[np.ndarray]:
    """Where tokens end, in code points, of UTF-8 bytes: a token is a word with the white space before it; white space at
    the end of the text is one too. Taken a ``CHUNK`` at a time."""
    seen = 0
    for a in range(0, len(text), CHUNK):
        own = text[a : a + CHUNK + 1]  # one byte more tells whether the last word goes on
        space = (own == 32) | ((own >= 9) & (own <= 13))
        if a + CHUNK >= len(text):
            space = np.append(space, True)
        here = min(CHUNK, len(text) - a)
        points = np.cumsum((own[:here] & 0xC0) != 0x80) + seen
        ends = points[~space[:here] & space[1 : here + 1]]
        seen = int(points[-1])
        if a + here == len(text) and space[here - 1]:
            ends = np.append(ends, seen)
        yield ends.astype(np.int64)


def character_ends(text: np.ndarray) -> Iterator[np.ndarray]:
    """Where characters end, in code points."""
    seen = 0
    for a in range(0, len(text), CHUNK):
        n = int(((text[a : a + CHUNK] & 0xC0) != 0x80).sum())
        yield np.arange(seen + 1, seen + n + 1)
        seen += n


UNITS = {"word": word_ends, "character": character_ends}


def cuts(text: Column, first: Column, second: Column, unit: str = "word") -> Column:
    """``struct<n, low, high>``: the number n of units, and the ends, in code points, of the first ``first % (n + 1)`` and
    ``second % (n + 1)`` units, the smaller first. Null text: empty, so all are 0."""
    ends = UNITS[unit]

    @F.arrow_udf("struct<n: bigint, low: bigint, high: bigint>")
    def find(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(text, first.to_pylist(), second.to_pylist()):
            data = t.as_buffer()
            found = BoundarySet(ends(np.frombuffer(data, np.uint8)) if data is not None else ())
            n = len(found)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out.append((n, found.select(low - 1) if low else 0, found.select(high - 1) if high else 0))
        kind = pa.int64()
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], kind) for i in range(3)], ["n", "low", "high"])

    return find(F.coalesce(text, F.lit("")), first, second)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "word") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)``: each whole text, ``rate`` of 100 of them in fill-in-middle order.

    All draws come from the sha256 of key and id, so every attempt of a task gives the same rows: two cuts among the text's n units,
    whether it stays ``plain``, and else whether suffix (``spm``) or prefix (``psm``) comes first. Empty or null texts and those that
    hold a marker stay plain; their output is the text, empty for null. A null id draws as the empty string. Repeated rows come
    out alike; an empty table gives no rows. Only the two named columns are read, so other columns may have any names.
    """
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *(h.alias(f"__h{i}") for i, h in enumerate(draw, 1)))
    at = own.withColumn("__at", cuts(F.col("__text"), F.col("__h1"), F.col("__h2"), unit))
    low, high = F.col("__at.low").cast("int"), F.col("__at.high").cast("int")
    prefix, middle, suffix = F.substring("__text", F.lit(1), low), F.substring("__text", low + 1, high - low), F.substring("__text", high + 1, F.length("__text"))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("__text", F.lit(m))
    plain = (F.length("__text") == 0) | marked | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm")
    output = (
        F.when(F.col("form") == "plain", F.col("__text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    out = at.withColumn("form", form)
    return out.select(id_col, F.col("__at.n").alias("n"), "form", F.when(cut, F.col("__at.low")).alias("prefix_chars"), F.when(cut, F.col("__at.high") - F.col("__at.low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of ``transform``. Each marker is there once, as texts that hold one stay plain."""
    part = lambda mark, end: F.split_part(F.split_part(output, F.lit(mark), F.lit(2)), F.lit(end), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
    ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
  FROM docs
), cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
