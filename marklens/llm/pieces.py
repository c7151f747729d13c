"""SentencePiece BPE by vectorised merge rounds, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

SPACE = "▁"
_NONE = np.int64(1) << 40
_MODELS: dict = {}


class PieceModel:
    """Tables of a BPE piece model with byte fallback, the identity normaliser and the added leading space.

    Encoding needs no priority queue: the symbols of many distinct words lie in flat arrays, and every
    round merges, in each word, all leftmost places of that word's best-ranked pair.
    """

    CACHE_BYTES = 64 << 20  # of words and their ids kept from batch to batch, with some 150 bytes each for the table
    CACHED_WORD = 64  # characters of the longest word that is kept

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(SPACE in p.strip(SPACE) or (p[-1] == SPACE and p.strip(SPACE)) for p in plain):
            raise ValueError("a piece has a space inside, so words aren't independent")
        if sp.normalize("Ａ  b") != f"{SPACE}Ａ{SPACE}{SPACE}b" or len(self.byte) != 256:
            raise ValueError("the model normalises its input or has no byte fallback")
        self.space = plain[SPACE]
        self.runs = {len(p): i for p, i in plain.items() if not p.strip(SPACE)}
        self.chars = np.full(0x110000, -1, np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        pairs = {}
        for p, i in plain.items():
            if p.strip(SPACE):
                for k in range(1, len(p)):
                    a, b = plain.get(p[:k]), plain.get(p[k:])
                    if a is not None and b is not None:
                        pairs[a << 21 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], np.int64)
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = -score[self.made].astype(np.int64)
        self.made, self.rank = np.append(self.made, 0), np.append(self.rank, _NONE)
        self.padded = np.append(self.keys, -1)
        # hash tables: a pair that finds its slot taken goes to the next table
        self.tables, left = [], np.arange(len(self.keys))
        for k in range(64):
            if not len(left):
                break
            multiplier = np.int64(0x9E3779B97F4A7 + 2 * 7919 * k)
            slots = np.full(1 << max(4, (4 * len(left)).bit_length()), len(self.keys), np.int64)
            with np.errstate(over="ignore"):
                slot = ((self.keys[left] * multiplier) >> 20) & (len(slots) - 1)
            slots[slot] = left
            left = left[slots[slot] != left]
            self.tables.append((multiplier, slots))
        if len({float(score[i]) for i in set(pairs.values())}) < len(set(pairs.values())):
            raise ValueError("two pieces of words share a score")
        own = {c for p in plain if len(p) > 1 for c in p}
        self.split = re.compile(f" *[^ \n]+| +|\n" if "\n" not in own else " *[^ ]+| +")
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes in the cache
        self.space_runs: dict[int, bytes] = {}
        surface = [b""] * n
        for p, i in plain.items():
            surface[i] = p.replace(SPACE, " ").encode()
        for v, i in self.byte.items():
            surface[i] = bytes([v])
        surface[self.unk] = " ⁇ ".encode()
        self.blob = np.frombuffer(b"".join(surface), np.uint8)
        self.lens = np.array([len(s) for s in surface], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])

    def _spaces(self, m: int) -> bytes:
        """Ids of m spaces. Space runs share one score, so the leftmost pair with a piece merges each time."""
        if m not in self.space_runs:
            out: list[int] = []
            todo = m
            while todo:
                cur, todo = 1, todo - 1
                while True:
                    if out and out[-1] + cur in self.runs:
                        cur += out.pop()
                    elif todo and cur + 1 in self.runs:
                        cur, todo = cur + 1, todo - 1
                    else:
                        break
                out.append(cur)
            self.space_runs[m] = np.array([self.runs[k] for k in out], "<u4").tobytes()
            if len(self.space_runs) > 10_000:
                return self.space_runs.pop(m)
        return self.space_runs[m]

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Number of the pair that starts at each place; the last number means none."""
        last = len(sym) - 1
        if at is None:
            at = np.arange(last + 1)
        after = np.minimum(at + 1, last)
        key = sym[at] << 21 | sym[after]
        none = len(self.keys)
        out = np.full(len(at), none, np.int64)
        todo = np.flatnonzero((word[at] == word[after]) & (at < last))
        for multiplier, slots in self.tables:
            slot = ((key[todo] * multiplier) >> 20) & (len(slots) - 1)
            own = slots[slot]
            hit = self.padded[own] == key[todo]
            out[todo[hit]] = own[hit]
            todo = todo[~hit & (own < none)]
        return out

    def _merge(self, words: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Final symbols in word order with their words, and the words whose rounds may differ from one merge at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.chars[codes]
        sym = np.where(sym < 0, self.n + codes, sym)
        word = np.repeat(np.arange(len(words)), sizes)
        floor = np.full(len(words), -1, np.int64)
        many = np.zeros(len(words), bool)
        unsure = np.zeros(len(words), bool)
        done_w, done_s = [], []
        pair = self._pairs(sym, word)
        while len(sym):
            rank = self.rank[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            live = best < _NONE
            owner = word[first]
            unsure[owner[live & many[owner] & (best < floor[owner])]] = not single
            floor[owner] = best
            if not live.all():  # finished words leave the arrays
                keep = np.repeat(live, count)
                done_w.append(word[~keep])
                done_s.append(sym[~keep])
                sym, word, pair, rank = sym[keep], word[keep], pair[keep], rank[keep]
                best, count = best[live], count[live]
            where = np.flatnonzero(rank == np.repeat(best, count))
            if not len(where):
                break
            if single:
                where = where[np.append(True, word[where[1:]] != word[where[:-1]])]
            else:  # of overlapping places, every other one from the left
                run = np.append(True, (where[1:] != where[:-1] + 1) | (word[where[1:]] != word[where[:-1]]))
                head = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - head) % 2 == 0]
            many[:] = np.bincount(word[where], minlength=len(words)) > 1
            sym[where] = self.made[pair[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word, pair = sym[keep], word[keep], pair[keep]
            at = where - np.arange(len(where))  # places of the merged symbols now
            pair[at] = self._pairs(sym, word, at)
            at = at[at > 0] - 1
            pair[at] = self._pairs(sym, word, at)
        if done_w:
            w, s = np.concatenate(done_w), np.concatenate(done_s)
            order = np.argsort(w, kind="stable")
            w, s = w[order], s[order]
        else:
            w = s = np.empty(0, np.int64)
        return w, s, np.flatnonzero(unsure).tolist()

    def _bytes(self, words: list[str], single: bool = False) -> list[bytes]:
        """Ids of each word, which has one leading space mark at most, as little-endian 32-bit."""
        w, s, unsure = self._merge(words, single)
        if (far := np.flatnonzero(s >= self.n)).size:  # characters without a piece become their bytes
            spelled = [[self.byte[v] for v in chr(x - self.n).encode()] for x in s[far].tolist()]
            size = np.ones(len(s), np.int64)
            size[far] = list(map(len, spelled))
            at = np.repeat(s < self.n, size)
            full = np.empty(len(at), np.int64)
            full[at] = s[s < self.n]
            full[~at] = [v for own in spelled for v in own]
            w, s = np.repeat(w, size), full
        data = s.astype("<u4").tobytes()
        ends = (np.searchsorted(w, np.arange(len(words)), "right") * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        if unsure:
            for i, again in zip(unsure, self._bytes([words[i] for i in unsure], True)):
                out[i] = again
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        space = np.uint32(self.space).tobytes()
        made = self._bytes([SPACE + w.lstrip(" ") if w[0] == " " else w for w in words])
        out = dict(zip(words, made))
        for w, data in zip(words, made):
            if w[:2] == "  " or w == " ":
                alone = data[:4] == space
                out[w] = self._spaces(len(w) - len(w.lstrip(" ")) - 1 + alone) + data[4 * alone :]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, with begin and end ids, as little-endian 32-bit integers."""
        head, tail = np.uint32(self.bos).tobytes(), np.uint32(self.eos).tobytes()
        units = [self.split.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        known = {u: self.cache.get(u) for own in units for u in own}
        todo = [u for u, ids in known.items() if ids is None]
        for i in range(0, len(todo), 50_000):
            known |= self._learn(todo[i : i + 50_000])
        for u in todo:
            if len(u) <= self.CACHED_WORD:
                size = 150 + 4 * len(u) + len(known[u])
                if self.held + size > self.CACHE_BYTES:
                    self.cache.clear()
                    self.held = 0
                self.cache[u] = known[u]
                self.held += size
        return [b"".join([head, *map(known.__getitem__, own), tail]) for own in units]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids vanish, bytes join to characters, one leading space goes."""
        control = (ids == self.bos) | (ids == self.eos)
        inner = np.flatnonzero(control)
        text, at = "", 0
        for end in [*inner.tolist(), len(ids)]:  # bytes don't join across a control id
            if end > at:
                text += self._decode(ids[at:end], not text and not control[:at].size - control[:at].sum())
            at = end + 1
        return text

    def _decode(self, ids: np.ndarray, first_part: bool) -> str:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        data = self.blob[np.repeat(self.starts[ids] - ends + lens, lens) + np.arange(ends[-1])].tobytes()
        first = int(ids[0])
        if first_part and data[:1] == b" " and first != self.unk and first not in self.byte.values():
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(data):
                for k in (4, 3, 2, 1):
                    try:
                        out.append(data[at : at + k].decode())
                        if len(out[-1]) > 1:
                            out[-1], k = out[-1][0], len(out[-1][0].encode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: ids of each whole text as little-endian 32-bit integers with begin and end ids.

    Null or empty text: begin and end id alone. Repeated rows stay repeated; only the two named columns are read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches:
            ids = m.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids, text)``: ids read back as text; null ids give null, begin and end id alone an empty text. Repeated rows
    stay repeated; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches:
            text = [None if v is None else m.decode(np.frombuffer(v, "<u4")) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], [id_col, "ids", "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, ids binary, text string")


def query(spark, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary_path

    model = vocabulary_path("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
