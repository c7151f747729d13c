"""Toxicity by a factorization machine over the terms of a labelled sample, known by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

FACTORS = 4
MAX_ROWS = 20_000  # labelled rows to fit on at most: the documented bound of the sample
STEPS, EARLY = 2000, 400  # mini-batches to fit on, and those after which it is settled which terms interact
BATCH = 128
SPARSE = 1e-4  # pull of a weight towards zero; chosen by a split of training rows
DECAY = 3e-5  # share by which factors shrink, per unit of their step
OUTLYING = 8  # a term interacts if its factors' norm is so many robust deviations above the median of all terms
PREFIX = 5  # bytes of a word that form a term of their own, for families of forms
MIN_ROWS = 3  # a term enters the machine if so many labelled rows have it, whatever their labels: pairs may matter where a term alone doesn't
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_/\\`~"


def terms(data: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of a whole text's terms: words lowered (A-Z), punctuation at their ends dropped, and
    the starts of longer words, which a space before them keeps apart from words."""
    digest = xxhash.xxh64_intdigest
    found = {w.strip(_STRIP) for w in set(data.lower().split())}
    found.discard(b"")
    found |= {b" " + w[:PREFIX] for w in found if len(w) > PREFIX}
    return np.unique(np.fromiter(map(digest, found), np.uint64, len(found)).view(np.int64))


class FactorizationMachine:
    """logit(x) = bias + sum of weights + pairwise interactions as products of factors; AdaGrad on mini-batches.

    Every term may enter, however little it tells alone. At first all terms have factors, which shrink unless labels bear them out.
    Then those that outgrew the rest stay: they are the ones that interact, and the others' factors are zero. A term counts 1
    in the weights and 1/sqrt(number of interacting terms of its row) in the interactions, so a pair tells as much in a text of
    a thousand words as in a short one. Weights that the labels don't bear out go to zero one by one.
    """

    def __init__(self, hashes: np.ndarray, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hashes = np.unique(hashes).astype(np.int64)
        self.bias = 0.0
        self.weight = np.zeros(len(self.hashes), np.float32)
        self.factor = rng.normal(0, 0.05, (len(self.hashes), factors)).astype(np.float32)

    @property
    def live(self) -> np.ndarray:
        """Which terms interact."""
        return (self.factor != 0).any(1)

    def places(self, found: np.ndarray) -> np.ndarray:
        """Places among the machine's terms of those of ``found`` that are among them."""
        if not len(self.hashes):
            return np.empty(0, np.int32)
        at = np.searchsorted(self.hashes, found).clip(max=len(self.hashes) - 1)
        return at[self.hashes[at] == found].astype(np.int32)

    def _flat(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of all rows, their rows, the rows' starts for reduceat (an empty row gets none), the rows with terms."""
        size = np.array([len(r) for r in rows])
        full = np.flatnonzero(size)
        ids = np.concatenate(rows) if len(full) else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]]) if len(full) else np.empty(0, int)
        return ids, np.repeat(np.arange(len(rows)), size), starts, full

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._forward(*self._flat(rows), len(rows))[0]

    def _forward(self, ids, row, starts, full, n):
        out = np.full(n, self.bias, np.float64)
        if not len(ids):
            return out, None, None, None
        live = self.live[ids]
        scale = (1 / np.sqrt(np.bincount(row[live], minlength=n).clip(1))).astype(np.float32)
        vx = self.factor[ids] * (scale[row] * live)[:, None]
        total = np.zeros((n, vx.shape[1]), np.float32)
        total[full] = np.add.reduceat(vx, starts)
        square = np.zeros(n, np.float32)
        square[full] = np.add.reduceat((vx * vx).sum(1), starts)
        line = np.zeros(n, np.float64)
        line[full] = np.add.reduceat(self.weight[ids], starts)
        return out + line + 0.5 * ((total * total).sum(1) - square), scale, vx, total

    def settle(self) -> None:
        """Leave factors to the terms whose norms stand out; a term that bears on no score leaves."""
        norm = np.linalg.norm(self.factor, axis=1)
        if len(norm):
            middle = np.median(norm)
            self.factor[norm < middle + OUTLYING * 1.4826 * np.median(np.abs(norm - middle))] = 0
        self.prune()

    def prune(self) -> None:
        """Leave out terms that bear on no score."""
        live = (self.weight != 0) | self.live
        self.hashes, self.weight, self.factor = self.hashes[live], self.weight[live], self.factor[live]

    def fit(self, found: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, early: int = EARLY, seed: int = 7) -> FactorizationMachine:
        """Fit on rows of term hashes: whole passes, at least ``early`` mini-batches before and ``steps`` in all after it is settled which interact."""
        rng, per_pass = np.random.default_rng(seed), max(1, -(-len(found) // BATCH))
        for passes, after in ((-(-early // per_pass), self.settle), (max(1, -(-(steps - early) // per_pass)), self.prune)):
            own = [self.places(t) for t in found]
            self._passes(own, labels, passes, rng)
            del own
            after()
        return self

    def _passes(self, rows: list[np.ndarray], labels: np.ndarray, passes: int, rng: np.random.Generator, rate: float = 0.2, rate_factors: float = 0.3) -> None:
        gw, gv, gb = np.full_like(self.weight, 1e-4), np.full_like(self.weight, 1e-4), 1e-4
        for order in (rng.permutation(len(rows)) for _ in range(passes)):
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                ids, row, starts, full = self._flat([rows[i] for i in pick])
                z, scale, vx, total = self._forward(ids, row, starts, full, len(pick))
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[pick]) / len(pick)
                g = float(err.sum())
                gb += g * g
                self.bias -= rate * g / gb**0.5
                if not len(ids):
                    continue
                own, back = np.unique(ids, return_inverse=True)
                e = err[row].astype(np.float32)
                w = np.bincount(back, e, len(own)).astype(np.float32)
                gw[own] += w * w
                step = rate / np.sqrt(gw[own])
                new = self.weight[own] - step * w
                self.weight[own] = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0)
                d = (e * scale[row])[:, None] * (total[row] - vx)
                v = np.stack([np.bincount(back, d[:, k], len(own)) for k in range(d.shape[1])], 1).astype(np.float32)
                gv[own] += (v * v).mean(1)
                step = (rate_factors / np.sqrt(gv[own]))[:, None]
                self.factor[own] = self.live[own][:, None] * (self.factor[own] - step * v) * (1 - np.minimum(step * DECAY, 0.5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on the labelled rows whose crc32(id as text) mod 5 isn't 0: all of them, or the ``max_rows`` first by a
    hash of the id. Executors turn texts to hashed terms; one task fits on the bounded sample, and only its model comes
    to the driver.

    The sample is bounded by rows; a task holds its rows' distinct terms, 8 bytes each. Null labels are left out; of repeated labels the larger counts. Repeated documents count each, null or empty texts as rows without terms.
    Without usable labels every score is 0.27, so nothing counts as toxic. Other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    train = labels.filter(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).select(id_col, label_col)
    train = train.groupBy(F.col(id_col).alias("t_id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("t_id"), "t_id").limit(max_rows)
    # max_rows rows of 12 bytes at most: a proven bound
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(train), F.col("id") == F.col("t_id"))
    own = own.select(F.col("id").cast("string").alias("id"), "label", F.encode("text", "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(v.as_py() or b"").tobytes() for v in b.column(2)], pa.binary())], ["id", "label", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = [np.frombuffer(t, np.int64) for _, _, t in rows]
        flat = np.concatenate([np.empty(0, np.int64), *found])
        flat.sort()
        m = FactorizationMachine(flat[MIN_ROWS - 1 :][flat[MIN_ROWS - 1 :] == flat[: len(flat) - MIN_ROWS + 1]])  # a row has a term once
        del flat
        m.bias = 0.0 if rows else -1.0
        labels = np.array([r[1] for r in rows], np.float64)
        del rows
        m.fit(found, labels)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.hashes, m.weight, m.factor)] + [pa.array([m.bias])], ["hashes", "weight", "factor", "bias"])

    sample = own.mapInArrow(run, "id string, label int, terms binary").repartition(1)
    model, got = FactorizationMachine(np.empty(0, np.int64)), sample.mapInArrow(learn, "hashes binary, weight binary, factor binary, bias double").first()
    if got is not None:
        model.hashes, model.weight, model.bias = np.frombuffer(got.hashes, np.int64), np.frombuffer(got.weight, np.float32), got.bias
        model.factor = np.frombuffer(got.factor, np.float32).reshape(len(model.hashes), -1 if len(model.hashes) else FACTORS)
    return model


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, held_out, score, predicted, *carry)`` of each whole text.

    Null or empty text: the score of no terms. Repeated rows stay repeated. Columns in ``carry`` travel with their row; others
    aren't read, and none but the text bears on a score.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms' hashes and FACTORS + 1 floats each
    names = [f"x{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = m.logits([m.places(terms(v or b"")) for v in b.column(1).cast(pa.binary()).to_pylist()])
            rest = iter(b.columns[2:])
            kept = [b.column(1) if c == text_col else next(rest) for c in carry]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60)))), *kept], ["id", "score", *names])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("data"), *(F.col(f"`{c}`").alias(x) for c, x in zip(carry, names) if c != text_col))
    types = "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry, names))
    out = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double" + types)
    out = out.select("id", (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *names)
    return out.toDF(id_col, "held_out", "score", "predicted", *carry)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
