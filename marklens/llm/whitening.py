"""Whitening of embeddings by principal components, found by spectral divide and conquer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

EPS = float(np.finfo(float).eps)
SCALE, SHIFT, LARGEST = 1024, 100_000, (1 << 62) - 1


# --- eigenvectors -------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvalues' signs on its eigenvectors.

    Dynamically weighted Halley iteration: by QR while the weights are large, by Cholesky after. Cubic; six or seven steps for any
    condition number that doubles can tell.
    """
    m = len(a)
    one, x, low = np.eye(m), a / (np.linalg.norm(a) or 1.0), EPS
    for _ in range(30):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:m] @ q[m:].T)
        else:
            low_factor = np.linalg.cholesky(one + wc * (x.T @ x))
            half = np.linalg.solve(low_factor, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(low_factor.T, half).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        if moved <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces with eigenvalues above and below ``shift``, or None if the projector doesn't tell them apart."""
    m = len(a)
    above = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < m:
        return None
    start = np.linalg.qr(rng.standard_normal((m, m)))[0]
    for _ in range(2):
        start, _ = np.linalg.qr(np.hstack([above @ start[:, :k], start[:, k:] - above @ start[:, k:]]))
    up, down = start[:, :k], start[:, k:]
    return (up, down) if np.linalg.norm(down.T @ a @ up) <= 64 * m * EPS * np.linalg.norm(a) else None


def components(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Polar factors of shifted matrices give projectors onto invariant subspaces, which are divided in turn; lower ones only while
    more components are wanted. Eigenvalues that doubles can't tell apart share a subspace, of which any basis will do.
    """
    most, rng, scale = len(a) if most is None else min(most, len(a)), np.random.default_rng(0), np.linalg.norm(a)

    found: list[tuple[float, np.ndarray]] = []
    todo = [(a, np.eye(len(a)))] if len(a) else []
    while todo and len(found) < most:
        own, basis = todo.pop()
        m, diag = len(own), np.diag(own)
        parts = None
        if m > 1 and np.linalg.norm(own - diag.mean() * np.eye(m)) > 8 * EPS * scale:
            spread = max(float(diag.std()), EPS * scale)
            shifts = [float(np.median(diag)), float(diag.mean()), *(float(diag.mean()) + s * spread for s in (0.5, -0.5, 0.25, -0.25, 1e-3, -1e-3))]
            parts = next((p for s in shifts if (p := split(own, s, rng)) is not None), None)
        if parts is None:
            found += sorted(((float(diag[i]), basis[:, i]) for i in range(m)), key=lambda x: -x[0])
            continue
        for side in reversed(parts):  # the upper one comes off the stack first
            low = side.T @ own @ side
            todo.append(((low + low.T) / 2, basis @ side))
    found = [(float(v @ a @ v), v) for _, v in found]
    found.sort(key=lambda x: -x[0])
    found = found[:most]
    return np.array([e for e, _ in found]), np.array([v for _, v in found]).reshape(-1, len(a)).T


# --- Spark --------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted transform: counts and exact sums, components (columns) with their eigenvalues, and how far the fit list's
    whitened covariance is from the identity. A few vectors' size, so it travels with the tasks."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def over(self) -> np.ndarray:
        """What the mean is over the whole-number centre; 0 to 1."""
        return np.array([s % self.n / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(float) - self.over) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2, exact; None where it doesn't fit a long. Whole numbers wrap, so sums that fit come out right."""
        rest = np.array([s % self.n for s in self.sums], np.int64)
        with np.errstate(over="ignore"):
            total = ((np.int64(self.n) * (x - self.centre) - rest) ** 2).sum(1)
        about = (((x - self.centre).astype(float) - self.over) ** 2).sum(1) * float(self.n) ** 2
        out = [int(t) if a < 9e18 else None for t, a in zip(total, about)]
        for i in np.flatnonzero((about >= 9e18) & (about < 9.5e18)):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = exact if exact < 1 << 63 else None
        return out


def whole_numbers(column: pa.Array, dims: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector among the rows that stay: not null, not empty, all entries finite."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.cumsum(lengths) - lengths
    bad = np.bincount(np.repeat(np.arange(len(lengths)), lengths), ~np.isfinite(values), len(lengths))
    out = []
    for d in np.unique(lengths[(lengths > 0) & (bad == 0)]):
        rows = np.flatnonzero((lengths == d) & (bad == 0))
        if dims not in (None, d):
            raise ValueError(f"vectors of {d} and of {dims} entries")
        x = np.clip(np.floor(SCALE * values[first[rows][:, None] + np.arange(d)]) + SHIFT, -float(LARGEST), float(LARGEST))
        out.append((rows, x.astype(np.int64)))
    return out


def _matrices(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[np.ndarray]:
    for b in batches:
        for _, x in whole_numbers(b.column(0), dims):
            yield x


def _vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    return vectors.select(F.col(vector_col).cast("array<double>").alias("v"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, i, n, s) of a partition; sums in two halves, so none overflows."""
    total: dict[int, tuple[int, list[int]]] = {}
    for x in _matrices(batches):
        n, s = total.get(x.shape[1], (0, [0] * x.shape[1]))
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        total[x.shape[1]] = n + len(x), [a + (int(h) << 32) + int(w) for a, h, w in zip(s, high, low)]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(range(d)), pa.array([n] * d), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], ["d", "i", "n", "s"])


def _pairs(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(matrix[i, j])], ["i", "j", "v"])


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix of summed (i, j, v): size * (size + 1) / 2 rows come to the driver, whatever the table's size."""
    out = np.zeros((size, size))
    for i, j, v in rows.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int | None = None) -> Whitening | None:
    """Fit on all vectors: exact sums, a covariance centred before multiplying, its ``most`` leading components by
    spectral divide and conquer, and the whitened covariance, measured in a pass of its own.

    Entry c counts as floor(1024 c) + 100000 (beyond 2 ** 62 as that). Left out: null vectors, empty ones and those with a null or
    non-finite entry. None where no vector is left. Components whose eigenvalue is zero to rounding are left out, as they can't be
    whitened. Repeated rows count each. Vectors of differing lengths raise ValueError. The driver gets sums of d and d * d numbers.
    """
    bounded_batches(vectors.sparkSession, 4000)
    own = _vectors(vectors, vector_col)
    got = own.mapInArrow(_sums, "d bigint, i bigint, n bigint, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "i").collect()
    if not got:
        return None
    dims, n, sums = got[0].d, got[0].n, [int(r.s) for r in got]
    if got[-1].d != dims:
        raise ValueError(f"vectors of {dims} and of {got[-1].d} entries")
    model = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    centre = model.centre

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for x in _matrices(batches, dims):
            d = (x - centre).astype(float)
            total += d.T @ d  # whole numbers: exact below 2 ** 53
        yield _pairs(total)

    covariance = _collected(own.mapInArrow(products, "i bigint, j bigint, v double"), dims) / n - np.outer(model.over, model.over)
    model.trace = float(np.trace(covariance))
    values, vectors_ = components(covariance, most)
    keep = values > 4 * dims * EPS * model.trace
    model.eigenvalues, model.components = values[keep], vectors_[:, keep]
    k = int(keep.sum())
    if not k:
        return model

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k + 1, k + 1)), np.zeros(k)
        for x in _matrices(batches, dims):
            w = model.apply(x)
            mean = w.mean(0)
            total[:k, :k] += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
            first += w.sum(0)
        total[:k, k] = total[k, :k] = first
        yield _pairs(total)

    got = _collected(own.mapInArrow(whitened, "i bigint, j bigint, v double"), k + 1)
    mean = got[:k, k] / n
    model.identity_error = float(np.abs(got[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, carry: list[str], vector_col: str = "embedding") -> DataFrame:
    """The ``carry`` columns, ``whitened array<double>`` (an entry per component) and ``deviation`` (the sum over dimensions of (n x - S) ** 2,
    null where a long can't hold it), of each row whose vector ``fit`` counts. Other columns may have any names."""
    bounded_batches(vectors.sparkSession, 4000)
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in whole_numbers(b.column(b.num_columns - 1), dims):
                w = model.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                kept = [c.take(pa.array(rows)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(model.deviation(x), pa.int64())], [*carry, "whitened", "deviation"])

    own = vectors.select(*carry, F.col(vector_col).cast("array<double>").alias("__v"))
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"{kinds}, whitened array<double>, deviation bigint")


COMPONENTS = 8


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors, most=COMPONENTS)
    if model is None or not len(model.eigenvalues):
        model = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 1.0)
        vectors = vectors.limit(0)
    rows = whiten(vectors, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)) if len(model.eigenvalues) else F.array(F.lit(0.0))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
