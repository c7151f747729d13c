"""Fill-in-middle, harmonic packing and whitening against plain versions, with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm import fim, harmonic, registry, tokens, whitening

WORDS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
NAN, INF = float("nan"), float("inf")


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß😀 ") for _ in range(rng.randrange(1, 9)))
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "  \n"]).join(word() for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\r\n"])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x"), (204, "a <P> b"), (205, "< P><S"), (None, "no id at all"), (206, "same row"), (206, "same row")]
    rows += [(207, "<|endoftext|> and more"), (208, "long " * 40_000), (209, "w" * 200_000), (210, "\n" * 3000), (211, "<" * 50 + " <M"), (212, "a b" * 7000 + "　")]
    return rows


TEXTS = _texts()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, 1, "spm", 0, "s") for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, n long, form string, low int, output string").repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 12)) * np.linspace(0.02, 0.5, 12) @ rng.standard_normal((12, 12))
    rows = [(i, v.tolist(), 0, [1.0]) for i, v in enumerate(base)] + [(7, base[7].tolist(), None, None), (None, base[3].tolist(), 0, None)]
    rows += [(900, None, 0, None), (901, [], 0, None), (902, [0.1] * 11 + [None], 0, None), (903, [0.1] * 11 + [NAN], 0, None), (904, [INF] + [0.1] * 11, 0, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation int, whitened array<double>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


# --- fill-in-middle -----------------------------------------------------------------------------


def _fim(doc_id, text, rate=50, pattern=WORDS):
    t = text or ""
    units = pattern.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_op12(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(w := _fim(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in TEXTS]
    got = [tuple(r) for r in registry.queries()["op12_fill_in_middle"](spark, sf_dir).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, pattern", [("word", WORDS), ("character", re.compile(r"(?s)."))])
def test_fim_every_text_and_back(spark, unit, pattern):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("form", F.lit(1))
    out = fim.transform(df, rate=100, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *_fim(i, t, 100, pattern), t or "") for i, t in TEXTS]
    assert sorted(map(tuple, out), key=_key) == sorted(want, key=_key)
    assert fim.transform(df.limit(0)).count() == 0


def test_word_ends_at_any_chunk(monkeypatch):
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fim, "CHUNK", chunk)
        for _, t in TEXTS[:60] + TEXTS[150:159]:
            data = np.frombuffer((t or "").encode(), np.uint8)
            assert [int(x) for e in fim.word_ends(data) for x in e] == [m.end() for m in WORDS.finditer(t or "")]
            assert [int(x) for e in fim.character_ends(data) for x in e] == list(range(1, len(t or "") + 1))


def test_boundary_set_selects():
    rng = np.random.default_rng(1)
    few = np.unique(rng.integers(0, 1 << 20, 300))
    many = (1 << 20) + np.unique(rng.integers(0, 1 << 17, 60_000))
    runs = (1 << 22) + np.concatenate([np.arange(a, a + 900) for a in range(0, 1 << 18, 1000)])
    far = np.array([(1 << 30) - 1, 1 << 30, (1 << 33) + 5])
    everything = np.concatenate([few, many, runs, far])
    for size in (1, 1000, len(everything)):
        step = everything[:3000] if size == 1 else everything
        own = fim.BoundarySet(step[a : a + size] for a in range(0, len(step), size))
        assert len(own) == len(step)
        for k in {0, len(step) - 1, *rng.integers(0, len(step), 400).tolist()}:
            assert own.select(k) == step[k]
    assert {type(b) for b in own.boxes} == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}
    assert len(fim.BoundarySet(())) == 0


# --- harmonic packing ---------------------------------------------------------------------------


def _sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in out.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    return out


def test_op13(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    ids = {(i, text): [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in TEXTS}
    got = registry.queries()["op13_harmonic_packing"](spark, sf_dir).collect()
    want = []
    for i, text in TEXTS:
        own, at = ids[i, text], 0
        for _, n in harmonic.cut(len(own), harmonic.class_sizes(2048)):
            want.append((i, at, n, zlib.crc32(np.array(own[at : at + n], "<u4").tobytes()), len(own)))
            at += n
        assert at == len(own)
    assert sorted((tuple(r)[:5] for r in got), key=_key) == sorted(want, key=_key)
    full = [sum(n for _, n in own) for own in _sequences(got).values()]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in full) and sum(n < 2048 for n in full) <= 3 * 11
    same = [own for own in _sequences(got).values() if len({n for _, n in own}) == 1 and sum(n for _, n in own) == 2048]
    assert len({len(own) for own in same}) > 2 and all(len(own) * own[0][1] == 2048 for own in same)


@pytest.mark.parametrize("capacity, smallest", [(2048, 64), (1000, 1), (1000, 50), (7, 1), (1, 1)])
def test_harmonic_other_capacities(spark, capacity, smallest):
    df = spark.createDataFrame(TEXTS[:80] + [(999, None)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = harmonic.pack(df.coalesce(1), tokens.vocabulary_path("byte_bpe_50k.json"), capacity=capacity, smallest=smallest).collect()
    full = [sum(n for _, n in own) for own in _sequences(got).values()]
    docs, by_doc = {}, 0
    for r in got:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    for own in docs.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:])) and sum(own[-1][:2]) == own[0][2]
        by_doc += own[0][2]
    assert max(full) <= capacity and sum(full) == by_doc and len(docs) == 81
    if smallest == 1:
        assert sum(n < capacity for n in full) <= math.log2(capacity) + 10
    assert harmonic.pack(df.limit(0), tokens.vocabulary_path("byte_bpe_50k.json")).count() == 0


# --- whitening ----------------------------------------------------------------------------------


def _matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T, q


@pytest.mark.parametrize("values", [[3.0], [2, 1], np.geomspace(1, 1e-12, 20), np.linspace(1, 2, 64), [5.0] * 9, [4, 4, 4, 1, 1, 0, 0], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [2, 1, -1, -2], [0.0] * 4])
def test_components(values):
    values = np.sort(np.asarray(values, float))[::-1]
    a, _ = _matrix(values)
    a = (a + a.T) / 2
    got, vectors = whitening.components(a)
    scale = np.abs(values).max() or 1
    assert np.abs(got - values).max() <= 1e-13 * scale * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() <= 2e-13 * scale * len(values)
    top, some = whitening.components(a, 3)
    assert len(top) == min(3, len(values)) and np.allclose(top, values[:3], atol=1e-12 * scale) and some.shape[1] == len(top)


def test_components_to_double_precision():
    values = np.sort(np.random.default_rng(3).uniform(1e4, 3e4, 64))[::-1]
    a, q = _matrix(values, 8)
    _, vectors = whitening.components((a + a.T) / 2, 8)
    gap = np.abs(np.abs(np.sum(vectors * q[:, :8], 0)) - 1)
    assert gap.max() < 1e-14


def test_polar():
    a, q = _matrix([3, 2, 1e-14, -1e-15, -1], 2)
    u = whitening.polar((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13
    assert abs(q[:, 0] @ u @ q[:, 0] - 1) < 1e-12 and abs(q[:, 4] @ u @ q[:, 4] + 1) < 1e-12


def test_op11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    x = np.array([[math.floor(1024 * v) + 100000 for v in r.embedding] for r in rows])
    n, s = len(x), x.sum(0)
    v = np.cov(x.T.astype(float), bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    want = {}
    for r, own in zip(rows, x):
        w = (own - s / n) @ q / np.sqrt(e)
        want.setdefault(r.vec_id, []).append((int(((n * own - s) ** 2).sum()), w))
    got = registry.queries()["op11_qdwh_whitening"](spark, sf_dir).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n} and {r.vec_id for r in got} == set(want)
    sign = {}
    for r in got:
        dev, w = want[r.vec_id][0]
        k = r.component - 1
        assert r.deviation == dev and abs(abs(r.whitened) - abs(w[k])) < 1e-9 and abs(r.explained / (e[k] / np.trace(v)) - 1) < 1e-9
        if abs(w[k]) > 1e-3:
            sign.setdefault(k, set()).add(r.whitened * w[k] > 0)
    assert all(len(v) == 1 for v in sign.values()) and len(sign) == 8
    assert {r.identity_error < 1e-9 for r in got} == {True} and len({r.identity_error for r in got}) == 1


def test_whitening_awkward(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [0.5, -0.5]) for i in range(4)], schema)
    assert len(whitening.fit(same).eigenvalues) == 0  # no variance: nothing to whiten
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.1, 0.2])]):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/embeddings.parquet")
        out = whitening.query(spark, path)
        assert out.count() == 0 and dict(out.dtypes)["deviation"] == "bigint"
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [0.1]), (2, [0.1, 0.2])], schema))
    line = spark.createDataFrame([(i, [i / 10, i / 5, 1.0]) for i in range(30)], schema)
    model = whitening.fit(line)
    assert 1 <= len(model.eigenvalues) <= 2 and model.identity_error < 1e-6
    big = whitening.fit(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], schema))
    rows = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (3, [0.0, 0.5])], schema), big, ["vec_id"]).collect()
    assert [r.deviation for r in rows] == [None, (3 * 100000 - big.sums[0]) ** 2 + (3 * 100512 - big.sums[1]) ** 2]


def test_deviation_at_the_edge():
    model = whitening.Whitening(3, [3 * 100000 + 1, 3 * 100000], np.eye(2), np.ones(2), 2.0)
    edge = math.isqrt((1 << 63) - 1) // 3
    for far in (0, 5, 10**6, edge - 2, edge, edge + 1, edge + 10, 10**12, 10**17):
        exact = (3 * (100000 + far) - model.sums[0]) ** 2
        assert model.deviation(np.array([[100000 + far, 100000]])) == [exact if exact < 1 << 63 else None]
