"""The training-data operators against brute force, libraries and exact round trips, with awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm import media, packing, pieces, quality, sharding, simhash, suffix, tokens, toxicity, warc

SHARED = "a passage that several of the documents share, more than fifty bytes long, word for word "
ROWS = [(1, "alpha " + SHARED + "omega"), (2, None), (3, ""), (4, SHARED + "x"), (5, "short"), (6, "alpha " + SHARED + "omega"), (7, "é" * 60 + SHARED), (8, "word " * 3000), (8, "word " * 3000), (9, "\n\t "), (10, "a b c d e f g\na b c d e f g\n#$%")]
SCHEMA = "doc_id long, text string, source string, key long, h string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 0, "x", 9) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(docs, empty):
    got = media.from_ogg(media.to_ogg(docs)).collect()
    assert len(got) == len(ROWS) and all(r.error is None for r in got)
    assert sorted((r.doc_id, bytes(r.payload)) for r in got) == sorted((i, media.pad((t or "").encode())) for i, t in ROWS)
    assert media.from_ogg(media.to_ogg(empty)).count() == 0
    assert media.packet_times(media.to_ogg(docs)).filter("end_s <= start_s").count() == 0


def test_media_damage():
    data = bytearray(media.encode(bytes(range(256)) * 40))
    assert media.decode(bytes(data))[0] == bytes(range(256)) * 40
    data[len(data) // 2] ^= 1
    with pytest.raises(media.OggError):
        media.decode(bytes(data))


def test_suffix_against_brute_force(spark, docs, empty):
    rows = [(i, t) for i, t in ROWS if i != 8]
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows += [(20 + i, base[rng.randrange(200) :][: rng.randrange(20, 200)] + "".join(rng.choice("ab") for _ in range(70))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == suffix.brute_force(rows)
    assert suffix.remove_repeats(empty).count() == 0 and suffix.remove_repeats(docs).count() == len(ROWS)


def test_suffix_tells_segments_of_one_hash_apart(spark):
    """Segments under one least hash whose bytes' hashes agree in 32 bits, with one that agrees in none."""
    rng = np.random.default_rng(1)
    grams = rng.integers(97, 123, (100_000, suffix.GRAM)).astype(np.uint8)
    gram = min(map(bytes, grams), key=lambda g: suffix.gram_hashes(np.frombuffer(g, np.uint8))[0])
    n, side = 300_000, (suffix.LENGTH - suffix.GRAM) // 2
    texts = rng.integers(97, 123, (n, suffix.LENGTH)).astype(np.uint8)
    texts[:, side:-side] = np.frombuffer(gram, np.uint8)
    h, k, text, _, _ = suffix.segments(texts.reshape(-1), np.arange(n + 1) * suffix.LENGTH)
    own = h == suffix.gram_hashes(np.frombuffer(gram, np.uint8))[0]
    top, text = (k[own] if k.dtype == np.int32 else k[own] >> 32), text[own]
    order = np.argsort(top, kind="stable")
    at = np.flatnonzero(top[order][1:] == top[order][:-1])
    rows = [bytes(texts[text[0]]).decode()] + [bytes(texts[text[order[i + d]]]).decode() for i in at for d in (0, 1)]
    assert len(rows) >= 5 and len(set(rows)) == len(rows)
    rows = list(enumerate(rows + rows[-1:]))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == suffix.brute_force(rows)


def test_suffix_crowded_hash(spark, monkeypatch):
    """One phrase with differing neighbours in all texts: its segments don't meet under one key."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [(i, word(40) + "qqq licence, see the file zzz" + word(3) + "x" * rng.randrange(30)) for i in range(60)]
    rows += [(60 + i, "left " * 9 + word(1) + "qqq licence, see the file zzz" + word(2) + " and right" * 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    most = {}
    for crowd in (5, 10_000):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        got = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == suffix.brute_force(rows)
        chunks = suffix._chunks(df.select("doc_id", F.encode("text", "UTF-8").alias("data")), 500)
        states = suffix._by_bucket(suffix._hash_blobs(chunks, 40, 4, 50), 4, 4, lambda blobs, crowd=crowd: suffix._shared(blobs, crowd))
        sent = suffix._with_chunks(chunks, states, suffix._segment_blobs(40, 4, 50), "bucket int, chunk bigint, blob binary").collect()
        met = {}
        for r in sent:
            d, count, _, _, _, text = suffix._unpack(r.blob, "<u8", "u1", "<u4", "<i8", "<u4", "u1")
            ends = np.cumsum(count.astype(int) + 49)
            for key, a, z in zip(np.cumsum(d), ends - count - 49, ends):
                met.setdefault(int(key), set()).add(bytes(text[a:z]))
        most[crowd] = max(map(len, met.values()))
    assert most[5] <= 5 < most[10_000]


def test_suffix_characters_and_carried_columns(spark):
    """Whole characters go, a replacement character of the text stays, other columns travel whatever their names."""
    long = "é\ufffd" * 30
    rows = [(1, "x" + long, 1, "a"), (2, long + "y", 2, None), (2, long + "y", 3, "c"), (None, long, 4, "d"), (3, None, 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, `a.b` string")
    out = suffix.remove_repeats(df, carry=("n", "a.b"), whole_characters=True)
    got = {r.n: r for r in out.collect()}
    assert {n: r.kept.decode() for n, r in got.items()} == {1: "x" + long, 2: "y", 3: "y", 4: long, 5: ""}
    assert got[4].doc_id is None and got[5].n_bytes == 0 and got[2]["a.b"] is None and got[3]["a.b"] == "c"


def test_deep_shallow_order():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) * 2
    starts = np.array(rng.sample(range(len(data) - 50), 2000))
    flat = [data[starts[i] : starts[i] + 50] for g in suffix.deep_shallow(data, starts) for i in g]
    assert flat == sorted(flat) and len(flat) == 2000


def test_rules(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[2].n_words == 0 and not got[2].kept and got[10].n_dup_lines == 1 and got[10].n_symbols == 3 and got[10].n_repeat_words == 14
    assert got[8].base_failed and quality.judge(empty).count() == 0


def test_packing_loses_little_in_many_partitions(spark):
    """Sequences beyond the least possible number, for one partition and for 211 of them."""
    path, docs = tokens.vocabulary_path("byte_bpe_50k.json"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for own in (docs.coalesce(1), docs.repartition(211)):
        got = packing.pack(own, path).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("total"), F.countDistinct("doc_id").alias("docs")).first()
        assert got.docs == docs.count() and got.n <= 1.03 * -(-got.total // packing.CAPACITY), got


def test_packing(docs, empty):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    places = {}
    for r in got:
        assert r.length <= 1024 and len(r.ids) == 4 * r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for a, n in sorted(own):
            assert a == end
            end += n
        assert end <= 1024
    assert packing.pack(empty, path).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)] and fit.place(3) == (1, 7) and fit.place(4) == (0, 6)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = tokens.vocabulary_path("piece_bpe_32k.model")
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path), random.Random(2)
    texts = [t or "" for _, t in ROWS] + ["".join(rng.choice(" ab▁\n\t<s>é語🎉 the") for _ in range(rng.randrange(90))) for _ in range(800)] + [" " * n for n in range(40)]
    want = sp.encode(texts, add_bos=True, add_eos=True)
    got = [np.frombuffer(x, "<u4") for x in m.encode(texts)]
    assert [g.tolist() for g in got] == want and [m.decode(g) for g in got] == sp.decode(want)


def test_tokenizer_equals_the_library():
    """In its default setting, which gives the id of a special token whose string stands in a text."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for x in [x or "" for _, x in ROWS] + ["<|endoftext|> it's 12\uff13 \n\n  x", "  \x85\xe9", "a <|endoftext|><|endoftext|> b"]:
        assert tokens.byte_bpe(path)(x) == t.encode(x, add_special_tokens=False).ids


def test_tokenizer_on_very_long_white_space():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for x in [" " * 2_000_000 + "a", "b" + "\n \t" * 50_000 + "c", " " * 99_999 + "a"]:
        assert tokens.byte_bpe(path)(x) == t.encode(x, add_special_tokens=False).ids


def _order_by_hand(parts, vocab, length, key=42):
    """Slots and ids by the definition: partitions' streams cut in records, record i of n at slot feistel(i, n)."""
    records = []
    for own in parts:
        ids, where = [], []
        for d, t in own:
            e = [*tokens.byte_bpe(vocab)(t or ""), 2]
            ids += e
            where += [(d, i) for i in range(len(e))]
        records += [(where[a], ids[a : a + length]) for a in range(0, len(ids), length)]
    slots = tokens.feistel(np.arange(len(records)), len(records), key).tolist()
    return sorted((slot, d, start, len(ids), np.array(ids, "<u2").tobytes()) for slot, ((d, start), ids) in zip(slots, records))


@pytest.mark.parametrize("n", [1, 3, 300])
def test_training_order_equals_brute_force(spark, tmp_path, monkeypatch, n):
    """Any number of partitions, most of them empty or small; nulls, repeats, shards of a few records; resumed reads."""
    monkeypatch.setattr(tokens, "SHARD_BYTES", (3 * tokens.record_type(64).itemsize, 3 * tokens.record_type(64).itemsize))
    path, vocab = str(tmp_path / "o"), tokens.vocabulary_path("byte_bpe_50k.json")
    rows = [(None if i == 10 else i, t) for i, t in ROWS]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, 1, "k") for i, t in rows], n), "doc_id long, text string, slot int, record string")
    held = tokens.materialise(df, path, vocab, length=64).collect()
    got = sorted((r.slot, r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_shards(spark, path).collect())
    want = _order_by_hand(df.select("doc_id", "text").rdd.glom().collect(), vocab, 64)
    assert got == want
    at = 7
    assert sorted(r.slot for r in tokens.read_shards(spark, path, from_slot=at).collect()) == list(range(at, len(want)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n) for r in held) == sorted((d is None, d or 0, len(tokens.byte_bpe(vocab)(t or "")) + 1) for d, t in rows)


def test_training_order_permutation(spark, empty, tmp_path):
    for n in (1, 2, 7, 1000):
        assert sorted(tokens.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    path = str(tmp_path / "e")
    assert tokens.materialise(empty, path, tokens.vocabulary_path("byte_bpe_50k.json")).count() == 0
    assert tokens.read_shards(spark, path).count() == 0


def test_warc(spark):
    rows = [(3, "http://a.org/x?y#z", "<p>1"), (1, "http://b.a.org:80/", "<p>1"), (2, None, None), (4, "http://a.org/x?y#z", ""), (5, "u\nv", "<p>2")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from marklens.llm.storage import new_path

    a, b = new_path(spark, "w"), new_path(spark, "i")
    caps = warc.write_archives(df, a)
    idx = warc.write_index(caps, b)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc.read_records(warc.lookup(caps.select("key").distinct(), idx, b), a).collect()}
    assert got == {1: ("response", None, warc.digest(b"<p>1")), 3: ("revisit", 1, warc.digest(b"<p>1")), 2: ("response", None, warc.digest(b"")), 4: ("revisit", 2, warc.digest(b"")), 5: ("response", None, warc.digest(b"<p>2"))}
    assert warc.surt("http://m.a.org:80/x?y#z") == "org,a,m:80)/x?y"


def test_sharding(docs, empty):
    got = sharding.shuffle_exact(docs, 3).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(3)}
    assert sorted(map(len, by.values())) == [3, 4, 4] and all(v == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_exact(empty, 3).count() == 0
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4


def test_simhash_components(spark, empty):
    rng = random.Random(4)
    vals = [rng.getrandbits(64) for _ in range(20)]
    vals += [v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in vals for _ in range(3)]
    df = spark.createDataFrame([(simhash._signed(v),) for v in set(vals)], "fp long")
    comp = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    for a in set(vals):
        for b in set(vals):
            if a != b and (a ^ b).bit_count() <= 2:
                assert comp[simhash._signed(a)] == comp[simhash._signed(b)]
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_groups(spark, docs):
    words = [f"w{i}" for i in range(300)]
    other = words[:150] + ["new"] + words[151:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words))), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.similar_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_similar_groups_at_crowded_anchors(spark, monkeypatch):
    """All fingerprints of a table at one anchor, as with very many documents: links away from the smallest id stay."""
    monkeypatch.setattr(simhash, "anchors", lambda df, fp="fp", bits=64: df.withColumn("anchor", F.lit(0).cast("long")))
    text = lambda seed, k: " ".join(f"{seed}{i}" for i in range(k)) + " x" + " ".join(f"{seed}{i}" for i in range(k, 300))
    rows = [(1, text("a", 5)), (2, text("b", 10)), (3, text("c", 10)), (4, text("b", 200)), (5, text("c", 150)), (6, text("c", 290)), (7, text("d", 3)), (8, text("a", 99))]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component for r in got} == {1: 1, 8: 1, 2: 2, 4: 2, 3: 3, 5: 3, 6: 3, 7: 7}


@pytest.mark.parametrize("block", [1024, 3])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, block):
    """Near copies around the limit, all at one anchor: links between rows like and unlike the smallest id stay."""
    monkeypatch.setattr(simhash, "anchors", lambda df, fp="fp", bits=64: df.withColumn("anchor", F.lit(0).cast("long")))
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(6)
    order = rng.sample(range(10, 90), 80)
    rows = [(order[i], " ".join(f"w{j}" for j in range(12 * i, 12 * i + 300))) for i in range(40)]
    rows += [(order[40 + i], " ".join(f"v{j}" if rng.random() > 0.02 else f"x{i}" for j in range(300))) for i in range(40)]
    rows.append((1, " ".join(f"w{j}" for j in range(240, 540))))  # the smallest id lies amid the chain
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and want[a] != want[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((want[a], want[b]))
                want = {i: low if r == high else r for i, r in want.items()}
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component for r in got.collect()} == want and 2 < len(set(want.values())) < 60


def _joined_rows(df):
    """How many rows each join of a plan that has run made."""
    made, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    return made


def test_only_rows_of_unsettled_spots_are_looked_up(spark):
    """600 spots of 20 rows like their smallest, a spot of two, and one with a row unlike it: the look-up makes rows of the last alone."""
    schema = "spot long, node long, root long, n long, head long, main boolean, far boolean"
    rows = [(s, 100 + i, 100 + i, 21, 1, False, False) for s in range(600) for i in range(20)] + [(700, 7, 7, 2, 1, False, False)]
    rows += [(800, 100, 100, 5, 1, False, False), (800, 7, 7, 5, 1, False, False), (800, 8, 8, 5, 1, False, True), (800, 9, 1, 5, 1, True, False)]
    rows += [(900, 100, 100, 3, 1, False, True), (900, 9, 1, 3, 1, True, True)]  # alike by another fingerprint, so nothing is left
    compared = [(100 + i, 1, True, None) for i in range(20)] + [(7, 1, False, [800])]
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = simhash._left_open(spark.createDataFrame(rows, schema), spark.createDataFrame(compared, "a long, b long, alike boolean, spots array<long>"))
        got = sorted((r.spot, r.node, r.root, r.main) for r in out.collect())
        assert got == [(800, 7, 7, False), (800, 8, 8, False), (800, 9, 1, True), (800, 100, 100, True)]
        assert sorted(_joined_rows(out)) == [6, 6]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_similar_groups_leave_no_old_exchanges(spark, monkeypatch):
    key, seen, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", set(), simhash.write_table
    before = spark.conf.get(key, None)
    monkeypatch.setattr(simhash, "write_table", lambda df, name: (seen.add(spark.conf.get(key, None)), write(df, name))[1])
    df = spark.createDataFrame([(i, "the same words again and again " + "x" * (i % 3)) for i in range(9)], "doc_id long, text string")
    assert simhash.keep_first(df).count() == 3 and seen == {"true"} and spark.conf.get(key, None) == before


def test_toxicity(spark, empty):
    rng = random.Random(5)
    plain = [" ".join(rng.choice("the a of in on to and is was for".split()) + rng.choice(["", "x", "y"]) for _ in range(40)) for _ in range(400)]
    rows = [(i, t + (" you idiot" if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out and r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_of_words_never_seen(spark):
    """Clean texts of words that no labelled text has, one of them an insult's neighbour in a small term space."""
    want = zlib.crc32(b"idiot") & (1 << 18) - 1
    like = next(w for w in map("".join, itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=5)) if zlib.crc32(w.encode()) & (1 << 18) - 1 == want and w != "idiot")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the a of in on to and is was for".split()) for _ in range(40)) + (" idiot" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    new = spark.createDataFrame([(1, "the a of " + like), (2, "the a of"), (3, " ".join(f"n{i}" for i in range(60_000))), (4, "the idiot")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[1].score == got[2].score


def test_training_order_exchanges_a_third_at_a_time(spark, tmp_path, monkeypatch):
    """Exchanged records are on disk beside the written ones and the shards, so they go in parts; none is lost or in two."""
    from pyspark.sql.readwriter import DataFrameWriter

    monkeypatch.setattr(tokens, "SHARD_BYTES", (3 * tokens.record_type(64).itemsize, 3 * tokens.record_type(64).itemsize))
    key, seen, text = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], DataFrameWriter.text
    before = spark.conf.get(key, None)
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, *a, **b: (seen.append(spark.conf.get(key)), text(self, path, *a, **b))[1])
    path, df = str(tmp_path / "w"), spark.createDataFrame([(i, "some words again " * (i % 30)) for i in range(60)], "doc_id long, text string")
    tokens.materialise(df, path, tokens.vocabulary_path("byte_bpe_50k.json"), length=64)
    total = spark.read.parquet(f"{path}/layout").first().records
    assert seen == ["true"] * 3 and spark.conf.get(key, None) == before
    assert total > 9 and sorted(r.slot for r in tokens.read_shards(spark, path).collect()) == list(range(total))
