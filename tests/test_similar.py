"""Similar names by matching blocks, against the standard library's matcher on all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from marklens.functions import matching
from marklens.operators import link, similar


def _names(rng, n):
    stems = ["group", "ring", "field", "vector-space", "morphism", "aab", "abab", "é∘x"]
    out = []
    for _ in range(n):
        s = list(rng.choice(stems) + rng.choice(["", "-", "?"]) + rng.choice(stems))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s)) : rng.randrange(len(s))] = rng.choice(["", "x", "ab"])
        out.append("".join(s))
    return out


def test_ratio_is_the_matchers(spark):
    rng = random.Random(4)
    a, b = _names(rng, 3000), _names(rng, 3000)
    pairs = list(zip(a, b)) + [("", ""), ("", "a"), ("abc", "abc"), ("ab" * 60, "ba" * 70), ("a", "b")]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").withColumn("r", matching.ratio(F.col("a"), F.col("b")))
    for r in df.collect():
        want = None if r.a is None else difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.r == want, r


def test_close_matches_lose_none(spark):
    rng = random.Random(5)
    files = ["/a", "/b", "/c"]
    names = [(rng.choice(files), n, rng.choice([1, 2, 4])) for n in _names(rng, 150)] + [("/a", None, 1), ("/a", "", 1), ("/a", "m?group", 4), (None, "ring", 1)]
    wanted = [(rng.choice(files), s, rng.choice([1, 3])) for s in _names(rng, 60)] + [("/a", None, 1), ("/a", "", 1), ("/a", "n?group", 1), (None, "ring", 1), ("/z", "ring", 1)]
    got = similar.close_matches(spark.createDataFrame(wanted + wanted[:9], "path string, symbol string, mask int"), spark.createDataFrame(names + names[:9], "path string, name string, type int")).collect()
    want = set()
    for path, symbol, mask in set(wanted):
        if path and symbol:
            fits = {n for p, n, t in names if p == path and n and (t & mask or n.split("?")[-1] == symbol.split("?")[-1])}
            close = sorted(((r, n) for n in fits if (r := difflib.SequenceMatcher(None, n, symbol, autojunk=False).ratio()) >= 0.6), reverse=True)[:3]
            want |= {(path, symbol, mask, n, r, i) for i, (r, n) in enumerate(close, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60
    assert ("/a", "n?group", 1) in {(r.path, r.symbol, r.mask) for r in got}
    empty = spark.createDataFrame([], "path string, symbol string, mask int")
    assert similar.close_matches(empty, spark.createDataFrame(names, "path string, name string, type int")).isEmpty()


def test_numbered_characters_count_repeats(spark):
    texts = ["", "a", "abab", "é∘x∘é", "\U0001d538a\U0001d538", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matching.numbered_characters(F.col("t")).alias("n")).collect()
    assert all(r.n is None if r.t is None else sorted(x & (1 << 21) - 1 for x in r.n) == sorted(map(ord, r.t)) and len(set(r.n)) == len(r.t) for r in rows)
    for x, y in [(x, y) for x in rows for y in rows if x.t and y.t]:
        assert len(set(x.n) & set(y.n)) == sum(min(x.t.count(c), y.t.count(c)) for c in set(x.t))


def test_a_name_and_a_reference_meet_once(spark):
    """Names of one module share most characters; each pair of a file is one row of the join, not one for each character in common."""
    names = spark.createDataFrame([("/a", f"m1234?ring-{i}", 1) for i in range(20)], "path string, name string, type int")
    wanted = spark.createDataFrame([("/a", f"m1234?ringe-{i}", 1) for i in range(9)], "path string, symbol string, mask int")
    out = similar.close_matches(wanted, names)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 27


def test_similar_names_are_those_of_all_pairs_and_bits_bound_the_distance(spark):
    """Names that are done after one edit, after two, and only among all; equal ratios at the end of a symbol's list, characters beyond two bytes, a long name."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abä𝔘") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"stone", "stones", "tones", "tone", "x" * 300, "x" * 180 + "y"}
    symbols = {w if rng.random() < 0.3 else w[: rng.randint(1, len(w))] + rng.choice(["", "b", "ab", "cab"]) for w in sorted(words)} | {"", "ston", "x" * 299}
    table = lambda rows, column: spark.createDataFrame([(x,) for x in sorted(rows)] * 2, f"{column} string")
    wanted, names = table(symbols, "symbol"), table(words | {""}, "name")
    both = wanted.distinct().crossJoin(names.distinct()).filter("symbol <> name AND symbol <> '' AND name <> ''")
    both = both.withColumn("ratio", F.expr("round(1 - levenshtein(symbol, name) / greatest(length(symbol), length(name)), 6)")).filter("ratio >= 0.6")
    own: dict = {}
    for r in both.collect():
        own.setdefault(r.symbol, []).append((-r.ratio, r.name))
    want = {(s, name, -ratio) for s, found in own.items() for ratio, name in sorted(found, key=lambda x: (x[0], x[1].encode()))[:3]}
    assert len({s for s, *_ in want}) > 100 and {tuple(r) for r in link.similar_names(wanted, names).collect()} == want
    pairs = link._by_length(link._signed(wanted.distinct(), "symbol", "a").withColumn("least", F.lit(0.6)), link._signed(names.distinct(), "name", "b")).filter("symbol <> '' AND name <> ''")
    assert pairs.filter(link._may_be_near()).count() < pairs.count() / 2
    assert pairs.filter(~link._may_be_near()).filter("levenshtein(symbol, name) <= k").isEmpty()
