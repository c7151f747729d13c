"""What must hold for plans to grow no faster than their input."""

from pyspark.sql import functions as F

from marklens.operators import features, graph, link, markup, scopes, suggest, tokens
from marklens.plans import registry
from marklens.sources import shared


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_definitions_broadcast_nothing(spark):
    """Points, references, targets and ranges all grow with the corpus; Spark takes them for small by their files."""
    points = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9)], "path string, pos long")
    refs = spark.createDataFrame([("a", 4, 6, 0, "m", "s")], "path string, begin_pos long, end_pos long, nth int, module string, symbol string")
    targets = spark.createDataFrame([("m", "s", "b", 7)], "module string, symbol string, d_path string, d_pos long")
    ranges = spark.createDataFrame([("a", 0, 20), ("a", 3, 8)], "path string, begin_pos long, end_pos long")
    out = link.definitions_at(points, refs, targets, ranges)
    assert "Broadcast" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("a", 1, "a", 0), ("a", 5, "a", 0), ("a", 5, "a", 3), ("a", 5, "b", 7), ("a", 9, "a", 0)]


def test_tokens_move_only_as_texts(spark):
    """Counts by document need one exchange, of texts; tokens have none of their own."""
    plan = _plan(registry.queries()["f2_term_frequency"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange ") == 1 and "REPARTITION" in plan


def test_tokens_keep_their_columns_and_null_documents(spark):
    rows = [(1, 0, "a", 2), (1, 1, "b", 0), (1, 2, "a", 0), (None, 0, "a", 1), (None, None, "c", 0)]
    tok = spark.createDataFrame(rows, "doc_id long, pos int, token string, label int")
    got = {tuple(r[c] for c in ("doc_id", "pos", "token", "label", "tf")) for r in features.term_frequency(tok).collect()}
    assert got == {(d, p, t, x, c) for (d, p, t, x), c in zip(rows, (2 / 3, 1 / 3, 2 / 3, 1 / 2, 1 / 2))}
    out = features.embed(tok.select("doc_id", "pos", "token"), spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "token string, vec array<float>"), 1)
    assert sorted((r.doc_id or 0, -1 if r.pos is None else r.pos, r.vec[0]) for r in out.collect()) == [(0, -1, 0.0), (0, 0, 1.0), (1, 0, 1.0), (1, 1, 0.0), (1, 2, 1.0)]


def test_assembled_features_meet_one_table_of_words(spark, monkeypatch):
    """One join by word and one count; positions travel alone, as a token's length is known from it."""
    tables, packed = [], []
    written, pack = features.checkpoint, features.packed
    monkeypatch.setattr(features, "checkpoint", lambda df: tables.append(df.columns) or written(df))
    monkeypatch.setattr(features, "packed", lambda tok, *a, **k: packed.append(out := pack(tok, *a, **k)) or out)
    registry.queries()["f25_assembly"](spark, "/root/testdata/sf0.001")
    assert tables == [["token", "idf", "keyphraseness"]]
    assert [x.schema["places"].dataType.simpleString() for x in packed] == ["array<int>"]
    tok = spark.createDataFrame([(d, w, d % 2) for d in range(5) for w in "aab" + "xyz"[d % 3]], "doc_id long, token string, label int")
    both = features.idf(tok).join(features.keyphraseness(tok), ["token", "df"]).select("token", "df", "idf", "keyphraseness")
    assert {tuple(r) for r in features.word_values(tok).collect()} == {tuple(r) for r in both.collect()}


def _used(spark):
    """Files that hold and use the same few modules, some of them only their own."""
    deps = spark.createDataFrame([(f"f{i}", f"m{i % 3}") for i in range(40)] * 3 + [("own", "alone"), ("f1", None)], "path string, module string")
    refs = spark.createDataFrame([(f"f{i}", f"m{i % 4}") for i in range(40)] * 2 + [("f2", None)], "path string, module string")
    modules = spark.createDataFrame([(f"f{i}", f"m{i % 5}") for i in range(40)] * 2 + [("own", "alone")], "path string, module string")
    return deps, refs, modules


def test_users_names_modules_once_before_pairs(spark):
    out = link.users(*_used(spark))
    assert _plan(out).count("HashAggregate") == 6
    deps, refs, modules = ({tuple(r) for r in x.collect()} for x in _used(spark))
    assert sorted(map(tuple, out.collect())) == sorted({(u, p) for p, m in deps | refs for u, n in modules if m is not None and m == n and u != p})


def test_pairs_of_users_are_made_once_and_do_not_move(spark, monkeypatch):
    """Files that share several modules, of many files and of one; classes of several blocks."""
    monkeypatch.setattr(link, "FILES_OF_A_BLOCK", 4)
    deps = [(f"f{i}", f"m{i % k}") for i in range(40) for k in (2, 3, 7)] + [(f"f{i}", f"own{i * 3 % 40}") for i in range(0, 40, 2)]
    modules = [(f"f{i}", f"m{i % k}") for i in range(40) for k in (2, 5)] + [(f"f{i}", f"own{i}") for i in range(40)] + [("f3", None)]
    table = lambda rows: spark.createDataFrame(rows, "path string, module string")
    out = link.users(table(deps), table(deps[:20]), table(modules))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
    assert sorted(map(tuple, out.collect())) == sorted({(u, p) for p, m in deps for u, n in modules if m == n and u != p})


def test_newest_used_is_that_of_all_pairs(spark):
    deps, refs, modules = _used(spark)
    built = {f"f{i}": i * 7 % 11 for i in range(40) if i % 9} | {"own": 99}
    builds = spark.createDataFrame([*built.items(), ("f3", 2), ("f4", None)], "path string, built_at long")
    want: dict = {}
    for used, user in map(tuple, link.users(deps, refs, modules).collect()):
        if used in built:
            want[user] = max(want.get(user, 0), built[used])
    assert dict(map(tuple, link.newest_used(deps, refs, modules, builds).collect())) == want


def test_similar_names_broadcast_nothing(spark):
    """Pieces of names are hundreds of rows a name, which an estimate from before they are cut doesn't show."""
    names = spark.createDataFrame([("groups",), ("group",), ("ring",)], "name string")
    out = link.similar_names(names.select(F.col("name").alias("symbol")), names)
    assert "Broadcast" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("group", "groups", 0.833333), ("groups", "group", 0.833333)]


def test_closure_holds_sixty_four_nodes_a_row_and_known_ones_stay(spark):
    """A hub that leads to 99 nodes, and one of these back: the numbers of all that each node reaches, the highest bit of a word too."""
    rows = [("m100", f"m{i}", True) for i in range(101, 200)] + [("m150", "m100", True), ("m199", None, True), ("x", "m150", False), ("m120", "x", False)]
    edges = spark.createDataFrame(rows, "src string, dst string, export boolean")
    ring = {f"m{i}" for i in range(100, 200)} | {None}
    want = {"m100": ring, "m150": ring, "x": ring, "m199": {None}, "m120": {"x"}}
    sets, names = link.reached(edges)
    assert sets.count() <= 3 * 4 + 2
    got = {}
    for r in link.closure(edges).collect():
        got.setdefault(r.root, []).append(r.node)
    assert {k: (len(v), set(v)) for k, v in got.items()} == {k: (len(v), v) for k, v in want.items()}
    ends = {r.root: (r.n, r.low, r.high) for r in link.reach_ends(sets, names).collect()}
    assert ends == {"m100": (101, "m100", "m199"), "m150": (101, "m100", "m199"), "x": (101, "m100", "m199"), "m199": (1, None, None), "m120": (1, "x", "x")}
    known = shared.bucketed(spark.range(1000).selectExpr("id AS root", "id % 7 AS word", "id AS bits"), "root", "word")
    step = spark.range(1000).selectExpr("id AS root", "id % 5 AS word").groupBy("root", "word").count()
    assert _plan(known.join(step, ["root", "word"], "full")).count("Exchange ") == 1


def test_prefixes_are_as_long_as_what_is_typed(spark):
    wanted = spark.createDataFrame([("a",), ("abc",), ("",)], "fragment string")
    names = spark.createDataFrame([("abcdefghij",), ("ab",), (None,)], "name string")
    assert sorted(map(tuple, suggest.prefixes(names, wanted, "name").collect())) == [("ab", ""), ("ab", "a"), ("abcdefghij", ""), ("abcdefghij", "a"), ("abcdefghij", "abc")]
    assert sorted(map(tuple, suggest.prefix_join(wanted, names, "name").collect())) == [("", "ab"), ("", "abcdefghij"), ("a", "ab"), ("a", "abcdefghij"), ("abc", "abcdefghij")]


def _import_graph(spark):
    """Scopes of two files' worth of names on a random graph: use-imports, modules of one name, rings."""
    import random

    rnd, n = random.Random(5), 60
    found = [(f"f{i}", 0, 90, f"f{i}#0", f"f{i}", "module", f"m{i % 50}", 0) for i in range(n)]
    found += [(f"f{i}", 9, 20, f"f{i}#9", f"f{i}#0", "scope", "omtext", 0) for i in range(0, n, 4)]
    imported = [(f[0], k, f[3], f"f{j}#0", f"m{j % 50}", rnd.random() < 0.6, 1) for f in found for k, j in enumerate(rnd.sample(range(n), 2))]
    found = spark.createDataFrame(found, "path string, begin_pos long, end_pos long, scope string, parent string, kind string, name string, access int")
    return found, spark.createDataFrame(imported, "path string, pos long, scope string, node string, module string, export boolean, n_modules long")


def test_imports_by_name_are_those_of_all_imports(spark):
    found, imported = _import_graph(spark)
    around = scopes.outward(found)
    wanted = found.select("scope").crossJoin(spark.range(52).select(F.concat(F.lit("m"), "id").alias("name"))).filter("hash(scope, name) % 3 = 0")
    names = found.filter("kind = 'module'").select(F.col("scope").alias("node"), "name")
    want = scopes.brought(found, imported, around).join(names, "node").join(wanted, ["scope", "name"]).select("scope", "node").distinct()
    got = scopes.brought_by_name(found, imported, around, wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()


def test_what_a_scope_imports_itself_needs_no_walk(spark, monkeypatch):
    """A chain of 40 modules that each name what they import: 780 pairs of a scope and what it gets, none of which is walked."""
    found = spark.createDataFrame([(f"f{i}", 0, 9, f"f{i}#0", f"f{i}", "module", f"m{i}", 0) for i in range(40)], "path string, begin_pos long, end_pos long, scope string, parent string, kind string, name string, access int")
    imported = spark.createDataFrame([(f"f{i}", 1, f"f{i}#0", f"f{i + 1}#0", f"m{i + 1}", True, 1) for i in range(39)], "path string, pos long, scope string, node string, module string, export boolean, n_modules long")
    refs = imported.select("path", F.col("pos").alias("ref"), "pos", "scope", F.array("module").alias("ids"), F.lit(4).alias("mask"))
    around, walked = scopes.outward(found), []
    add = shared.Grown.add
    monkeypatch.setattr(shared.Grown, "add", lambda self, df: (add(self, df), walked.append(self.latest().count())))
    got = scopes.brought_by_name(found, imported, around, scopes.asked(refs, around, found))
    assert {tuple(r) for r in got.collect()} == {(f"f{i}#0", f"f{i + 1}#0") for i in range(39)} and sum(walked) == 0


def test_braces_are_counted_one_by_one_only_where_they_may_be_deep(spark):
    n = markup.LEVELS
    texts = ["", "a", "{}" * 40, "}" * 20 + "{x}" * 20, "{" * n + "x" + "}" * n, "{" * (n + 1) + "x" + "}" * (n + 1), "{" * (n + 1), "{" * n, "{x" * 9 + "}" * 20 + "{y" * n + "}", "{a}" * 9 + "{" * (n - 1) + "{}{}" + "}" * 3 + "{{", "}{" * 30, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(markup.is_deep(F.col("text")).alias("deep"), (markup.brace_depth(F.col("text")) > n).alias("want")).collect()
    assert [bool(r.deep) for r in rows] == [bool(r.want) for r in rows] and any(r.deep for r in rows)


def test_namespaces_take_environments_as_written(spark, monkeypatch):
    calls, own = [], tokens.environments
    monkeypatch.setattr(tokens, "environments", lambda args: calls.append(1) or own(args))
    registry.queries()["l25_namespaces"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_written_tables_are_packed_closely(spark):
    """What all linking queries stand on is written in the denser form, which reads back the same."""
    df = spark.range(50).withColumn("path", F.concat(F.lit("/hub/source/m"), "id"))
    out = shared.write_table(df, "dense")
    assert all(f.endswith(".zstd.parquet") for f in out.inputFiles()) and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
