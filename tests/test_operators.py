"""Operators without SQL against brute force, numpy or exact examples."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marklens.operators import features, link, markup, suggest, tagger, tokens
from marklens.plans import registry
from marklens.sources import ingest, shared, store
from marklens.streaming import edits, relink

DIR = "/root/testdata/sf0.001"


def test_contexts(spark):
    rows = [("\\gimport[src", "gimport", "oarg", "src"), ("a \\gimport[src1]{m", "gimport", "rarg", "m"), ("\\defi[x=1,na", "defi", "oarg", "na"), ("\\trefii{a}{", "trefii", "rarg", ""), ("\\trefi{a} b", None, None, None), ("", None, None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "c string").select("c", suggest.classify(F.col("c")).alias("x")).select("c", "x.*").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_pca(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    got = np.array([r.reduced for r in features.pca(df, 2).orderBy("id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want))


def test_verdicts_on_a_stream(spark, tmp_path):
    """Two micro-batches: state carries over from the first to the second."""
    first = [("a", 5, "open", 1), ("a", 4, "change", 2), ("a", 6, "open", 3), ("b", 1, "close", 1), ("a", 6, "change", 4)]
    second = [("a", 7, "close", 5), ("a", 8, "close", 6), ("a", 6, "open", 7), ("b", 2, "open", 2)]
    schema, src = "path string, version long, kind string, ts long", str(tmp_path / "in")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    run = lambda: edits.run_all(edits.verdicts_stream(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(src)
    got = {(r.path, r.version, r.kind): r.verdict for r in run().collect()}
    assert got == {("a", 5, "open"): "accepted", ("a", 4, "change"): "late", ("a", 6, "open"): got["a", 6, "open"], ("b", 1, "close"): "not-open", ("a", 6, "change"): "accepted", ("a", 7, "close"): "accepted", ("a", 8, "close"): "not-open", ("b", 2, "open"): "accepted"}
    assert sorted(r.verdict for r in run().filter("path = 'a' AND version = 6 AND kind = 'open'").collect()) == ["duplicate-open", "late"]


def test_publish_replaces_changed_files_only(spark, tmp_path):
    """Several batches; a file made clean loses its rows, a replayed batch changes nothing, an attempt that fails leaves the old rows."""
    table, check = str(tmp_path / "d"), lambda b: b.select("path", "n").filter("n > 0")
    schema = StructType.fromDDL("path string, n int")
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    now = lambda: sorted((r.path, r.n) for r in store.get(spark, table, schema).collect())
    assert now() == []
    edits.publish(batch(("a", 1), ("b", 2), ("b", 3)), 0, table, check)
    edits.publish(batch(("a", 3), ("c", 0)), 1, table, check)
    assert now() == [("a", 3), ("b", 2), ("b", 3)]
    edits.publish(batch(("a", 9)), 1, table, check)
    assert now() == [("a", 3), ("b", 2), ("b", 3)]
    with pytest.raises(Exception, match="no such"):
        edits.publish(batch(("a", 5)), 2, table, lambda b: b.select("path", F.raise_error(F.lit("no such")).cast("int").alias("n")))
    assert now() == [("a", 3), ("b", 2), ("b", 3)]
    edits.publish(batch(("b", 0)), 2, table, check)
    assert now() == [("a", 3)]
    store.compact(spark, table, str(tmp_path / "e"), schema)
    assert [tuple(r) for r in store.get(spark, str(tmp_path / "e"), schema).collect()] == [("a", 3)]


def test_relink_equals_a_full_check(spark, tmp_path):
    """Three batches on a stream of files: after each, the kept diagnostics are those of a check of everything."""
    text = lambda m, *to: f"\\begin{{modsig}}{{{m}}}" + "".join(f"\\gimport{{{x}}}" for x in to) + "\\symi{s}\\end{modsig}"
    path = lambda m: f"/r/source/{m}.tex"
    checked = []

    def check(args):
        regions = markup.regions(args, tokens.environments(args))
        deps, modules = markup.dependencies(args, regions), markup.modules(regions)
        files = args.select("path").distinct()
        checked.append(files.count())
        reach = link.closure(relink.Linked.imports(args), rule="all").groupBy(F.col("root").alias("path")).agg(F.count("*").alias("n"))
        status = link.resolve_modules(deps, modules, files).filter("status <> 'ok'").select("path", "pos", F.col("status").alias("code"))
        return status.union(reach.select("path", F.col("n").alias("pos"), F.lit("reached")))

    own = relink.Linked(spark, str(tmp_path / "c"), check, "path string, pos bigint, code string")
    state, steps = {}, [
        {"a": text("a", "b"), "b": text("b", "c"), "x": text("x", "y"), "y": text("y"), "z": text("z", "x")},
        {"c": text("c", "d"), "y": text("y")},
        {"b": text("b"), "d": text("d"), "q": None},
    ]
    for number, step in enumerate(steps):
        own.update(spark.createDataFrame([(path(m), t) for m, t in step.items()], "path string, text string"), number)
        seen = checked[-1]
        state |= {path(m): t for m, t in step.items()}
        full = markup.with_offsets(markup.arguments(markup.macros(spark.createDataFrame([(p, t) for p, t in state.items() if t], "path string, text string"))))
        assert sorted(map(tuple, own.diagnostics().collect())) == sorted(map(tuple, check(full).collect()))
        assert number != 2 or seen == 4  # a, b, c and d: not x, y and z


def test_scan_and_embeddings(spark, tmp_path):
    own = tmp_path / "r" / "source" / "sub"
    own.mkdir(parents=True)
    (own / "m.tex").write_text("\\symi{a}")
    (own / "m.txt").write_text("x")
    (tmp_path / "r" / "out.tex").write_text("x")
    got = ingest.scan(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.size, r.text) for r in got] == [("m.tex", 8, "\\symi{a}")]
    (tmp_path / "e.txt").write_text("cat 1 2.5\nbad 1\ndog 0 -1\n")
    assert sorted((r.token, r.vec) for r in ingest.embeddings_text(spark, str(tmp_path / "e.txt"), 2).collect()) == [("cat", [1.0, 2.5]), ("dog", [0.0, -1.0])]


def test_tagger(spark, tmp_path):
    """Keywords that the features tell apart are found, and a saved model predicts as before."""
    rows = [(d, p, f"k{p % 3}" if p % 4 == 0 else f"w{p % 5}", 9 if p % 4 == 0 else 3, int(p % 4 == 0)) for d in range(20) for p in range(24)]
    tok = spark.createDataFrame(rows, "doc_id long, pos long, token string, len long, label int")
    data = tagger.inputs(tok, tok)
    model = tagger.train(data)
    got = {(r.doc_id, r.pos): r.score for r in tagger.predict(model, data).collect()}
    assert all((got[d, p] > 0.5) == bool(y) for d, p, _, _, y in rows)
    tagger.save(model, str(tmp_path), {"name": "x"})
    again, settings = tagger.load(spark, str(tmp_path))
    assert settings["name"] == "x" and {(r.doc_id, r.pos): r.score for r in tagger.predict(again, data).collect()} == got
    with pytest.raises(ValueError):
        tagger.load(spark, str(tmp_path), "Other")


@pytest.mark.parametrize("name", ["f17_pca", "m1_train", "m2_predict", "m4_saved_model"])
def test_queries_without_sql(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_nested_macros_verbatim_and_comments(spark):
    text = "\\defi[name=x,noverb={de,en}]{a\\emph{b}} \\verb|\\defi{no}| 10\\% % \\defi{no}\n\\begin{verbatim}\\symi{no}\\end{verbatim}\\symii{a}{b}{open"
    df = spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string")
    got = markup.arguments(markup.with_offsets(markup.macros(df))).orderBy("pos").collect()
    assert [(r.name, r.rargs, r.parts) for r in got] == [("defi", ["a\\emph{b}"], ["name=x", "noverb={de,en}"]), ("emph", ["b"], []), ("symii", ["a", "b"], [])]
    assert all(text[r.place :].startswith("\\" + r.name) for r in got)
    langs = markup.arguments(markup.macros(df)).select(markup.noverb_languages(F.col("parts")).alias("x")).collect()
    assert langs[0].x == ["de", "en"] and langs[1].x == []


def test_places_do_not_move(spark):
    rows = [("\\verb!a\\b! \\lstinline{\\x} \\\\verb % \\c",)]
    got = spark.createDataFrame(rows, "t string").select(markup.mask_comments(markup.mask_verbatim(F.col("t"))).alias("x")).first().x
    assert len(got) == len(rows[0][0]) and got == "∖verb!a∖b! ∖lstinline{∖x} \\\\verb % ∖c"


def test_ancestors_and_cycles_end(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long")
    assert link.ancestors(loop).filter("node = 4").count() == 3
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (5, 6), (7, 7)], "src long, dst long")
    assert sorted(r.node for r in link.cyclic(edges).collect()) == [1, 2, 3, 7]


def test_vocabulary_ranks(spark):
    rows = [(d, p, t) for d, own in ((1, "b a a"), (70000, "c d b"), (200000, "d e a")) for p, t in enumerate(own.split())]
    got = features.vocabulary(spark.createDataFrame(rows, "doc_id long, pos long, token string")).orderBy("index").collect()
    assert [(r.token, r["index"]) for r in got] == [("a", 1), ("b", 2), ("d", 3), ("c", 4), ("e", 5)]


def test_math_environments(spark):
    text = "a $x$ b \\begin{align*}x\n\\end{align*} c"
    assert spark.createDataFrame([(text,)], "t string").select(tokens.mask_math(F.col("t")).alias("x")).first().x == "a  <math>  b  <math>  c"


def test_the_tagger_fits_as_spark_does_and_keeps_a_row_a_document(spark):
    """Coefficients are those of Spark's own fit, whose nine inputs a token were kept on disk; inputs are those of windows over the tokens."""
    rows = [(d, p, f"w{(d * 7 + p * p) % 11}", 1 + (d * 7 + p * p) % 5, int((d * p) % 7 == 0)) for d in range(12) for p in range(1 + d * 3)]
    tok = spark.createDataFrame(rows, "doc_id long, pos long, token string, len long, label int")
    data = tagger.inputs(tok, tok.filter("doc_id < 9"))
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange") + plan.count("Exchange hashpartitioning(label") + plan.count("Exchange SinglePartition")
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = features.tfidf_terms(features.keyphraseness_terms(features.packed(tok), features.keyphraseness(tok.filter("doc_id < 9"))), features.idf(tok.filter("doc_id < 9")))
    own = features.at_positions(own, "tfidf", "keyphraseness")
    own = own.withColumns({f"{side}{c}": F.coalesce(f(c).over(w), F.lit(0.0)) for c in tagger.COLUMNS for side, f in (("before_", F.lag), ("after_", F.lead))})
    held = lambda df: {tuple(round(float(r[c]), 9) for c in ("doc_id", "pos", *tagger.INPUTS)) for r in df.collect()}
    assert held(data) == held(own) and data.count() == len(rows)
    model = tagger.train(data).stages[-1]
    fit = LogisticRegression(featuresCol="x", labelCol="keyword", weightCol="weight", maxIter=10).fit(VectorAssembler(inputCols=tagger.INPUTS, outputCol="x").transform(data))
    assert [*model.coefficients, model.intercept] == pytest.approx([*fit.coefficients, fit.intercept], rel=1e-6, abs=1e-9)
