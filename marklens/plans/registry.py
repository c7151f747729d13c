"""All queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.functions import ranges
from marklens.operators import checks, evaluate, features, graph, link, markup, tokens
from marklens.sources import ingest
from marklens.sources.shared import checkpoint, new_path
from marklens.streaming import edits as editing

from .fixtures import IMPORT, Tables, opt, with_views

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        _SQL[name] = sql


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(*cols: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


TOK, ARGS, FILES, EDITS = with_views("tokens"), with_views("args"), with_views("files"), with_views("edits")
MODS, SYMS, DEPS, REFS = with_views("modules"), with_views("symbols"), with_views("deps"), with_views("refs")
ALL = with_views("modules", "symbols", "deps", "refs")

# --- flagship ------------------------------------------------------------------------------------


def _flagship(t: Tables) -> DataFrame:
    tok = t.tokens(together=True)
    out = features.tfidf_terms(features.terms(tok), features.idf(tok), order=None).select("doc_id", "token", F.round("tfidf", 9).alias("tfidf"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tfidf"), "token"))
    return out.withColumn("nth", best.cast("long")).filter("nth <= 20")


_add("flagship_tfidf_top", _flagship, TOK + """, n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens), d AS (SELECT token, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token),
 c AS (SELECT doc_id, token, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS tf FROM tokens GROUP BY doc_id, token)
SELECT doc_id, token, round(tf * log2(n / df), 9) AS tfidf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * log2(n / df), 9) DESC, token) AS nth
FROM c JOIN d USING (token), n QUALIFY nth <= 20""")

# --- F: features ---------------------------------------------------------------------------------


def _at(t: Tables, *more: str) -> DataFrame:
    """Tokens, those of a document together, with what a query needs of them; short positions, as they travel."""
    return t.tokens(together=True).select("doc_id", F.col("pos").cast("int").alias("pos"), "token", *more)


def _pos():
    return F.col("pos").cast("long").alias("pos")



_DF = TOK + ", n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens), d AS (SELECT token, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token), t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS c, count(*) OVER (PARTITION BY doc_id) AS l FROM tokens)"
_add("f1_idf", lambda t: features.idf(t.tokens()).select("token", "df", *_r("idf")), _DF + " SELECT token, df, round(log2(n / df), 6) AS idf FROM d, n")
_add("f2_term_frequency", lambda t: features.term_frequency(_at(t)).select("doc_id", _pos(), *_r("tf")), _DF + " SELECT doc_id, pos, round(c / l, 6) AS tf FROM t")
_add("f3_tfidf", lambda t: features.tfidf(tok := _at(t), features.idf(tok)).select("doc_id", _pos(), *_r("tfidf")),
     _DF + ", x AS (SELECT doc_id, pos, c / l * log2(n / df) AS v FROM t JOIN d USING (token), n) SELECT doc_id, pos, round(coalesce(v / nullif(sum(abs(v)) OVER (PARTITION BY doc_id), 0), 0), 6) AS tfidf FROM x")
_add("f4_tfidf_leave_one_out", lambda t: features.tfidf_leave_one_out(_at(t)).select("doc_id", _pos(), *_r("tfidf")),
     _DF + ", x AS (SELECT doc_id, pos, c / l * CASE WHEN df > 1 THEN log2((n - 1) / (df - 1)) ELSE 0 END AS v FROM t JOIN d USING (token), n) SELECT doc_id, pos, round(coalesce(v / nullif(sum(abs(v)) OVER (PARTITION BY doc_id), 0), 0), 6) AS tfidf FROM x")
_add("f5_norm_order_2", lambda t: features.normalise(t.tokens().withColumn("x", F.col("len").cast("double")), "x", 2).select("doc_id", "pos", *_r("x")),
     TOK + " SELECT doc_id, pos, round(len / sqrt(sum(len * len) OVER (PARTITION BY doc_id)), 6) AS x FROM tokens")
_add("f6_word_counts", lambda t: features.word_counts(t.tokens()), TOK + " SELECT token, count(*) AS n_words FROM tokens GROUP BY token")
_CHI = _DF + ", w AS (SELECT token, count(*) AS w FROM tokens GROUP BY token), s AS (SELECT count(*) AS total FROM tokens)"
_add("f7_chi_square", lambda t: features.chi_square(_at(t)).select("doc_id", _pos(), *_r("chi2", n=4)),
     _CHI + " SELECT doc_id, pos, round(coalesce((c - w / n) ** 2 / nullif(w / n, 0), 0) + coalesce((l - c - (total - w) / n) ** 2 / nullif((total - w) / n, 0), 0), 4) AS chi2 FROM t JOIN w USING (token), n, s")
_add("f8_chi_square_leave_one_out", lambda t: features.chi_square_leave_one_out(_at(t)).select("doc_id", _pos(), *_r("chi2", n=4)),
     _CHI + " SELECT doc_id, pos, round(CASE WHEN w - c > 0 THEN coalesce((c - (w - c) / (n - 1)) ** 2 / nullif((w - c) / (n - 1), 0), 0) + coalesce((l - c - (total - l) / (n - 1)) ** 2 / nullif((total - l) / (n - 1), 0), 0) ELSE 0 END, 4) AS chi2 FROM t JOIN w USING (token), n, s")
_CHI_NORM = """, x AS (SELECT doc_id, pos, coalesce((c - w / n) ** 2 / nullif(w / n, 0), 0) + coalesce((l - c - (total - w) / n) ** 2 / nullif((total - w) / n, 0), 0) AS v FROM t JOIN w USING (token), n, s)
SELECT doc_id, pos, round(coalesce(v / nullif(sum(abs(v)) OVER (PARTITION BY doc_id), 0), 0), 6) AS chi2 FROM x"""
_add("f7_chi_square_normalised", lambda t: features.chi_square(_at(t), 1).select("doc_id", _pos(), *_r("chi2")), _CHI + _CHI_NORM)
_KEY = TOK + ", k AS (SELECT token, count(*) FILTER (label <> 0) AS kf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token)"
_add("f9_keyphraseness", lambda t: features.keyphraseness(t.tokens()).select("token", "kf", "df", *_r("keyphraseness")), _KEY + " SELECT token, kf, df, round(kf / df, 6) AS keyphraseness FROM k")
_add("f10_keyphraseness_transform", lambda t: features.keyphraseness_transform(_at(t), features.keyphraseness(_at(t, "label").filter("doc_id % 10 < 7"))).select("doc_id", _pos(), *_r("keyphraseness")),
     TOK + ", k AS (SELECT token, count(*) FILTER (label <> 0) / count(DISTINCT doc_id) AS v FROM tokens WHERE doc_id % 10 < 7 GROUP BY token) SELECT doc_id, pos, round(coalesce(v, 0), 6) AS keyphraseness FROM tokens LEFT JOIN k USING (token)")
_add("f11_keyphraseness_leave_one_out", lambda t: features.keyphraseness_leave_one_out(_at(t, "label")).select("doc_id", _pos(), *_r("keyphraseness")),
     _KEY + ", o AS (SELECT *, count(*) FILTER (label <> 0) OVER (PARTITION BY doc_id, token) AS own FROM tokens) SELECT doc_id, pos, round(CASE WHEN df > 1 THEN (kf - own) / (df - 1) ELSE 0 END, 6) AS keyphraseness FROM o JOIN k USING (token)")
_VOC = TOK + ", v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 1000000 + pos)) AS index FROM tokens GROUP BY token)"
_add("f12_vocabulary", lambda t: features.vocabulary(t.tokens()), _VOC + " SELECT token, index FROM v")
_add("f13_encode", lambda t: features.encode(tok := t.tokens(), features.vocabulary(tok)).select("doc_id", "pos", "index"), _VOC + " SELECT doc_id, pos, index FROM tokens JOIN v USING (token)")
_add("f13_unknown", lambda t: features.unknown(tok := t.tokens(), features.vocabulary(tok.filter("doc_id % 10 < 7"))).select("doc_id", "pos", "token"),
     TOK + ", k AS (SELECT DISTINCT token FROM tokens WHERE doc_id % 10 < 7) SELECT doc_id, pos, token FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.token = t.token)")
_add("f14_decode", lambda t: features.decode(features.encode(tok := t.tokens(), v := features.vocabulary(tok)), v).select("doc_id", "pos", "token"), TOK + " SELECT doc_id, pos, token FROM tokens")


def _words(t: Tables) -> DataFrame:
    return t.table("embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"))


_EMB = TOK + ", e AS (SELECT CAST(vec_id AS VARCHAR) AS token, embedding AS vec FROM embeddings)"


def _sum():
    return F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total")


_add("f15_embed_zero", lambda t: features.embed(_at(t), _words(t), 64).select("doc_id", _pos(), _sum()), _EMB + " SELECT doc_id, pos, round(coalesce(list_sum(CAST(vec AS DOUBLE[])), 0), 4) AS total FROM tokens LEFT JOIN e USING (token)")
_add("f15_embed_drop", lambda t: features.embed(_at(t), _words(t), 64, "drop").select("doc_id", _pos(), _sum()), _EMB + " SELECT doc_id, pos, round(list_sum(CAST(vec AS DOUBLE[])), 4) AS total FROM tokens JOIN e USING (token)")
_add("f15_embed_random", lambda t: features.embed(_at(t), _words(t), 64, "random").select("doc_id", _pos(), _sum()),
     with_views("tokens", recursive=True) + """, e AS (SELECT CAST(vec_id AS VARCHAR) AS token, embedding AS vec FROM embeddings),
 r AS (SELECT 1 AS i, CAST(12345 AS BIGINT) AS x UNION ALL SELECT i + 1, (1103515245 * x + 12345) % 2147483648 FROM r WHERE i < 64),
 u AS (SELECT sum(CAST(CAST(x / 1073741824 - 1 AS FLOAT) AS DOUBLE)) AS other FROM r)
SELECT doc_id, pos, round(coalesce(list_sum(CAST(vec AS DOUBLE[])), other), 4) AS total FROM tokens LEFT JOIN e USING (token), u""")
_add("f16_moments", lambda t: features.moments(t.table("embeddings"), "embedding").select(*_r("mean", "std")),
     "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
_add("f18_vocabulary_cut", lambda t: features.vocabulary(t.tokens()).filter("index <= 1000"), _VOC + " SELECT token, index FROM v WHERE index <= 1000")
_add("f19_one_hot", lambda t: features.one_hot(e := t.table("events").select("event_id", "event_type"), "event_type", e.filter("event_type <> 'click'")).select("event_id", F.concat_ws("", "one_hot").alias("bits")),
     "WITH c AS (SELECT list_sort(list(DISTINCT event_type)) AS cats FROM events WHERE event_type <> 'click') SELECT event_id, array_to_string(list_transform(cats, lambda x: CAST(x = event_type AS INT)), '') AS bits FROM events, c")


def _lines(t: Tables) -> DataFrame:
    return t.tokens().groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "len"))), lambda x: x.len).alias("xs"))


_add("f20_pad", lambda t: features.pad_front(_lines(t), "xs").select("doc_id", F.size("padded").cast("long").alias("n"), F.array_join(features.unpad(F.col("padded"), F.size("xs")), ",").alias("back")),
     TOK + ", x AS (SELECT doc_id, list(len ORDER BY pos) AS xs FROM tokens GROUP BY doc_id) SELECT doc_id, (SELECT max(len(xs)) FROM x) AS n, array_to_string(xs, ',') AS back FROM x")
_add("f21_label_from_environments", lambda t: tokens.enclosing(a := t.args().filter("name NOT IN ('begin', 'end')"), tokens.environments(t.args())).select("path", "pos", F.when(F.exists("envs", lambda e: e.rlike("tref|omtext")), 1).when(F.exists("envs", lambda e: e.rlike("def|mod")), 2).otherwise(0).alias("label")),
     ARGS + ", g AS (SELECT path, pos, name, CASE WHEN name = 'begin' THEN 1 ELSE -1 END AS step, rargs[1] AS env FROM args WHERE name IN ('begin', 'end')), h AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY pos) + (step = -1)::INT AS depth FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY path, depth, step ORDER BY pos) AS nth FROM h), e AS (SELECT a.path, a.env, a.pos AS b, coalesce(z.pos, 1099511627776) AS f FROM i a LEFT JOIN i z ON a.path = z.path AND a.depth = z.depth AND a.nth = z.nth AND z.step = -1 WHERE a.step = 1) SELECT a.path, a.pos, CASE WHEN bool_or(regexp_matches(e.env, 'tref|omtext')) THEN 1 WHEN bool_or(regexp_matches(e.env, 'def|mod')) THEN 2 ELSE 0 END AS label FROM args a LEFT JOIN e ON a.path = e.path AND e.b < a.pos AND e.f > a.pos WHERE a.name NOT IN ('begin', 'end') GROUP BY a.path, a.pos")
_add("f22_split", lambda t: t.table("documents").select("doc_id", features.split_of(F.col("doc_id")).alias("part")), "SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS part FROM documents")
_add("f23_class_weights", lambda t: features.class_weights(t.tokens()).select("label", "n", *_r("weight")), TOK + " SELECT label, count(*) AS n, round(-ln(count(*) / sum(count(*)) OVER ()), 6) AS weight FROM tokens GROUP BY label")
_add("f23_class_weights_padded", lambda t: features.class_weights(t.tokens(), True).select("label", "n", *_r("weight")),
     TOK + ", l AS (SELECT doc_id, count(*) AS l FROM tokens GROUP BY doc_id), p AS (SELECT max(l) * count(*) - sum(l) AS pads FROM l), c AS (SELECT label, CAST(count(*) + CASE WHEN label = 0 THEN max(pads) ELSE 0 END AS BIGINT) AS n FROM tokens, p GROUP BY label) SELECT label, n, round(-ln(n / sum(n) OVER ()), 6) AS weight FROM c")
_add("f24_sample_weights", lambda t: (tok := t.tokens()).join(F.broadcast(features.class_weights(tok)), "label").select("doc_id", "pos", *_r("weight")),
     TOK + ", w AS (SELECT label, -ln(count(*) / sum(count(*)) OVER ()) AS weight FROM tokens GROUP BY label) SELECT doc_id, pos, round(weight, 6) AS weight FROM tokens JOIN w USING (label)")


def _assembled(t: Tables) -> DataFrame:
    tok = _at(t, "label")
    values = features.tfidf_terms(features.packed(tok.drop("label")), features.word_values(tok), more=("keyphraseness",))
    out = features.at_positions(values, "tfidf", "keyphraseness")
    return out.select("doc_id", "pos", F.concat(F.array(*_r("tfidf", "keyphraseness")), F.array(F.length("token").cast("double"))).alias("features"))


_add("f25_assembly", lambda t: _assembled(t).select("doc_id", _pos(), *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3))),
     _DF + ", x AS (SELECT doc_id, pos, token, t.len, c / l * log2(n / df) AS v FROM t JOIN d USING (token), n), k AS (SELECT token, count(*) FILTER (label <> 0) / count(DISTINCT doc_id) AS kp FROM tokens GROUP BY token) SELECT doc_id, pos, round(coalesce(v / nullif(sum(abs(v)) OVER (PARTITION BY doc_id), 0), 0), 6) AS f0, round(kp, 6) AS f1, CAST(len AS DOUBLE) AS f2 FROM x JOIN k USING (token)")
_add("f26_vocabulary_set", lambda t: t.tokens().select("token").distinct(), TOK + " SELECT DISTINCT token FROM tokens")

# --- E: evaluation -------------------------------------------------------------------------------


def _pairs(t: Tables) -> DataFrame:
    return t.tokens().select(F.col("label").alias("y_true"), F.col("pred").alias("y_pred"), "len")


_CM = TOK + ", m AS (SELECT label AS y_true, pred AS y_pred, count(*) AS n, CAST(sum(len) AS BIGINT) AS w FROM tokens GROUP BY ALL)"
_add("e1_confusion", lambda t: evaluate.confusion(_pairs(t)), _CM + " SELECT y_true, y_pred, n FROM m")
_add("e2_weighted_confusion", lambda t: evaluate.confusion(_pairs(t), "len"), _CM + " SELECT y_true, y_pred, w AS n FROM m")
_add("e3_normalised_confusion", lambda t: evaluate.row_normalised(evaluate.confusion(_pairs(t))).select("y_true", "y_pred", *_r("share")), _CM + " SELECT y_true, y_pred, round(n / sum(n) OVER (PARTITION BY y_true), 6) AS share FROM m")
_add("e4_accuracy", lambda t: evaluate.accuracy(_pairs(t)).select(*_r("accuracy")), TOK + " SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM tokens")
_SC = _CM + ", c AS (SELECT k AS label, sum(CASE WHEN y_true = k AND y_pred = k THEN n ELSE 0 END) AS tp, sum(CASE WHEN y_true <> k AND y_pred = k THEN n ELSE 0 END) AS fp, sum(CASE WHEN y_true = k AND y_pred <> k THEN n ELSE 0 END) AS fn, sum(n) AS n FROM m, (SELECT DISTINCT y_true AS k FROM m UNION SELECT DISTINCT y_pred FROM m) GROUP BY k), s AS (SELECT label, (n - fp - fn) / n AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp, fp, fn FROM c)"
_add("e5_class_scores", lambda t: evaluate.class_scores(_pairs(t)).select("label", *_r("accuracy", "recall", "precision", "f1")), _SC + " SELECT label, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM s")
_add("e6_macro_average", lambda t: evaluate.averages(evaluate.class_scores(_pairs(t))).select(*_r("recall", "precision", "f1")), _SC + " SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1 FROM s")
_add("e6_micro_average", lambda t: evaluate.averages(evaluate.class_scores(_pairs(t)), "micro").select(*_r("recall", "precision", "f1")), _SC + " SELECT round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM s")
_add("e6_binary_average", lambda t: evaluate.averages(evaluate.class_scores(t.table("labels").select(F.col("toxic").cast("int").alias("y_true"), (1 - F.col("quality")).cast("int").alias("y_pred"))), "binary").select(*_r("recall", "precision", "f1")),
     "WITH x AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels) SELECT round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM x")
_add("e7_score_table", lambda t: evaluate.score_table(evaluate.class_scores(_pairs(t)), True).select("row", "metric", *_r("score")),
     _SC + ", a AS (SELECT CAST(label AS VARCHAR) AS row, recall, precision, f1 FROM s UNION ALL SELECT 'average', avg(recall), avg(precision), avg(f1) FROM s) SELECT row, metric, round(score, 6) AS score FROM (UNPIVOT a ON recall, precision, f1 INTO NAME metric VALUE score)")

# --- T: text -------------------------------------------------------------------------------------

_TEX = with_views("tex_sources")
_add("t1_strip_comments", lambda t: t.tex_sources().select("path", tokens.strip_comments(F.col("text")).alias("text")), _TEX + r" SELECT path, regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g') AS text FROM tex_sources")
_MATH_SQL = tokens.MATH.replace("'", "''")
_add("t2_mask_math", lambda t: t.tex_sources().select("path", tokens.mask_math(F.col("text")).alias("text")), _TEX + f" SELECT path, regexp_replace(text, '{_MATH_SQL}', ' <math> ', 'g') AS text FROM tex_sources")
_add(
    "t3_verbatim",
    lambda t: t.tex_sources().filter("kind = 'mono'").select("path", markup.mask_verbatim(F.col("text")).alias("text")),
    # what is verbatim in this fixture, by its own text
    _TEX + """ SELECT path, replace(replace(text, chr(92) || 'verb|' || chr(92) || 'defi{no}|', '∖verb|∖defi{no}|'),
 concat(chr(92), 'begin{verbatim}', chr(10), chr(92), 'symi{no}', chr(10), chr(92), 'end{verbatim}'), concat('∖begin{verbatim}', chr(10), '∖symi{no}', chr(10), '∖end{verbatim}')) AS text
FROM tex_sources WHERE kind = 'mono'""",
)
_W = r"WITH x AS (SELECT doc_id, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:''s)?|[!$%&()\-''.?,:;" + '"' + r"|]') AS a FROM documents))"
_add("t4_words", lambda t: tokens.words(t.table("documents"), "doc_id", F.col("text")).withColumn("pos", F.col("pos").cast("long")), _W + " SELECT doc_id, pos, token FROM x")
_add("t5_drop_structural", lambda t: tokens.drop_structural(tokens.words(t.table("documents"), "doc_id", F.col("text"))), _W + r" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token FROM x WHERE NOT regexp_matches(token, '^[!$%&()\-''.?,:;" + '"' + "|]+$')")
_add("t6_lower", lambda t: tokens.words(t.table("documents"), "doc_id", F.lower("text")).groupBy("token").agg(F.count("*").alias("n")), _W.replace("regexp_extract_all(text", "regexp_extract_all(lower(text)") + " SELECT token, count(*) AS n FROM x GROUP BY token")


def _lc(t: Tables) -> DataFrame:
    x = t.tex_sources().select("path", "text", F.explode(F.array(F.lit(0), F.lit(9), F.lit(25), F.length("text") - 1)).alias("off"))
    line, char = tokens.line_and_character(F.col("text"), F.col("off"))
    return x.select("path", F.col("off").cast("long").alias("off"), line.cast("long").alias("line"), char.cast("long").alias("character"))


_add("t7_line_and_character", _lc, _TEX + ", x AS (SELECT path, text, unnest([0, 9, 25, length(text) - 1]) AS off FROM tex_sources), y AS (SELECT path, off, substr(text, 1, off) AS b FROM x) SELECT path, CAST(off AS BIGINT) AS off, CAST(length(b) - length(replace(b, chr(10), '')) AS BIGINT) AS line, CAST(length(string_split(b, chr(10))[-1]) AS BIGINT) AS character FROM y")
def _pieces(t: Tables) -> DataFrame:
    ranges = t.tex_sources().select("path", "text", F.explode(F.array(F.struct(F.lit(5).alias("begin"), F.lit(25).alias("end")), F.struct(F.lit(40).alias("begin"), F.length("text").alias("end")))).alias("r"))
    return ranges.select("path", "r.begin", tokens.text_at(F.col("text"), F.col("r.begin"), F.col("r.end")).alias("piece"))


_add("t8_text_at_range", _pieces, _TEX + " SELECT path, 5 AS begin, substr(text, 6, 20) AS piece FROM tex_sources UNION ALL SELECT path, 40, substr(text, 41) FROM tex_sources")
_ENV = with_views("envs")
_add("t9_enclosing", lambda t: tokens.enclosing(t.args().filter("name NOT IN ('begin', 'end')"), tokens.environments(t.args())).select("path", "pos", F.array_join("envs", ">").alias("envs")),
     _ENV + " SELECT a.path, a.pos, coalesce(string_agg(e.env, '>' ORDER BY e.begin_pos), '') AS envs FROM args a LEFT JOIN envs e ON a.path = e.path AND e.begin_pos < a.pos AND coalesce(e.end_pos, 1099511627776) > a.pos WHERE a.name NOT IN ('begin', 'end') GROUP BY a.path, a.pos")
_add("t10_outermost", lambda t: tokens.outermost(tokens.environments(t.args()), "^(mhmodnl|omtext)$").select("path", "env", "begin_pos"),
     _ENV + ", m AS (SELECT * FROM envs WHERE env IN ('mhmodnl', 'omtext')) SELECT path, env, begin_pos FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.path = m.path AND o.begin_pos < m.begin_pos AND coalesce(o.end_pos, 1099511627776) > m.begin_pos)")
_add("t11_balance", lambda t: tokens.unbalanced(tokens.environments(t.args())).select("path", "env", "begin_pos", "end_env"), _ENV + " SELECT path, env, begin_pos, end_env FROM envs WHERE end_pos IS NULL OR env <> end_env")
def _escaped() -> list[tuple[str, str]]:
    return [(chr(92) + '"' + a, b) for a, b in zip("aouAOU", "äöüÄÖÜ")] + [(chr(92) + "ss", "ß")]


_GERMAN = "text"
for _a, _b in _escaped():
    _GERMAN = f"replace({_GERMAN}, '{_a}', '{_b}')"
_add("t12_german", lambda t: t.tex_sources().select("path", tokens.german(F.col("text")).alias("text")), _TEX + f" SELECT path, {_GERMAN} AS text FROM tex_sources")

# --- X: markup -----------------------------------------------------------------------------------

_PLACED = with_views("placed")
_SUFFIX = "regexp_extract(name, '(?:sym|def|tref|dref|Def|Tref|Dref)([ivx]+)s?[*]?$', 1)"
_ROMAN = "['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii']"
_WANTED = f"list_position({_ROMAN}, {_SUFFIX}) + regexp_matches(name, '^m?am?[dDtT]')::INT"
_add("x1_macros", lambda t: markup.with_offsets(t.macros()).select("path", "pos", "name", "oarg", "rarg", "place"), with_views("macros") + " SELECT path, pos, name, oarg, rarg, place FROM macros")
_add(
    "x2_arguments",
    lambda t: t.args().select("path", "pos", F.array_join("rargs", "|").alias("rargs"), F.array_join(markup.unnamed(F.col("parts")), "|").alias("plain"), markup.named(F.col("parts"), "load").alias("load"), markup.named(F.col("parts"), "noverb").alias("noverb")),
    ARGS + f" SELECT path, pos, array_to_string(rargs, '|') AS rargs, array_to_string(list_filter(parts, lambda x: NOT contains(x, '=')), '|') AS plain, {opt('load')} AS load, {opt('noverb')} AS noverb FROM args",
)
_add(
    "x3_kinds",
    lambda t: markup.kinds(t.args()).groupBy("kind", "arity_error").agg(F.count("*").alias("n")),
    ARGS + f""", k AS (SELECT *, CASE WHEN name IN ('begin', 'end') THEN 'environment' WHEN {IMPORT} THEN 'import' WHEN regexp_matches(name, '^(sym[ivx]+|symdef|vardef)[*]?$') THEN 'symbol'
 WHEN regexp_matches(name, '^[ma]*[dDtT]ref[ivx]+s?[*]?$') THEN 'reference' WHEN regexp_matches(name, '^[ma]*[dD]ef[ivx]+s?[*]?$') THEN 'definition' WHEN regexp_matches(name, '^[tv]assign[*]?$') THEN 'assignment' ELSE 'other' END AS kind FROM args)
SELECT kind, coalesce({_SUFFIX} <> '' AND len(rargs) <> {_WANTED}, false) AS arity_error, count(*) AS n FROM k GROUP BY ALL""",
)
_add("x4_modules", lambda t: t.modules(), MODS + " SELECT path, pos, module, module_type, access FROM modules")
_add("x5_bindings", lambda t: t.bindings(), with_views("bindings") + " SELECT path, pos, module, lang FROM bindings")
_add(
    "x5_implied_signature",
    lambda t: t.deps().filter("quiet AND macro = 'mhmodnl'").select("path", "pos", "module", "hint"),
    with_views("bindings") + " SELECT path, pos, module, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || module || '.tex' AS hint FROM bindings",
)
_LANGS = "array_to_string(noverbs, ',') AS noverbs"
_add(
    "x6_symbols",
    lambda t: t.symbols().select("path", "module", "pos", "name", "def_type", "noverb", F.array_join("noverbs", ",").alias("noverbs")),
    SYMS + f" SELECT path, module, pos, name, def_type, noverb, {_LANGS} FROM symbols",
)
_add("x7_references", lambda t: t.refs(), REFS + " SELECT path, pos, nth, macro, target, module, symbol, scope FROM refs")
_add("x8_dependencies", lambda t: t.deps().select("path", "pos", "module", "macro", "export", "quiet"), DEPS + " SELECT path, pos, module, macro, export, quiet FROM deps")
_add("x9_scopes", lambda t: t.envs().filter(F.col("env").isin(*markup.SCOPE_ENVS)).select("path", "env", "begin_pos", "end_pos"), _ENV + " SELECT path, env, begin_pos, end_pos FROM envs WHERE env IN ('omtext', 'nomtext', 'example', 'omgroup', 'frame')")
_add(
    "x10_symbol_names",
    lambda t: t.args().filter(F.col("name").rlike("^(a?tref|a?def)ii?$")).select("path", "pos", markup.symbol_name(F.col("name"), F.col("rargs"), F.col("parts")).alias("symbol")),
    ARGS + f" SELECT path, pos, coalesce({opt('name')}, array_to_string(CASE WHEN name LIKE 'a%' THEN rargs[2:] ELSE rargs END, '-')) AS symbol FROM args WHERE regexp_matches(name, '^(a?tref|a?def)ii?$')",
)
_add("x11_targets", lambda t: t.refs().select("path", "pos", "module", "symbol").filter("module IS NOT NULL"), REFS + " SELECT path, pos, module, symbol FROM refs WHERE module IS NOT NULL")
_add(
    "x12_noverb",
    lambda t: t.symbols().filter(F.col("noverb") | (F.size("noverbs") > 0)).select("path", "name", "noverb", F.array_join("noverbs", ",").alias("noverbs")),
    SYMS + f" SELECT path, name, noverb, {_LANGS} FROM symbols WHERE noverb OR len(noverbs) > 0",
)
_add("x13_import_paths", lambda t: t.deps().select("path", "pos", "module", "hint"), DEPS + " SELECT path, pos, module, hint FROM deps")
_ERROR = f"""CASE WHEN regexp_matches(name, '^(import|use)mhmodule[*]?$') THEN CASE WHEN {opt('dir')} IS NOT NULL AND {opt('path')} IS NOT NULL THEN 'dir and path'
  WHEN coalesce({opt('mhrepos')}, {opt('repos')}) IS NOT NULL AND {opt('dir')} IS NULL AND {opt('path')} IS NULL THEN 'mhrepos without dir or path' WHEN {opt('load')} IS NOT NULL THEN 'load not allowed' END
 WHEN regexp_matches(name, '^(import|use)module[*]?$') THEN CASE WHEN coalesce({opt('mhrepos')}, {opt('repos')}, {opt('dir')}, {opt('path')}) IS NOT NULL THEN 'mhrepos, dir or path not allowed' WHEN {opt('load')} IS NULL THEN 'load missing' END END"""
_add(
    "x14_import_validation",
    lambda t: t.args().select("path", "pos", markup.import_error(F.col("name"), F.col("parts")).alias("why")).filter("why IS NOT NULL"),
    ARGS + f" SELECT * FROM (SELECT path, pos, {_ERROR} AS why FROM args) WHERE why IS NOT NULL",
)
_add(
    "x15_displayed",
    lambda t: t.args().filter(F.col("name").rlike(markup.REFERENCE) | F.col("name").rlike(markup.DEFINITION)).select("path", "pos", markup.displayed(F.col("name"), F.col("rargs")).alias("shown")),
    ARGS + """, d AS (SELECT path, pos, name, CASE WHEN regexp_matches(name, '^m?am?[dDtT]') THEN rargs[1] ELSE array_to_string(rargs, ' ') END AS own FROM args WHERE regexp_matches(name, '^[ma]*([dDtT]ref|[dD]ef)[ivx]+s?[*]?$'))
SELECT path, pos, CASE WHEN regexp_matches(name, '^[ma]*[DT]') THEN upper(own[1]) || own[2:] ELSE own END || CASE WHEN regexp_matches(name, '[ivx]s[*]?$') THEN 's' ELSE '' END AS shown FROM d""",
)

# --- L: linking ----------------------------------------------------------------------------------

_add("l1_type_masks", lambda t: t.table("events").select("event_id", link.contained(F.col("event_id").bitwiseAND(3), F.col("user_id").bitwiseAND(7)).alias("inside"), link.overlaps(F.col("event_id").bitwiseAND(3), F.col("user_id").bitwiseAND(7)).alias("meets")),
     "SELECT event_id, (user_id & 7) & (event_id & 3) = (event_id & 3) AS inside, (user_id & 7) & (event_id & 3) <> 0 AS meets FROM events".replace("(user_id & 7) & (event_id & 3)", "((user_id & 7) & (event_id & 3))"))
_AGAIN = "(def_type IN ('symdef', 'dref') OR (def_type = 'def' AND module_type IN ('module', 'module*', 'smentry')))"
_DUP = f"SELECT path, pos, module, name, first_pos FROM (SELECT *, row_number() OVER w AS nth, first_value(pos) OVER w AS first_pos FROM symbols WINDOW w AS (PARTITION BY path, module, name, def_type ORDER BY pos)) WHERE nth > 1 AND NOT {_AGAIN}"
_REDEF = f"""SELECT path, pos, module, name, first_pos FROM (SELECT *, first_value(pos) OVER w AS first_pos, first_value(def_type) OVER w AS d, first_value(noverb) OVER w AS v, first_value(array_to_string(noverbs, ',')) OVER w AS vs
 FROM symbols WINDOW w AS (PARTITION BY path, module, name ORDER BY pos)) WHERE (d <> def_type OR v <> noverb OR vs <> array_to_string(noverbs, ',')) AND {_AGAIN}"""
_add("l2_duplicate_symbols", lambda t: link.duplicate_symbols(t.symbols()).select("path", "pos", "name", "first_pos"), SYMS + f" SELECT path, pos, name, first_pos FROM ({_DUP})")
_add("l3_invalid_redefinition", lambda t: link.invalid_redefinitions(t.symbols()).select("path", "pos", "name", "first_pos"), SYMS + f" SELECT path, pos, name, first_pos FROM ({_REDEF})")
_REDUNDANT = """SELECT d.path, d.pos, d.module, min(b.pos) AS first_pos FROM deps d JOIN (SELECT x.path, x.module, x.pos, coalesce(max(begin_pos), -1) AS b, coalesce(arg_max(coalesce(end_pos, 1099511627776), begin_pos), 1099511627776) AS f
  FROM deps x LEFT JOIN envs e ON e.path = x.path AND begin_pos < x.pos AND coalesce(end_pos, 1099511627776) > x.pos GROUP BY ALL) b
 ON b.path = d.path AND b.module = d.module AND b.pos < d.pos AND b.b < d.pos AND b.f > d.pos WHERE NOT d.quiet GROUP BY ALL"""
_add("l4_redundant_imports", lambda t: link.redundant_imports(t.deps(), t.envs()).select("path", "pos", "module", "first_pos"), DEPS + f" SELECT path, pos, module, first_pos FROM ({_REDUNDANT})")
_L5 = with_views("deps", "modules")
_STATUS = """SELECT d.*, coalesce(n, 0) AS n_modules, CASE WHEN NOT EXISTS (SELECT 1 FROM tex_sources t WHERE t.path = d.hint) THEN 'file-not-found' WHEN n IS NULL THEN 'undefined-module-not-exported'
  WHEN n > 1 THEN 'unique-dependency-name-check' WHEN access = 3 THEN 'access-modifier-check' ELSE 'ok' END AS status
 FROM deps d LEFT JOIN (SELECT path AS hint, module, count(*) AS n, max(access) AS access FROM modules GROUP BY ALL) m ON m.hint = d.hint AND m.module = d.module"""
_add("l5_module_resolution", lambda t: link.resolve_modules(t.deps(), t.modules(), t.tex_sources()).select("path", "pos", "module", "n_modules", "status"), _L5 + f" SELECT path, pos, module, n_modules, status FROM ({_STATUS})")
_add("l6_file_not_found", lambda t: link.resolve_modules(t.deps(), t.modules(), t.tex_sources()).filter("status = 'file-not-found'").select("path", "pos", "hint"), DEPS + " SELECT path, pos, hint FROM deps WHERE hint IS NULL OR hint NOT IN (SELECT path FROM tex_sources)")
_GRAPH = with_views("deps", "modules", recursive=True) + ", edges AS (SELECT DISTINCT m.module AS src, d.module AS dst, export FROM deps d JOIN modules m USING (path))"


def _edges(t: Tables) -> DataFrame:
    return t.deps().join(t.modules().select("path", F.col("module").alias("src")), "path").select("src", F.col("module").alias("dst"), "export").distinct()


_NRV = len(with_views("deps", "modules", recursive=True))
_CLOSE = _GRAPH + ", c AS (SELECT src AS root, dst AS node FROM edges UNION SELECT root, dst FROM c JOIN edges ON node = src WHERE export)"
_add("l9_import_closure", lambda t: link.reach_ends(*link.reached(_edges(t))), _CLOSE + " SELECT root, count(*) AS n, min(node) AS low, max(node) AS high FROM c GROUP BY root")
_add("l10_cyclic_imports", lambda t: link.cyclic(_edges(t)), _CLOSE.replace("WHERE export", "") + " SELECT a.root AS node, min(a.node) AS component FROM c a JOIN c b ON b.root = a.node AND b.node = a.root GROUP BY a.root")


def _seen_counts(t: Tables) -> DataFrame:
    s = checkpoint(t.symbols().select("module", "name").distinct())
    sets, names = link.reached(_edges(t))
    own = graph.numbered(graph.numbered(s, "module", names), "name", graph.numbers(s.select("name")))
    out = link.visible_symbols(sets, own).groupBy("root").agg(F.count("*").alias("n"))
    return out.join(names, F.col("root") == F.col("id"), "left").select(F.col("name").alias("root"), "n")


_add("l11_visible_symbols", _seen_counts,
     with_views("deps", "modules", "symbols", recursive=True) + _CLOSE[_NRV:] + " SELECT root, count(*) AS n FROM (SELECT DISTINCT root, name FROM c JOIN symbols ON module = node EXCEPT SELECT module, name FROM symbols) GROUP BY root")
_add("l12_pruned_closure", lambda t: link.reach_ends(*link.reached(_edges(t), t.modules().filter(F.col("module").rlike("5$")).select(F.col("module").alias("node")))).select("root", "n"), _CLOSE + " SELECT root, count(*) AS n FROM c WHERE root LIKE '%5' AND root IN (SELECT module FROM modules) GROUP BY root")
_UND = ALL + ", u AS (SELECT r.* FROM refs r WHERE module IS NOT NULL AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.module = r.module AND s.name = r.symbol))"
_add("l15_parent_gate", lambda t: link.gated(t.refs(), t.modules(), t.symbols()).select("path", "pos", "module", "symbol"), _UND + " SELECT path, pos, module, symbol FROM u WHERE module IN (SELECT module FROM modules)")
_add("l16_undefined_symbols", lambda t: link.undefined_symbols(t.refs(), t.symbols()).select("path", "pos", "module", "symbol"), _UND + " SELECT path, pos, module, symbol FROM u")
LINKED = with_views("modules", "bindings", "symbols", "deps", "refs")
_NOVERB = """SELECT DISTINCT r.path, r.pos, r.module, r.symbol FROM refs r JOIN symbols s ON s.module = r.module AND s.name = r.symbol LEFT JOIN (SELECT path, arg_min(lang, pos) AS lang FROM bindings GROUP BY path) b ON b.path = r.path
 WHERE s.noverb OR list_contains(s.noverbs, b.lang)"""
_MISNAMED = r"""SELECT path, pos, module, regexp_extract(path, '([^/]+)\.tex$', 1) AS stem FROM (SELECT path, pos, module FROM modules WHERE module_type IN ('modsig', 'gviewsig') UNION ALL SELECT path, pos, concat_ws('.', module, lang) FROM bindings)
 WHERE module <> regexp_extract(path, '([^/]+)\.tex$', 1)""".replace("\\\\", "\\")
_CURRENT = f"""SELECT path, pos, what FROM (SELECT path, pos, CASE WHEN CASE WHEN regexp_matches(name, '^g') THEN list_filter(parts, lambda x: NOT contains(x, '='))[1] ELSE coalesce({opt('mhrepos')}, {opt('repos')}) END = regexp_extract(path, '/([^/]+)/source/', 1) THEN 'repository'
  WHEN {opt('dir')} = regexp_extract(path, '/source/(.*)/[^/]*$', 1) THEN 'dir' WHEN {opt('path')} = regexp_extract(path, '/source/(.*)[.]tex$', 1) THEN 'path' END AS what FROM args WHERE {IMPORT}) WHERE what IS NOT NULL"""
_add("l18_noverb_references", lambda t: link.noverb_references(t.refs(), t.symbols(), t.bindings()).select("path", "pos", "symbol"), LINKED + f" SELECT path, pos, symbol FROM ({_NOVERB})")
_add("l19_name_mismatch", lambda t: link.name_mismatches(t.modules(), t.bindings()).select("path", "module", "stem"), LINKED + f" SELECT path, module, stem FROM ({_MISNAMED})")
_add("l20_redundant_repository", lambda t: link.current_places(t.args()), ARGS + f" {_CURRENT}")
_add("l22_deprecated", lambda t: checks.deprecated(t.args()).select("path", "pos", "code"), ARGS + " SELECT path, pos, 'mtref-deprecation-check' AS code FROM args WHERE name LIKE 'mtref%' UNION ALL SELECT path, pos, 'mtref-questionmark-check' FROM args WHERE name LIKE 'mtref%' AND NOT contains(oarg, '?') UNION ALL SELECT path, pos, 'repos-deprecation-check' FROM args WHERE len(list_filter(parts, lambda x: starts_with(x, 'repos='))) > 0")
_USE = ALL + ", us AS (SELECT DISTINCT m.path AS used, e.path AS user FROM (SELECT path, module FROM deps UNION ALL SELECT path, module FROM refs) e JOIN modules m USING (module) WHERE e.path <> m.path)"
_add("l23_users", lambda t: link.users(t.deps(), t.refs(), t.modules()), _USE + " SELECT used, user FROM us")


def _turns(t: Tables) -> DataFrame:
    c = t.table("conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))


_add("l24_related_closure", lambda t: link.closure(_turns(t).filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst")), rule="all"), "WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > 0), c AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM c JOIN e ON node = src) SELECT root, node FROM c")
_add("l28_symbol_index", lambda t: link.symbol_index(t.symbols()).select("name", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first")), SYMS + " SELECT name, count(DISTINCT path) AS n, min(path) AS first FROM symbols GROUP BY name")
_add("l29_missing_import_hints", lambda t: link.missing_import_hints(link.undefined_symbols(t.refs(), t.symbols()), t.symbols()), _UND + " SELECT u.path, u.pos, u.symbol, count(DISTINCT s.module) AS n_modules, min(s.module) AS first_module FROM u JOIN symbols s ON s.name = u.symbol GROUP BY ALL")
_add("l30_ancestors", lambda t: link.ancestors(_turns(t)), "WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn - 1 AS parent FROM conversations WHERE turn > 0), a AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM p UNION ALL SELECT a.node, p.parent, distance + 1 FROM a JOIN p ON a.ancestor = p.node) SELECT node, ancestor, distance FROM a")

# --- D: diagnostics ------------------------------------------------------------------------------


def _diagnostics(t: Tables) -> DataFrame:
    return checks.all_checks(t.placed(), t.regions(), t.envs(), t.tex_sources())


_MISPLACED = """SELECT path, pos, CASE WHEN (regexp_matches(name, '^(sym[ivx]+|symdef)[*]?$') OR regexp_matches(name, '^[ma]*[dD]ref[ivx]+s?[*]?$')) AND coalesce(around, '') <> 'module' THEN 'outside a module: '
  WHEN regexp_matches(name, '^sym[ivx]+[*]?$') AND env NOT IN ('modsig', 'gviewsig') THEN 'only signatures hold: '
  WHEN regexp_matches(name, '^[tv]assign[*]?$') AND source IS NULL AND coalesce(around, '') <> 'structure' THEN 'outside a view: ' END || name AS why FROM placed
 UNION ALL SELECT path, begin_pos, 'not at the root: gviewsig' FROM regions WHERE env = 'gviewsig' AND depth > 1"""
_PARSER = f"""SELECT path, pos, {_ERROR} AS why FROM args
 UNION ALL SELECT path, pos, name || ' takes ' || ({_WANTED}) || ' arguments, not ' || len(rargs) FROM args WHERE {_SUFFIX} <> '' AND len(rargs) <> {_WANTED}
 UNION ALL SELECT path, begin_pos, 'not closed: ' || env FROM envs WHERE end_pos IS NULL OR env <> end_env"""
_UNDEFINED = """SELECT * FROM refs r WHERE module IN (SELECT module FROM modules) AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.module = r.module AND s.name = r.symbol)"""
_Q = """'"' || module || '"'"""
_QQ = """'"' || {m} || '?' || {s} || '"'"""


def _rule(code: str, severity: int, message: str, source: str, where: str = "", related: str = "NULL") -> str:
    tags = "'" + str(checks.TAGS.get(code, "")) + "'"
    return f"SELECT path, pos, '{code}' AS code, {severity} AS severity, {message} AS message, {tags} AS tags, CAST({related} AS BIGINT) AS related FROM {source} {where}"


_RULES_SQL = [
    _rule("redundant-import-check", 2, "'already imported: ' || " + _Q, f"({_REDUNDANT})", related="first_pos"),
    _rule("duplicate-symbol-check", 1, "'defined before: ' || " + _QQ.format(m="module", s="name"), f"({_DUP})", related="first_pos"),
    _rule("invalid-redefinition", 1, "'differs from the first: ' || " + _QQ.format(m="module", s="name"), f"({_REDEF})", related="first_pos"),
    _rule("location-check", 1, "why", f"({_MISPLACED})", "WHERE why IS NOT NULL"),
    _rule("is-current-dir-check", 2, "'is the current one: ' || what", f"({_CURRENT})"),
    _rule("filename-mismatch-check", 2, "'file and module differ: ' || " + _Q, f"({_MISNAMED})"),
    _rule("parser-exception", 1, "why", f"({_PARSER})", "WHERE why IS NOT NULL"),
    _rule("unique-dependency-name-check", 1, "'several modules: ' || " + _Q, "status", "WHERE status = 'unique-dependency-name-check'"),
    _rule("undefined-module-not-exported", 1, "'no such module: ' || " + _Q, "status", "WHERE status = 'undefined-module-not-exported'"),
    _rule("file-not-found", 1, "'no file for: ' || " + _Q, "status", "WHERE status = 'file-not-found'"),
    _rule("access-modifier-check", 1, "'private: ' || " + _Q, "status", "WHERE status = 'access-modifier-check'"),
    _rule("undefined-symbol", 1, "'no such symbol: ' || " + _QQ.format(m="module", s="symbol"), "undef"),
    _rule("missing-import-hint", 3, "symbol || ' is in ' || n || ' modules'", "(SELECT u.path, u.pos, u.symbol, count(DISTINCT s.module) AS n FROM undef u JOIN symbols s ON s.name = u.symbol GROUP BY ALL)"),
    _rule("referenced-noverb-symbol", 2, "'noverb: ' || " + _QQ.format(m="module", s="symbol"), f"({_NOVERB})"),
    _rule("mtref-deprecation-check", 2, "'mtref is deprecated'", "args", "WHERE name LIKE 'mtref%'"),
    _rule("mtref-questionmark-check", 1, "'mtref without ?'", "args", "WHERE name LIKE 'mtref%' AND NOT contains(oarg, '?')"),
    _rule("repos-deprecation-check", 2, "'repos is deprecated'", "args", f"WHERE {opt('repos')} IS NOT NULL"),
]
_DIAG = LINKED + f", status AS ({_STATUS}), undef AS ({_UNDEFINED}), dg AS (" + " UNION ALL ".join(_RULES_SQL) + ")"


def _shown(d: DataFrame) -> DataFrame:
    return d.select("path", "pos", "code", "severity", "message", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"), "related")


_add("d1_all_checks", lambda t: _shown(_diagnostics(t)), _DIAG + " SELECT path, pos, code, severity, message, tags, related FROM dg")
_add("d2_severity_threshold", lambda t: checks.at_most(_diagnostics(t), 1).select("path", "pos", "code", "severity", "message"), _DIAG + " SELECT path, pos, code, severity, message FROM dg WHERE severity <= 1")


def _further(t: Tables) -> DataFrame:
    """Cycles, types and predicted tags, in the same schema."""
    deps, modules = t.deps(), t.modules()
    cycles = checks.cycle_rows(deps, modules, link.cyclic(_edges(t)))
    refs = t.refs().withColumn("mask", F.when(F.col("macro").startswith("a"), 3).otherwise(1))
    types = checks.type_rows(refs, t.symbols().withColumn("type", F.when(F.col("def_type") == "sym", 1).otherwise(2)))
    tags = checks.tag_rows(t.args().filter("name LIKE 'tref%' AND pos % 2 = 0").select("path", "pos", F.col("name").alias("token"), (F.col("pos") % 4 / 8).alias("score")))
    return cycles.union(types).union(tags)


_add("d3_severity_from_text", lambda t: t.table("conversations").select("conv_id", "turn", checks.severity(F.when(F.col("turn") == 0, "Warning").when(F.col("turn") == 1, "3").otherwise(F.col("role"))).alias("severity")), "SELECT conv_id, turn, CASE turn WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS severity FROM conversations")
_AT = " FROM dg JOIN args a USING (path, pos) JOIN tex_sources t USING (path)"
_BEFORE = "substr(t.text, 1, a.place)"
_LINE = f""" SELECT path || ':' || (length({_BEFORE}) - length(replace({_BEFORE}, chr(10), '')) + 1) || ':' || (length(string_split({_BEFORE}, chr(10))[-1]) + 1) || ' '
 || CASE severity WHEN 1 THEN 'Error' WHEN 2 THEN 'Warning' ELSE 'Information' END || ' - ' || message || ' (' || code || ')' AS line"""
_add("d4_formatted", lambda t: checks.formatted(checks.located(_diagnostics(t), t.args(), t.tex_sources())), _DIAG + _LINE + _AT)
_add(
    "d1_cycles_types_tags", lambda t: _shown(_further(t)),
    with_views("modules", "symbols", "deps", "refs", recursive=True) + _CLOSE[_NRV:].replace("WHERE export", "") + """
SELECT path, d.pos, 'cyclic-dependency-check' AS code, 1 AS severity, 'on a cycle: ' || m.module || ' > ' || d.module AS message, '' AS tags, CAST(NULL AS BIGINT) AS related FROM deps d JOIN modules m USING (path) WHERE NOT quiet AND (d.module, m.module) IN (SELECT (root, node) FROM c)
UNION ALL SELECT r.path, r.pos, 'reference-type-check', 1, 'of another type: ' || symbol, '', NULL FROM refs r JOIN (SELECT DISTINCT module, name, def_type = 'sym' AS plain FROM symbols) s ON s.module = r.module AND s.name = r.symbol WHERE NOT plain AND macro NOT LIKE 'a%'
UNION ALL SELECT path, pos, 'generic-trefier-tag-hint', 3, 'Label for "' || name || '": ' || CASE pos % 4 WHEN 0 THEN '0.00' ELSE '0.25' END, '', NULL FROM args WHERE name LIKE 'tref%' AND pos % 2 = 0""",
)
_add("d6_tag_hints", lambda t: checks.tag_hints(t.tokens().filter("pred = 2").select("doc_id", "pos", "token", (F.lit(0.25) * F.col("pred")).alias("score"))).select("doc_id", "pos", "message"), TOK + " SELECT doc_id, pos, 'Label for \"' || token || '\": 0.50' AS message FROM tokens WHERE pred = 2")
_add("d7_republish", lambda t: checks.republish(t.edits().select("path", "kind", F.col("version").alias("v"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run"))).select("path", "v", "kind"), EDITS + " SELECT path, version AS v, kind FROM edits QUALIFY date_trunc('day', ts) = max(date_trunc('day', ts)) OVER (PARTITION BY path)")

# --- S: sources and ingest -----------------------------------------------------------------------


def _builds(f: DataFrame) -> DataFrame:
    return f.filter("doc_id % 5 <> 0").select("path", (F.col("mtime") + F.make_dt_interval(mins=F.col("doc_id") % 3 - 1)).alias("built_at"), F.when(F.col("doc_id") % 7 == 0, "1.9.9").when(F.col("doc_id") % 11 == 0, "x").otherwise("2.0.1").alias("version"), "doc_id")


_BUILT = FILES + ", builds AS (SELECT path, doc_id, mtime + (doc_id % 3 - 1) * INTERVAL 1 MINUTE AS built_at, CASE WHEN doc_id % 7 = 0 THEN '1.9.9' WHEN doc_id % 11 = 0 THEN 'x' ELSE '2.0.1' END AS version FROM files WHERE doc_id % 5 <> 0)"
_RULES = [("/hub/src1",), ("/hub/src2/**/*.de.tex",), ("!/hub/src1/source/m1.tex",), ("# note",), ("/hub/src3/source/m?.tex",)]


def _ignored(t: Tables) -> DataFrame:
    lines = t.spark.range(1).select(F.explode(F.array(*(F.lit(r[0]) for r in _RULES))).alias("line"))
    return ingest.ignored(t.tex_sources().select("path"), lines)


_add("s2_ignore_file", _ignored, _TEX + r" SELECT path FROM tex_sources WHERE (path LIKE '/hub/src1/%' OR regexp_matches(path, '^/hub/src2/.*[^/]*\.de\.tex$') OR regexp_matches(path, '^/hub/src3/source/m[^/]\.tex$')) AND path <> '/hub/src1/source/m1.tex'")
_add("s3_path_columns", lambda t: ingest.path_columns(t.tex_sources().select("path")), _TEX + r" SELECT path, regexp_extract(path, '^(.*/source)/', 1) AS source_dir, regexp_extract(path, '([^/]+)/source/', 1) AS repository, regexp_extract(path, '/source/(.*)\.tex$', 1) AS rel, regexp_extract(path, '\.([a-z]{2})\.tex$', 1) AS file_lang, regexp_extract(path, '([^/.]+)[^/]*\.tex$', 1) AS stem FROM tex_sources")
_add("s4_size_guard", lambda t: ingest.within_size(t.table("documents").select("doc_id", F.octet_length("text").cast("long").alias("size")), 2), "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE floor(octet_length(encode(text)) / 1024) <= 2")
_add("s5_scan_limit", lambda t: ingest.first_files(t.files(), 100).select("path"), FILES + " SELECT path FROM files ORDER BY path LIMIT 100")
_add("s6_newest_first", lambda t: ingest.newest_first(t.files(), 100).select("path", "mtime"), FILES + " SELECT path, mtime FROM files ORDER BY mtime DESC, path LIMIT 100")
_add("s7_overlay", lambda t: ingest.overlay(f := t.files(), f.filter("doc_id % 4 = 0").select("path", F.concat(F.lit("edited "), "text").alias("text"), (F.col("mtime") + F.make_dt_interval(hours=F.lit(1))).alias("ts"))), FILES + " SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'edited ' || text ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN mtime + INTERVAL 1 HOUR ELSE mtime END AS mtime, doc_id % 4 = 0 AS open FROM files")
_add("s8_snapshot_diff", lambda t: ingest.snapshot_diff((f := t.files()).filter("doc_id % 3 <> 0"), f.filter("doc_id % 5 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 2 == 0, F.col("mtime") + F.make_dt_interval(mins=F.lit(1))).otherwise(F.col("mtime"))), r"/source/m", r"\.de\.tex$"),
     FILES + " SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM files WHERE contains(path, '/source/m') AND NOT ends_with(path, '.de.tex') AND (doc_id % 3 <> 0 OR doc_id % 5 <> 0) AND (doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 2 = 0)")
_add("s9_stale", lambda t: ingest.stale(f := t.files(), _builds(f)).select("path"), _BUILT + " SELECT f.path FROM files f LEFT JOIN builds b USING (path) WHERE built_at IS NULL OR built_at < mtime")
_add("s10_build_or_reuse", lambda t: ingest.build_or_reuse(f := t.files(), _builds(f), F.expr("timestamp_ntz '2025-01-01 00:00:00'")), _BUILT + " SELECT f.path, CASE WHEN built_at IS NULL OR built_at < mtime THEN TIMESTAMP '2025-01-01' ELSE built_at END AS built_at, built_at IS NULL OR built_at < mtime AS rebuilt FROM files f LEFT JOIN builds b USING (path)")


def _relink(t: Tables) -> DataFrame:
    b = _builds(t.files())
    newest = link.newest_used(t.deps(), t.refs(), t.modules(), b)
    return ingest.older(b.select("path", F.col("built_at").alias("linked_at")), newest).select("path", "newest")


_add("s11_relink", _relink, with_views("files", "modules", "deps", "refs") + _USE[len(ALL):] + _BUILT[len(FILES):] + ", n AS (SELECT user AS path, max(built_at) AS newest FROM us JOIN builds ON used = builds.path GROUP BY user) SELECT n.path, newest FROM n JOIN builds b USING (path) WHERE newest > built_at")
_add("s12_version_gate", lambda t: ingest.version_gate(_builds(t.files()), "2.0.0").select("path", "version"), _BUILT + " SELECT path, version FROM builds WHERE EXISTS (SELECT 1 FROM builds WHERE version <> '2.0.1')")
_add("s12_gate_passed", lambda t: ingest.version_gate(_builds(t.files()).filter("version = '2.0.1'"), "2.0.0").select("path", "version"), _BUILT + " SELECT path, version FROM builds WHERE false")


def _embeddings_text(t: Tables) -> DataFrame:
    """The given embeddings as text lines, written and read back."""
    path = new_path(t.spark, "embeddings")
    t.table("embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), " "))).write.text(path)
    return ingest.embeddings_text(t.spark, path, 64)


_add("s14_embeddings_text", lambda t: _embeddings_text(t).select("token", _sum()), "SELECT CAST(vec_id AS VARCHAR) AS token, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
_add("s15_sentences", lambda t: ingest.sentences(t.table("conversations").withColumn("text", F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role"))), "conv_id", "turn", "text").select("conv_id", "sentence", F.array_join("tokens", " ").alias("tokens")),
     "WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS t FROM conversations), s AS (SELECT *, coalesce(sum((t = '')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence, sum((t = '')::INT) OVER (PARTITION BY conv_id) AS ends FROM l) SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, string_agg(t, ' ' ORDER BY turn) AS tokens FROM s WHERE t <> '' AND sentence < ends GROUP BY conv_id, sentence")


def _report(t: Tables) -> DataFrame:
    """The report written as text and read back."""
    path = new_path(t.spark, "report")
    ingest.report(checks.formatted(checks.located(checks.at_most(_diagnostics(t), 2), t.args(), t.tex_sources())), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


_add("s17_report", _report, _DIAG + _LINE + _AT + " WHERE severity <= 2")

# --- R: edit streams, in batch -------------------------------------------------------------------

_add("r1_latest_buffers", lambda t: editing.latest_buffers(t.edits()), EDITS + " SELECT path, max(version) AS version, max_by(kind, version) AS kind, max_by(value, version) AS value FROM edits GROUP BY path")
# the given events come in version order, so versions are dealt anew here
_add("r2_rejected", lambda t: editing.rejected(t.edits().withColumn("version", F.col("version") * 7919 % 10007)).select("path", "version", "seen"), EDITS + ", p AS (SELECT path, ts, version * 7919 % 10007 AS version FROM edits) SELECT path, version, seen FROM (SELECT *, max(version) OVER (PARTITION BY path ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p) WHERE version < seen")
_add("r3_lifecycle", lambda t: editing.lifecycle(t.edits()).select("path", "version", "kind", "previous"), EDITS + " SELECT path, version, kind, previous FROM (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY version) AS previous FROM edits WHERE kind IN ('open', 'close')) WHERE kind = previous OR (previous IS NULL AND kind = 'close')")
_SES = EDITS + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM edits WINDOW w AS (PARTITION BY path ORDER BY ts, version)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, version) AS session FROM g)"
_add("r4_debounce", lambda t: editing.debounce(t.edits(), 3600).select("path", "started", "ended", "n"), _SES + " SELECT path, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY path, session")
_add("r5_queue", lambda t: editing.queue(t.edits().select("path", F.when(F.col("kind").isin("open", "save"), 1).otherwise(0).alias("priority"), "ts", "version")), EDITS + " SELECT path, priority, ts, version FROM (SELECT path, CASE WHEN kind IN ('open', 'save') THEN 1 ELSE 0 END AS priority, ts, version FROM edits) QUALIFY row_number() OVER (PARTITION BY path ORDER BY priority DESC, ts DESC, version DESC) = 1")
_add("r6_recheck_on_save", lambda t: editing.recheck_on_save(e := t.edits(), e.select(F.col("path").alias("used"), F.concat(F.lit("/hub/v"), F.col("version") % 97, F.lit(".tex")).alias("user"))), EDITS + ", s AS (SELECT DISTINCT path FROM edits WHERE kind = 'save') SELECT path FROM s UNION SELECT '/hub/v' || version % 97 || '.tex' FROM edits WHERE path IN (SELECT path FROM s)")

# --- G: ranges -----------------------------------------------------------------------------------


def _ranges(t: Tables) -> DataFrame:
    pos = lambda a, b: F.struct(F.expr(a).cast("int").alias("line"), F.expr(b).cast("int").alias("character"))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", pos("l_linenumber", "l_quantity").alias("start"), pos("l_linenumber + 1", "l_suppkey % 50").alias("end"))


_add("g3_contains", lambda t: _ranges(t).filter(ranges.contains(F.col("start"), F.col("end"), F.struct(F.lit(3).alias("line"), F.lit(20).alias("character")))).groupBy("l_linenumber").agg(F.count("*").alias("n")),
     "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE (l_linenumber < 3 OR (l_linenumber = 3 AND CAST(l_quantity AS INT) <= 20)) AND (l_linenumber + 1 > 3 OR (l_linenumber + 1 = 3 AND l_suppkey % 50 >= 20)) GROUP BY l_linenumber")


def _union(t: Tables) -> DataFrame:
    a, z = ranges.union(F.col("start"), F.col("end"))
    return _ranges(t).groupBy("l_orderkey").agg(a.alias("a"), z.alias("z")).select("l_orderkey", F.col("a.line").alias("start_line"), F.col("a.character").alias("start_character"), F.col("z.line").alias("end_line"), F.col("z.character").alias("end_character"))


_add("g4_union", _union, "WITH x AS (SELECT l_orderkey, min({'line': CAST(l_linenumber AS INT), 'character': CAST(l_quantity AS INT)}) AS a, max({'line': CAST(l_linenumber + 1 AS INT), 'character': CAST(l_suppkey % 50 AS INT)}) AS z FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, a.line AS start_line, a.character AS start_character, z.line AS end_line, z.character AS end_character FROM x")

from . import resolution  # noqa: E402, F401  registers its queries
