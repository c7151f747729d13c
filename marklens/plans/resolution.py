"""Queries of reference resolution, suggestions, the tagger and the edit streams, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marklens.operators import checks, features, graph, link, markup, scopes, similar, suggest, tagger, tokens
from marklens.sources import ingest, shared, store
from marklens.streaming import edits as editing

from .fixtures import _NAME, EDITS_SQL, IMPORT, Tables, with_views
from .registry import _CLOSE, _ENV, _MISPLACED, _SES, _UND, ALL, ARGS, EDITS, MODS, REFS, SYMS, TOK, _add, _edges, _turns

_REC = len(with_views("deps", "modules", recursive=True))
_IS_IMPORT = IMPORT.replace("name", "macro")
_IS_SYMBOL = "regexp_matches(macro, '^(sym[ivx]+|symdef|vardef)[*]?$')"
_REPO = "regexp_extract(path, '([^/]+)/source/', 1)"


def _repo():
    return F.regexp_extract("path", "([^/]+)/source/", 1).alias("repository")


def _typed(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("type", F.when(F.col("def_type") == "sym", 1).otherwise(2))


def _masked(refs: DataFrame) -> DataFrame:
    return refs.withColumn("mask", F.when(F.col("macro").startswith("a"), 3).otherwise(1))


# --- L: linking ----------------------------------------------------------------------------------

# every module whose number ends in 7 counts as private here
_add("l7_private_access", lambda t: link.private_access(t.deps(), t.modules().withColumn("access", F.when(F.col("module").endswith("7"), 3).otherwise(0))).select("path", "pos", "module"),
     with_views("deps", "modules") + " SELECT path, pos, module FROM deps WHERE module LIKE '%7' AND module IN (SELECT module FROM modules)")


def _access(t: Tables) -> DataFrame:
    a = F.when(F.col("turn") % 3 == 0, 0).when(F.col("turn") % 3 == 1, 1).otherwise(F.col("conv_id") % 2 * 3)
    nodes = t.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), a.cast("long").alias("access"))
    return link.visible_access(nodes, _turns(t))


_add("l8_visible_access", _access, "WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS node, turn, CAST(CASE turn % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE conv_id % 2 * 3 END AS BIGINT) AS access FROM conversations), a AS (SELECT node, node AS top, turn FROM n UNION ALL SELECT node, top - 1, turn - 1 FROM a WHERE turn > 0) SELECT a.node, bit_or(n.access) AS visible FROM a JOIN n ON n.node = a.top GROUP BY a.node")

#: The trees of scopes, what imports bring into them, and the lookup, each step as SQL of its own.
_SCOPED = with_views("placed", "envs", "deps", "symbols", recursive=True) + """,
sc0 AS MATERIALIZED (SELECT path, begin_pos, end_pos, kind, module AS name, access FROM regions
 UNION ALL SELECT path, begin_pos, coalesce(end_pos, 1099511627776), 'scope', env, 0 FROM envs WHERE env IN ('omtext', 'nomtext', 'example', 'omgroup', 'frame')),
sc AS MATERIALIZED (SELECT s.path, s.begin_pos, s.end_pos, s.kind, s.name, s.access, s.path || '#' || s.begin_pos AS scope, coalesce(s.path || '#' || max(p.begin_pos), s.path) AS parent
 FROM sc0 s LEFT JOIN sc0 p ON p.path = s.path AND p.begin_pos < s.begin_pos AND p.end_pos > s.begin_pos GROUP BY s.path, s.begin_pos, s.end_pos, s.kind, s.name, s.access),
up AS (SELECT scope, scope AS bound, 0 AS distance, true AS inside FROM sc UNION SELECT DISTINCT path, path, 0, true FROM sc
 UNION ALL SELECT u.scope, s.parent, distance + 1, inside AND s.kind NOT IN ('module', 'binding') FROM up u JOIN sc s ON s.scope = u.bound),
around AS MATERIALIZED (SELECT up.scope, bound, distance, inside, top FROM up JOIN (SELECT scope, arg_max(bound, distance) AS top FROM up WHERE inside GROUP BY scope) USING (scope)),
dd AS MATERIALIZED (SELECT d.path, d.pos, d.module, d.export, d.hint, CASE WHEN quiet THEN d.path || '#' || d.pos ELSE coalesce(d.path || '#' || max(s.begin_pos), d.path) END AS scope
 FROM deps d LEFT JOIN sc s ON s.path = d.path AND s.begin_pos < d.pos AND s.end_pos > d.pos GROUP BY d.path, d.pos, d.module, d.export, d.hint, d.quiet, d.macro),
md AS (SELECT path, name AS module, parent, scope AS node, access FROM sc WHERE kind = 'module' AND name IS NOT NULL),
rt AS (SELECT path AS hint, module, count(*) AS n, min(node) AS node, max(access) AS access FROM md WHERE parent = path GROUP BY ALL),
im AS MATERIALIZED (SELECT dd.path, dd.pos, dd.scope, rt.node, dd.module, dd.export FROM dd JOIN rt ON rt.hint = dd.hint AND rt.module = dd.module WHERE n = 1 AND rt.access = 0
 UNION ALL SELECT dd.path, dd.pos, dd.scope, md.node, dd.module, dd.export FROM dd JOIN around a ON a.scope = dd.scope JOIN md ON md.parent = a.bound AND md.module = dd.module AND md.access = 0
  WHERE dd.hint = dd.path AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.hint = dd.hint AND rt.module = dd.module)),
home AS (SELECT a.scope, sc.name AS home FROM around a JOIN sc ON sc.scope = a.top WHERE a.bound = a.top),
br AS (SELECT im.scope, node, NOT export AS below FROM im
 UNION SELECT br.scope, im.node, below FROM br JOIN im ON im.scope = br.node AND im.export JOIN md ON md.node = im.node LEFT JOIN home ON home.scope = br.scope WHERE NOT (below AND coalesce(md.module = home.home, false))),
got AS MATERIALIZED (SELECT DISTINCT scope, node FROM br),
sy AS (SELECT s.path || '#' || max(m.begin_pos) AS parent, s.name, s.path || '#' || s.pos AS node, CASE s.def_type WHEN 'sym' THEN 1 ELSE 2 END AS type
 FROM symbols s JOIN sc m ON m.kind = 'module' AND m.path = s.path AND m.begin_pos < s.pos AND m.end_pos > s.pos GROUP BY s.path, s.pos, s.name, s.def_type),
vis AS MATERIALIZED (SELECT parent, name, scope AS node, CASE kind WHEN 'module' THEN 4 ELSE 8 END AS type FROM sc WHERE kind IN ('module', 'binding') AND name IS NOT NULL
 UNION SELECT * FROM sy UNION SELECT got.scope, md.module, '>' || got.node, 4 FROM got JOIN md USING (node) WHERE md.access = 0
 UNION SELECT '>' || sy.parent, sy.name, sy.node, sy.type FROM sy WHERE parent IN (SELECT node FROM got)),
raw AS (SELECT path, pos, name, module, parts, rargs, coalesce(list_filter(parts, lambda x: NOT contains(x, '='))[1], '') AS g FROM placed),
nm AS (SELECT *, list_filter(string_split(g, '?'), lambda x: x <> '') AS pieces, """ + _NAME + """ AS symbol FROM raw),
idp AS (SELECT path, pos, CASE WHEN contains(g, '?') AND NOT ends_with(g, '?') THEN CASE WHEN starts_with(g, '?') THEN [module, pieces[1]] ELSE pieces END WHEN g <> '' THEN list_append(pieces, symbol) ELSE [module, symbol] END AS ids,
  CASE WHEN starts_with(name, 'a') THEN 3 ELSE 1 END AS mask FROM nm WHERE regexp_matches(name, '^[ma]*[dDtT]ref[ivx]+s?[*]?$')
 UNION ALL SELECT path, pos, [rargs[1]], 4 FROM nm WHERE """ + IMPORT + """),
rf AS MATERIALIZED (SELECT r.path, r.pos, r.ids, r.mask, coalesce(r.path || '#' || max(s.begin_pos), r.path) AS scope FROM idp r LEFT JOIN sc s ON s.path = r.path AND s.begin_pos < r.pos AND s.end_pos > r.pos GROUP BY r.path, r.pos, r.ids, r.mask),
lk AS (SELECT r.path, r.pos, ids, mask, a.bound AS node, distance, inside AS entered, top, 0 AS k, 0 AS type FROM rf r JOIN around a ON a.scope = r.scope
 UNION ALL SELECT lk.path, lk.pos, ids, mask, v.node, distance, entered OR v.node = top, top, k + 1, v.type FROM lk JOIN vis v ON v.parent = lk.node AND v.name = ids[k + 1] WHERE k < len(ids))
"""


def _scoped(t: Tables):
    return scopes.resolve(t.placed(), t.regions(), t.envs(), t.deps(), _typed(t.symbols()))


_add("l13_resolved_references", lambda t: _scoped(t)[0], _SCOPED + " SELECT path, pos AS ref, node, min(distance) AS distance FROM lk WHERE k = len(ids) AND entered AND (mask & type) = type GROUP BY ALL")
_add("l14_resolution_depth", lambda t: _scoped(t)[1], _SCOPED + " SELECT path, pos AS ref, max(k) AS depth FROM lk GROUP BY ALL")
_add("l5_imported_modules", lambda t: scopes.imports(t.deps(), found := shared.checkpoint(scopes.scopes(t.regions(), t.envs())), scopes.outward(found)).select("path", "pos", "scope", "node", "module", "export"), _SCOPED + " SELECT path, pos, scope, node, module, export FROM im")
_add(
    "l17_similar_names", lambda t: link.similar_names(link.undefined_symbols(t.refs(), s := t.symbols()), s),
    _UND + """, p AS (SELECT symbol, name, greatest(length(symbol), length(name)) AS l FROM (SELECT DISTINCT symbol FROM u WHERE symbol <> '') JOIN (SELECT DISTINCT name FROM symbols WHERE name <> '') ON symbol <> name),
 q AS (SELECT symbol, name, round(1 - levenshtein(symbol, name) / l, 6) AS ratio FROM p)
SELECT symbol, name, ratio FROM q WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ratio DESC, name) <= 3""",
)


def _close_matches(t: Tables) -> DataFrame:
    """References that nothing resolves, against the names of their own file and of the modules it imports."""
    s = shared.checkpoint(_typed(t.symbols()).select("path", "module", "name", "type").distinct())
    full = F.concat("module", F.lit("?"), "name").alias("name")
    seen = t.deps().select("path", "module").distinct().join(s.drop("path"), "module").select("path", full, "type")
    wanted = _masked(link.undefined_symbols(t.refs(), s)).select("path", F.concat("module", F.lit("?"), "symbol").alias("symbol"), "mask")
    return similar.close_matches(wanted, s.select("path", full, "type").union(seen))


_BLOCK = "list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(list_filter(range(1, length({a}) - i + 2), lambda l: contains({b}, substr({a}, i, l))), lambda l: {{'l': l, 'i': -i}}))))"
_add(
    "l17_close_matches", _close_matches,
    with_views("symbols", "refs", "deps", recursive=True) + f""",
u AS (SELECT DISTINCT r.path, module || '?' || symbol AS symbol, CASE WHEN macro LIKE 'a%' THEN 3 ELSE 1 END AS mask FROM refs r WHERE module IS NOT NULL AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.module = r.module AND s.name = r.symbol)),
own AS (SELECT DISTINCT path, module, name, CASE def_type WHEN 'sym' THEN 1 ELSE 2 END AS type FROM symbols),
seen AS (SELECT path, module || '?' || name AS name, type FROM own UNION SELECT d.path, d.module || '?' || name, type FROM deps d JOIN own USING (module)),
cand AS (SELECT DISTINCT path, symbol, mask, name FROM u JOIN seen USING (path) WHERE type & mask <> 0 OR string_split(name, '?')[-1] = string_split(symbol, '?')[-1]),
seg AS (SELECT symbol, name, name AS a, symbol AS b, {_BLOCK.format(a='name', b='symbol')} AS m FROM (SELECT DISTINCT symbol, name FROM cand)
 UNION ALL SELECT symbol, name, a, b, {_BLOCK.format(a='a', b='b')} FROM (
  SELECT symbol, name, CASE side WHEN 0 THEN substr(a, 1, i - 1) ELSE substr(a, i + l) END AS a, CASE side WHEN 0 THEN substr(b, 1, strpos(b, substr(a, i, l)) - 1) ELSE substr(b, strpos(b, substr(a, i, l)) + l) END AS b
  FROM (SELECT symbol, name, a, b, m.l AS l, -m.i AS i, unnest([0, 1]) AS side FROM seg WHERE m IS NOT NULL)) WHERE a <> '' AND b <> ''),
likeness AS (SELECT symbol, name, 2 * CAST(sum(coalesce(m.l, 0)) AS DOUBLE) / (length(symbol) + length(name)) AS ratio FROM seg GROUP BY symbol, name)
SELECT path, symbol, mask, name, ratio, row_number() OVER (PARTITION BY path, symbol, mask ORDER BY ratio DESC, name DESC) AS nth FROM cand JOIN likeness USING (symbol, name) WHERE ratio >= 0.6
QUALIFY row_number() OVER (PARTITION BY path, symbol, mask ORDER BY ratio DESC, name DESC) <= 3""",
)
_add("l21_location_checks", lambda t: checks.misplaced(t.placed(), t.regions()).select("path", "pos", "code", "message"), with_views("placed") + f" SELECT path, pos, 'location-check' AS code, why AS message FROM ({_MISPLACED}) WHERE why IS NOT NULL")


def _named_ranges(args: DataFrame, e: DataFrame) -> DataFrame:
    """Environments ``e`` by their first argument or name, up to and with their end."""
    label = args.filter("name = 'begin'").select("path", F.col("pos").alias("begin_pos"), F.get("rargs", F.lit(1)).alias("own"))
    return e.join(label, ["path", "begin_pos"]).select("path", F.coalesce("own", "env").alias("name"), "begin_pos", (F.col("end_pos") + 1).alias("end_pos"))


_add("l25_namespaces", lambda t: link.namespaces(t.refs().select("path", "pos").distinct(), _named_ranges(t.args(), t.envs())).select("path", "pos", F.array_join("names", ">").alias("names")),
     with_views("envs", "refs") + r", n AS (SELECT e.path, coalesce(a.rargs[2], e.env) AS own, begin_pos, coalesce(end_pos, 1099511627776) AS fin FROM envs e JOIN args a ON a.path = e.path AND a.pos = begin_pos) SELECT a.path, a.pos, string_agg(own, '>' ORDER BY begin_pos) AS names FROM args a JOIN n ON n.path = a.path AND begin_pos <= a.pos AND fin >= a.pos WHERE (a.path, a.pos) IN (SELECT (path, pos) FROM refs) GROUP BY a.path, a.pos")


def _definitions(t: Tables) -> DataFrame:
    """Every macro's place as a point; ranges in characters of the text."""
    at = t.args().select("path", "pos", "place", (F.col("place") + F.col("span")).alias("after"))
    here = lambda df: df.join(at.hint("merge"), ["path", "pos"])  # noqa: E731  a row a macro: never broadcast
    refs = here(t.refs()).select("path", F.col("place").alias("begin_pos"), F.col("after").alias("end_pos"), "nth", "module", "symbol")
    s, ends = here(t.symbols()), at.select("path", F.col("pos").alias("end_pos"), F.col("after").alias("fin"))
    modules = here(t.regions().filter("kind = 'module'").withColumnRenamed("begin_pos", "pos")).join(ends.hint("merge"), ["path", "end_pos"], "left")
    ranges = modules.select("path", F.col("place").alias("begin_pos"), F.col("fin").alias("end_pos")).union(s.select("path", "place", "after"))
    targets = s.select("module", F.col("name").alias("symbol"), F.col("path").alias("d_path"), F.col("place").alias("d_pos"))
    return link.definitions_at(at.select("path", F.col("place").alias("pos")), refs, targets, ranges)


_add("l26_definitions_at", _definitions,
     with_views("refs", "symbols", "modules", "envs") + """, rr AS (SELECT r.path, place AS b, place + span AS e, nth, module, symbol FROM refs r JOIN args a USING (path, pos)),
 sr AS (SELECT p.path, p.place, module, symbol FROM args p JOIN rr ON rr.path = p.path AND b <= p.place AND e > p.place QUALIFY row_number() OVER (PARTITION BY p.path, p.place ORDER BY e - b, nth) = 1),
 sp AS (SELECT s.path, s.module, s.name, a.place, a.place + a.span AS e FROM symbols s JOIN args a USING (path, pos)),
 dr AS (SELECT path, place AS b, e FROM sp UNION ALL SELECT m.path, a.place, coalesce(z.place + z.span, 1099511627776) FROM regions m JOIN args a ON a.path = m.path AND a.pos = m.begin_pos LEFT JOIN args z ON z.path = m.path AND z.pos = m.end_pos WHERE m.kind = 'module')
SELECT sr.path, sr.place AS pos, sp.path AS d_path, sp.place AS d_pos FROM sr JOIN sp ON sp.module = sr.module AND sp.name = sr.symbol
UNION SELECT p.path, p.place, dr.path, dr.b FROM args p JOIN dr ON dr.path = p.path AND dr.b <= p.place AND dr.e > p.place""")
_add("l27_references_to", lambda t: link.references_to(t.symbols().withColumnRenamed("name", "symbol"), t.refs()),
     ALL + " SELECT module, name AS symbol, path, pos FROM symbols UNION SELECT module, symbol, path, pos FROM refs WHERE (module, symbol) IN (SELECT (module, name) FROM symbols)")
_add("l31_type_mismatches", lambda t: link.type_mismatches(_masked(t.refs()), _typed(t.symbols())).select("path", "pos", "symbol").distinct(),
     ALL + " SELECT DISTINCT path, pos, symbol FROM refs r WHERE macro NOT LIKE 'a%' AND EXISTS (SELECT 1 FROM symbols s WHERE s.module = r.module AND s.name = r.symbol AND s.def_type <> 'sym')")

# --- C: suggestions ------------------------------------------------------------------------------


def _typing(t: Tables) -> DataFrame:
    c = suggest.contexts(t.args()).withColumn("x", suggest.classify(F.col("context")))
    return c.filter("x IS NOT NULL").select("path", "pos", "x.*")


_CW = ARGS + ", cw AS (SELECT path, pos, name AS macro, CASE WHEN length(oarg) > 5 THEN 'oarg' ELSE 'rarg' END AS part, string_split(CASE WHEN length(oarg) > 5 THEN substr(oarg, 2, 3) ELSE substr(rarg, 2, 2) END, ',')[-1] AS fragment FROM args WHERE length(oarg) > 5 OR (rarg <> '' AND substr(rarg, 1, 3) NOT LIKE '%}%' AND substr(rarg, 2, 2) NOT LIKE '%{%'))"
_add("c1_context_kinds", _typing, _CW + " SELECT path, pos, macro, part, fragment FROM cw")
_add("c2_repositories", lambda t: suggest.repositories(_typing(t).filter(F.col("macro").rlike(markup.IMPORTS) & (F.col("part") == "oarg")).select(F.lit("modsig").alias("module_type"), "fragment").distinct(), t.modules().select("module_type", _repo())).select("fragment", "repository"),
     MODS + _CW[len(ARGS):] + f" SELECT DISTINCT fragment, repository FROM cw JOIN (SELECT DISTINCT {_REPO} AS repository FROM modules WHERE module_type = 'modsig') ON starts_with(repository, fragment) WHERE {_IS_IMPORT} AND part = 'oarg'")
_add("c3_modules_in", lambda t: suggest.modules_in(t.args().filter(F.col("name").rlike(markup.IMPORTS)).select("path", F.get(markup.unnamed(F.col("parts")), F.lit(0)).alias("repository"), F.substring(F.get("rargs", F.lit(0)), 1, 2).alias("fragment")), t.modules().select("path", _repo(), "module")).select("place", "fragment", "module"),
     MODS + f", w AS (SELECT DISTINCT coalesce(list_filter(parts, lambda x: NOT contains(x, '='))[1], regexp_extract(path, '^(.*)/[^/]*$', 1)) AS place, substr(rargs[1], 1, 2) AS fragment FROM args WHERE {IMPORT}), m AS (SELECT DISTINCT {_REPO} AS place, module FROM modules UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), module FROM modules) SELECT w.place, fragment, module FROM w JOIN m ON w.place = m.place AND starts_with(module, fragment)")


def _constraints(t: Tables) -> DataFrame:
    """Every second file names no repository, every third no language."""
    f = t.tex_sources().filter("kind = 'binding'")
    wanted = f.select(F.when(F.col("doc_id") % 2 == 0, _repo()).alias("repository"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang")).distinct()
    return suggest.matching(wanted, t.bindings().select("module", "lang", _repo()), ("repository", "lang")).groupBy("repository", "lang").agg(F.count("*").alias("n"), F.min("k_module").alias("first"))


_add("c4_constrained_modules", _constraints,
     with_views("bindings") + f", w AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN {_REPO} END AS repository, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM tex_sources WHERE kind = 'binding'), b AS (SELECT module, lang, {_REPO} AS repository FROM bindings) SELECT w.repository, w.lang, count(*) AS n, min(module) AS first FROM w JOIN b ON (w.repository IS NULL OR w.repository = b.repository) AND (w.lang IS NULL OR w.lang = b.lang) GROUP BY ALL")
_add("c5_keywords", lambda t: suggest.keywords(_typing(t).filter("part = 'oarg'").select(suggest.kind_of(F.col("macro")).alias("kind"), "fragment").distinct()),
     _CW + f", k AS (SELECT DISTINCT CASE WHEN macro IN ('begin', 'end') THEN 'environment' WHEN {_IS_IMPORT} THEN 'import' WHEN {_IS_SYMBOL} THEN 'symbol' WHEN regexp_matches(macro, '^[ma]*[dD]ef[ivx]+s?[*]?$') THEN 'definition' ELSE 'other' END AS kind, fragment FROM cw WHERE part = 'oarg') SELECT kind, fragment, keyword FROM k JOIN (VALUES ('import', 'dir'), ('import', 'load'), ('import', 'mhrepos'), ('import', 'path'), ('symbol', 'name'), ('symbol', 'noverb'), ('definition', 'name'), ('environment', 'id'), ('environment', 'title')) v(kind, keyword) USING (kind) WHERE starts_with(keyword, fragment)")
_add("c6_symbol_names", lambda t: suggest.symbol_names((s := t.symbols()).select("path", F.substring("name", 1, 2).alias("fragment")).distinct(), s),
     SYMS + " SELECT DISTINCT w.path, fragment, name FROM (SELECT path, substr(name, 1, 2) AS fragment FROM symbols) w JOIN symbols s ON s.path = w.path AND starts_with(name, fragment)")


def _qualified(t: Tables) -> DataFrame:
    wanted = shared.checkpoint(t.refs().filter("module IS NOT NULL").select("module", F.substring("symbol", 1, 1).alias("fragment")).distinct())
    s = shared.checkpoint(t.symbols().select("module", "name", F.col("name").alias("text"), "noverb").distinct())
    sets, names = link.reached(_edges(t), wanted.select(F.col("module").alias("node")).distinct())
    texts = graph.numbers(s.select("name"))
    rows = suggest.qualified(graph.numbered(wanted, "module", names), graph.numbered(graph.numbered(s, "module", names), "name", texts), sets)
    out = rows.groupBy("module", "fragment").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    out = out.join(names.withColumnRenamed("name", "own"), F.col("module") == F.col("id")).drop("id").join(texts, F.col("first") == F.col("id"))
    return out.select(F.col("own").alias("module"), "fragment", "n", F.col("name").alias("first"))


_add("c7_qualified_symbols", _qualified,
     with_views("deps", "modules", "refs", "symbols", recursive=True) + _CLOSE[_REC:] + ", vis AS (SELECT DISTINCT root AS module, name FROM c JOIN symbols ON module = node EXCEPT SELECT module, name FROM symbols), ok AS (SELECT module, name FROM symbols WHERE NOT noverb UNION SELECT module, name FROM vis WHERE name NOT IN (SELECT name FROM symbols WHERE noverb)), w AS (SELECT DISTINCT module, substr(symbol, 1, 1) AS fragment FROM refs WHERE module IS NOT NULL) SELECT w.module, fragment, count(*) AS n, min(name) AS first FROM w JOIN ok ON ok.module = w.module AND starts_with(name, fragment) GROUP BY ALL")

# --- F, M: reduction and the tagger --------------------------------------------------------------

_add("f17_pca", lambda t: features.pca(t.table("embeddings").select("vec_id", "embedding"), 8, "embedding").select("vec_id", *(F.round(F.abs(F.get("reduced", F.lit(i))), 4).alias(f"c{i}") for i in range(8))))


def _fitted(t: Tables):
    tok = t.tokens(together=True).drop("pred")
    rows = tagger.inputs(tok, tok.filter(features.split_of(F.col("doc_id")) == "train"))
    return tagger.train(rows.filter(features.split_of(F.col("doc_id")) == "train")), rows


def _coefficients(t: Tables) -> DataFrame:
    own = _fitted(t)[0].stages[-1]
    rows = F.array(*(F.struct(F.lit(n).alias("input"), F.lit(float(c)).alias("coefficient")) for n, c in zip([*tagger.INPUTS, "intercept"], [*own.coefficients, own.intercept])))
    return t.spark.range(1).select(F.inline(rows))


def _reloaded(t: Tables) -> DataFrame:
    model, rows = _fitted(t)
    path = shared.new_path(t.spark, "tagger")
    tagger.save(model, path, {"name": "keywords", "version": "1", "max_iter": 10})
    again, settings = tagger.load(t.spark, path)
    return tagger.predict(again, rows).select("doc_id", "pos", F.round("score", 6).alias("score"), F.lit(settings["name"]).alias("model"))


_add("m1_train", _coefficients)
_add("m2_predict", lambda t: tagger.predict(*_fitted(t)).select("doc_id", "pos", F.round("score", 6).alias("score")))
_add("m3_tags", lambda t: tagger.tags(tokens.enclosing((a := t.args()).filter("name NOT IN ('begin', 'end')"), tokens.environments(a)).withColumn("score", F.col("pos") % 10 / 10), "omtext").select("path", "pos", "score"),
     _ENV + " SELECT a.path, a.pos, a.pos % 10 / 10 AS score FROM args a WHERE a.name NOT IN ('begin', 'end') AND a.pos % 10 > 5 AND NOT EXISTS (SELECT 1 FROM envs e WHERE e.path = a.path AND begin_pos < a.pos AND coalesce(end_pos, 1099511627776) > a.pos AND env = 'omtext')")
_add("m4_saved_model", _reloaded)

# --- S: sources ----------------------------------------------------------------------------------


def _labelled(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        a = t.args().filter(F.col("path").rlike(r"\.en\.tex$"))
        own = tokens.enclosing(a.filter("name NOT IN ('begin', 'end')"), tokens.environments(a))
        label = F.when(F.exists("envs", lambda e: e.rlike("omtext")), 1).when(F.exists("envs", lambda e: e.rlike("mod")), 2).otherwise(0)
        return own.select("path", "pos", F.col("name").alias("token"), label.alias("label"))

    return ingest.cached(t.spark, shared.new_path(t.spark, "labelled"), build)


_add("s16_labelled_dataset", _labelled,
     _ENV + " SELECT a.path, a.pos, a.name AS token, CASE WHEN bool_or(e.env = 'omtext') THEN 1 WHEN bool_or(contains(e.env, 'mod')) THEN 2 ELSE 0 END AS label FROM args a LEFT JOIN envs e ON a.path = e.path AND e.begin_pos < a.pos AND coalesce(e.end_pos, 1099511627776) > a.pos WHERE a.path LIKE '%.en.tex' AND a.name NOT IN ('begin', 'end') GROUP BY a.path, a.pos, a.name")



def _scanned(t: Tables) -> DataFrame:
    """The documents' lengths as .tex files, a folder a source, found by a scan of the folders; what lies outside ``source`` isn't."""
    root, rows = shared.new_path(t.spark, "hub"), t.table("documents").select("source", F.concat_ws(" ", "source", "doc_id", "n_chars"))
    for folder in ("source", "other"):
        rows.write.partitionBy("source").option("extension", "tex").option("quote", "").csv(f"{root}/{folder}")
    lines = ingest.scan(t.spark, root).select("size", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> '' AND size > 0").select("line")


_add("s1_scanned_files", _scanned, "SELECT source || ' ' || doc_id || ' ' || n_chars AS line FROM documents")


def _rebuilt(t: Tables) -> DataFrame:
    """A build of most files, then one after some changed, some came and some went; ``batch`` tells which build a row is of."""
    f, folder = t.files().select("doc_id", "path", "mtime", "text"), shared.new_path(t.spark, "artifacts")
    schema = StructType.fromDDL("path string, n_macros int, batch int")
    build = lambda k: lambda stale: stale.select("path", F.regexp_count("text", F.lit(r"\\[A-Za-z]")).alias("n_macros"), F.lit(k).alias("batch"))
    ingest.rebuild(f.filter("doc_id % 6 <> 5"), folder, 0, build(0), schema)
    later = f.filter("doc_id % 7 <> 3").withColumn("mtime", F.when(F.col("doc_id") % 4 == 1, F.col("mtime") + F.make_dt_interval(mins=F.lit(1))).otherwise(F.col("mtime")))
    return ingest.rebuild(later, folder, 1, build(1), schema)


_add("s10_rebuild", _rebuilt, with_views("files") + r" SELECT path, CAST(len(regexp_extract_all(text, '\\[A-Za-z]')) AS INTEGER) AS n_macros, CASE WHEN doc_id % 6 = 5 OR doc_id % 4 = 1 THEN 1 ELSE 0 END AS batch FROM files WHERE doc_id % 7 <> 3")

# --- R: edit streams -----------------------------------------------------------------------------


def _edit_stream(t: Tables) -> DataFrame:
    """The given events as a stream of edits; the pattern lets a single file be a stream's source."""
    raw = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.dir}/event[s].parquet")
    raw.createOrReplaceTempView("marklens_stream")
    return t.spark.sql(EDITS_SQL.replace("FROM events", "FROM marklens_stream")).withColumn("ts", F.col("ts").cast("timestamp"))


def _verdicts(t: Tables) -> DataFrame:
    e = _edit_stream(t).select("path", "version", "kind", "ts")
    return editing.run_all(editing.verdicts_stream(e), shared.new_path(t.spark, "verdicts"), shared.new_path(t.spark, "verdicts-state"))


_add("r3_stream_verdicts", _verdicts,
     EDITS + ", p AS (SELECT *, last_value(CASE WHEN kind IN ('open', 'close') THEN kind END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM edits) SELECT path, version, kind, CASE WHEN kind = 'open' AND prev = 'open' THEN 'duplicate-open' WHEN kind = 'close' AND coalesce(prev, 'close') = 'close' THEN 'not-open' ELSE 'accepted' END AS verdict FROM p")


def _debounced(t: Tables) -> DataFrame:
    """Sessions of the edit stream; those still open count too, so the whole result is written."""
    table, out = shared.new_path(t.spark, "sessions"), editing.debounce_stream(_edit_stream(t), 3600).select("path", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")
    w = out.writeStream.trigger(availableNow=True).outputMode("complete").option("checkpointLocation", shared.new_path(t.spark, "sessions-state"))
    w.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(table)).start().awaitTermination()
    return t.spark.read.parquet(table)


_add("r4_debounce_stream", _debounced, _SES + " SELECT path, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY path, session")


def _continuous(t: Tables) -> DataFrame:
    """The events as three files, a micro-batch each; a file's diagnostics are those of the last batch that has it."""
    folder, table = shared.new_path(t.spark, "events"), shared.new_path(t.spark, "diagnostics")
    for k in range(3):
        t.table("events").filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    raw = t.spark.readStream.schema(t.table("events").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    raw.createOrReplaceTempView("marklens_parts")
    stream = t.spark.sql(EDITS_SQL.replace("FROM events", "FROM marklens_parts"))
    check = lambda b: b.filter("kind = 'close'").select("path", F.col("version").alias("pos"), F.lit("file-not-found").alias("code"), F.lit(1).alias("severity"))
    editing.run_all(stream, None, shared.new_path(t.spark, "diagnostics-state"), lambda b, n: editing.publish(b, n, table, check))
    return store.get(t.spark, table, StructType.fromDDL("path string, pos bigint, code string, severity int"))


_add("r7_continuous_diagnostics", _continuous, EDITS + " SELECT path, version AS pos, 'file-not-found' AS code, 1 AS severity FROM (SELECT * FROM edits QUALIFY version % 3 = max(version % 3) OVER (PARTITION BY path)) WHERE kind = 'close'")


def _index(t: Tables) -> DataFrame:
    """All files' names as one batch, then those of changed files as another, which comes twice."""
    table, s = shared.new_path(t.spark, "index"), shared.checkpoint(t.symbols().select("path", "name").distinct())
    store.put(table, 0, s, s)
    for _ in range(2):
        changed = s.filter("path LIKE '%4.tex'")
        store.put(table, 1, changed, changed.withColumn("name", F.upper("name")))
    return store.get(t.spark, table, s.schema).distinct()


_add("r8_stored_index", _index, SYMS + " SELECT DISTINCT CASE WHEN path LIKE '%4.tex' THEN upper(name) ELSE name END AS name, path FROM symbols")
_add("r8_index_maintenance", lambda t: link.maintain_index(s := t.symbols(), s.filter("path LIKE '%4.tex'"), s.filter("path LIKE '%4.tex'").withColumn("name", F.upper("name"))),
     SYMS + " SELECT DISTINCT CASE WHEN path LIKE '%4.tex' THEN upper(name) ELSE name END AS name, path FROM symbols")
