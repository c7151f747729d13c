"""Views that the queries run on, derived from the given tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.operators import features, markup, tokens
from marklens.sources.shared import write_table

TEX_SQL = """
WITH w AS (
  SELECT doc_id AS d, source, lang, n_chars, replace(coalesce(text, ''), chr(92), '/') AS body,
         regexp_extract(lower(text), '([a-z]{3,})', 1) AS w1,
         regexp_extract(lower(text), '[a-z]{3,}[^a-z]+([a-z]{3,})', 1) AS w2,
         CAST(floor(doc_id / 2) AS BIGINT) AS t1,
         doc_id - doc_id % 10 + ((doc_id % 10) * 3 + 1) % 10 AS t2
  FROM documents),
v AS (
  SELECT *, CASE WHEN w1 = '' THEN 'none' ELSE w1 END AS a, CASE WHEN w2 = '' THEN 'none' ELSE w2 END AS b,
         chr(92) AS s, chr(10) AS nl FROM w)
SELECT d AS doc_id, concat('/hub/', source, '/source/m', d, '.tex') AS path, lang, 'modsig' AS kind,
  concat(s,'begin{modsig}{', CASE WHEN d % 13 = 0 THEN 'x' ELSE 'm' END, d, '}', nl,
         s,'gimport[src', t1 % 20, ']{m', t1, '}', nl,
         s, CASE WHEN d % 4 = 0 THEN 'guse' ELSE 'gimport' END, '[src', t2 % 20, ']{m', t2, '}', nl,
         CASE WHEN d % 50 = 7 THEN concat(s,'gimport[src0]{m', d + 1000000, '}', nl) ELSE '' END,
         s,'symi{', a, '} % first', nl,
         CASE WHEN d % 9 = 0 THEN concat(s,'symi{', a, '}', nl) ELSE '' END,
         s,'symii{', a, '}{', b, '}', nl,
         CASE WHEN d % 6 = 0 THEN concat(s,'symdef[noverb]{', b, '-v}', nl) ELSE '' END,
         CASE WHEN d % 4 = 1 THEN concat(s,'symii[noverb={', lang, ',xx}]{', b, '}{', a, '}', nl) ELSE '' END,
         CASE WHEN d % 12 = 0 THEN concat(s,'symdef{', b, '-v}', nl) ELSE '' END,
         s,'end{modsig}', nl) AS text
FROM v
UNION ALL
SELECT d, concat('/hub/', source, '/source/m', d, '.', lang, '.tex'), lang, 'binding',
  concat(s,'begin{mhmodnl}{m', d, '}{', lang, '}', nl,
         s,'defi{', a, '} is $', a, '_1$ and ', s, 'trefii{', a, '}{', b, '}', nl,
         CASE WHEN d % 23 = 0 THEN concat(s,'usemodule[load=src0/source]{m0}', nl) ELSE '' END,
         CASE WHEN d % 29 = 0 THEN concat(s,'importmhmodule[repos=src1,dir=x]{m1}', nl) ELSE '' END,
         CASE WHEN d % 7 = 0 THEN concat(s,'begin{omtext}', nl) ELSE '' END,
         s,'trefi[m', t1, '?', a, ']{', b, '} ', s, 'atrefi[m', t2, ']{shown}{', a, '}', nl,
         CASE WHEN d % 7 = 0 THEN concat(s,'end{omtext}', nl) ELSE '' END,
         CASE WHEN d % 11 = 0 THEN concat(s,'mtrefi{', a, '}', nl) ELSE '' END,
         CASE WHEN d % 8 = 0 THEN concat(s,'trefi[m', d, '?', b, '-v]{', b, '} ', s, 'Trefiis[m', d, '?', b, '-', a, ']{', b, '}{', a, '}', nl) ELSE '' END,
         CASE WHEN d % 17 = 0 THEN concat(s,'begin{example}', nl) ELSE '' END,
         body, nl, s,'end{mhmodnl}', nl)
FROM v
UNION ALL
SELECT d, concat('/hub/', source, '/source/n', d, '.tex'), lang, 'mono',
  concat(s,'begin{module}', CASE WHEN d % 10 = 5 THEN '' ELSE concat('[id=n', d, ']') END, nl,
         s,'importmhmodule[mhrepos=src', t1 % 20, ',dir=d]{m', t1, '}', nl,
         CASE WHEN d % 15 = 0 THEN concat(s,'importmhmodule[dir=d,path=p]{m0}', nl, s,'gimport[', source, ']{m', t1, '}', nl, s,'gimport{m', d, '}', nl) ELSE '' END,
         CASE WHEN d % 25 = 0 THEN concat(s,'usemodule{m0}', nl, s,'begin{omtext}', nl, s,'usemodule[load=x]{m', t1, '}', nl, s,'end{omtext}', nl) ELSE '' END,
         s,'adefi[name=', a, ']{shown ', s,'emph{', a, '}}{', b, '} ', s,'defii{', a, '}{', b, '} ', s,'drefi{', b, '}', nl,
         s,'verb|', s,'defi{no}| ', s,'begin{verbatim}', nl, s,'symi{no}', nl, s,'end{verbatim} 100', s,'% % ', s,'defi{no}', nl,
         s,'symdef[noverb={de,en}]{', a, '-n}', nl, s,'Trefis{', a, '} ', s,'symi{', b, '} ', s,'defiii{', a, '}{', b, '} ', s,'defii{x{y{z{', s,'emph{', a, '}}}}}{', b, '}', nl,
         s,'begin{align*}x & y', s,s,' 1', nl, s,'end{align*} ', s,'ss ', s,'"a', nl,
         s,'end{module}', nl,
         s,'begin{gviewsig}{v', d, '}{m', d, '}{m', t1, '}', nl, s,'tassign{', a, '}{', b, '} ', s,'vassign{m', t2, '?', b, '}{', a, '}', nl, s,'end{gviewsig}', nl,
         s,'begin{gstructure}{g', d, '}{m', t1, '}', nl, s,'end{gstructure}', nl,
         CASE WHEN d % 20 = 0 THEN concat(s,'tassign{', a, '}{', b, '} ', s,'symi{', a, '}', nl) ELSE '' END,
         s,'begin{module}[id=o', d, ']', nl, s,'usemhmodule[mhrepos=src', (d - d % 10) % 20, ',path=n', d - d % 10, ']{n', d - d % 10, '}', nl, s,'defi{', a, '}', nl,
         s,'begin{module}[id=q', d % 7, ']', nl, s,'importmhmodule{o', d, '}', nl, s,'defi{', b, '}', nl, s,'begin{omtext}', nl,
         s,'atrefi[q', d % 7, '?', b, ']{x}{y} ', s,'atrefi[o', d, '?q', d % 7, '?', b, ']{x}{y} ', s,'atrefi[n', d - d % 10, '?', a, ']{x}{y} ', s,'trefi[?', b, ']{x} ', s,'atrefi[o', d, '?', a, ']{x}{y}', nl,
         s,'end{omtext}', nl, s,'end{module}', nl, s,'atrefi[q', d % 7, '?', b, ']{x}{y}', nl, s,'end{module}', nl)
FROM v WHERE d % 5 = 0
"""

TOKENS_SQL = """
SELECT doc_id, pos, tok AS token, CAST(length(tok) AS BIGINT) AS len,
 CASE WHEN length(tok) >= 9 AND pos % 7 = 0 THEN 2 WHEN length(tok) >= 7 AND pos % 3 = 0 THEN 1 ELSE 0 END AS label,
 CASE WHEN length(tok) >= 9 AND pos % 2 = 1 THEN 2 WHEN length(tok) >= 8 THEN 1 ELSE 0 END AS pred
FROM (SELECT doc_id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS pos
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM documents))
"""

def _q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _run_sql(text: str, run: str) -> str:
    a, b, c = (f"regexp_extract_all({text}, {_q(run)}, {i})" for i in (1, 2, 3))
    return f"array_to_string(list_transform(list_zip({a}, {b}, {c}), lambda x: x[1] || coalesce(replace(x[2], chr(92), '{markup.MASKED}'), '') || coalesce(x[3], '')), '')"


VERBATIM_SQL = f"SELECT path, {_run_sql('text', markup.VERBATIM_RUN)} AS text FROM tex_sources"
#: The parts of each text: macro names, braces and brackets, what is between them.
PARTS_SQL = rf"""
SELECT path, regexp_extract_all({_run_sql('text', markup.COMMENT_RUN)}, '\\[A-Za-z]+[*]?|[{{}}\[\]]|[^\\{{}}\[\]]+|\\') AS a FROM verbatim
"""
DEPTHS_SQL = """
SELECT path, i, part, place, step, r - least(low, r) AS depth, step = -1 AND r < low AS stray FROM (
 SELECT *, least(0, coalesce(min(r) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM (
  SELECT *, CAST(sum(length(part)) OVER (PARTITION BY path ORDER BY i) - length(part) AS BIGINT) AS place, sum(step) OVER (PARTITION BY path ORDER BY i) AS r FROM (
   SELECT path, i, part, CASE part WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END AS step FROM (SELECT path, unnest(a) AS part, generate_subscripts(a, 1) AS i FROM parts))))
"""
#: What stands beside each other inside one pair of braces, a pair itself as one item (g) that ends place ``close``.
ITEMS_SQL = r"""
SELECT path, level, grp, i, place, part, close, CASE WHEN step = 1 AND close IS NOT NULL THEN 'g' WHEN part IN ('[', ']') THEN part WHEN regexp_matches(part, '^\\[A-Za-z]') THEN 'm' ELSE 't' END AS kind FROM (
 SELECT *, sum((step = -1)::INT) OVER (PARTITION BY path, level ORDER BY i) AS grp FROM (
  SELECT *, inner_depth - (step = 1)::INT AS level, CASE WHEN step = 1 THEN lead(i) OVER (PARTITION BY path, inner_depth, step <> 0 ORDER BY i) END AS close FROM (
   SELECT path, i, part, place, CASE WHEN stray THEN 0 ELSE step END AS step, depth + (step = -1 AND NOT stray)::INT AS inner_depth FROM depths))) WHERE step >= 0
"""
#: Items that no pair of brackets holds, or one each; a pair is an item (o) beside what is outside it.
RUNS_SQL = """
SELECT path, level, grp, i, place, part, coalesce(CASE WHEN z IS NULL AND kind IN ('[', ']') THEN -1 WHEN z IS NOT NULL THEN -1 ELSE held END, -1) AS held, coalesce(close, z) AS fin, CASE WHEN z IS NOT NULL THEN 'o' WHEN kind IN ('[', ']') THEN 't' ELSE kind END AS kind FROM (
 SELECT *, last_value(CASE WHEN z IS NOT NULL THEN i WHEN shut THEN -1 END IGNORE NULLS) OVER (PARTITION BY path, level, grp ORDER BY i) AS held FROM (
  SELECT *, CASE WHEN kind = '[' AND lead(kind) OVER w = ']' THEN lead(i) OVER w END AS z, kind = ']' AND coalesce(lag(kind) OVER w, '') = '[' AS shut FROM items WINDOW w AS (PARTITION BY path, level, grp, kind IN ('[', ']') ORDER BY i))) WHERE NOT shut
"""
MACROS_SQL = """
SELECT m.path, row_number() OVER (PARTITION BY m.path ORDER BY m.i) - 1 AS pos, m.part[2:] AS name,
 CASE WHEN len(list_filter(g.spans, lambda s: s.k = 'o')) > 0 THEN '[' || array_to_string(list_transform(list_filter(g.spans, lambda s: s.k = 'o'), lambda s: array_to_string(a[s.f:s.z], '')), ',') || ']' ELSE '' END AS oarg,
 CASE WHEN len(list_filter(g.spans, lambda s: s.k = 'g')) > 0 THEN '{' || array_to_string(list_transform(list_filter(g.spans, lambda s: s.k = 'g'), lambda s: array_to_string(a[s.f:s.z], '')), '}{') || '}' ELSE '' END AS rarg, m.place,
 coalesce(list_transform(list_filter(g.spans, lambda s: s.k = 'g'), lambda s: array_to_string(a[s.f:s.z], '')), []) AS rargs, length(m.part) + coalesce(length(array_to_string(a[m.i + 1:g.fin], '')), 0) AS span
FROM runs m JOIN parts USING (path)
LEFT JOIN (SELECT path, anchor, list({'f': i + 1, 'z': fin - 1, 'k': kind} ORDER BY i) AS spans, max(fin) AS fin FROM
 (SELECT *, last_value(CASE WHEN kind NOT IN ('g', 'o') THEN i END IGNORE NULLS) OVER (PARTITION BY path, level, grp, held ORDER BY i) AS anchor FROM runs) WHERE kind IN ('g', 'o') GROUP BY ALL) g
 ON g.path = m.path AND g.anchor = m.i
WHERE m.kind = 'm'
"""


def _braced(depth: int) -> str:
    return r"[^{}]*" if not depth else r"(?:[^{}]|\{" + _braced(depth - 1) + r"\})*"


ARGS_SQL = f"""
SELECT path, pos, name, oarg, rarg, place, rargs, span, regexp_extract_all(substr(oarg, 2, greatest(length(oarg) - 2, 0)), {_q(r'((?:[^,{}]|' + r'\{' + _braced(5) + r'\})+)')}, 1) AS parts
FROM macros
"""
EDITS_SQL = """
SELECT event_id AS version, ts, concat('/hub/u', user_id, '.tex') AS path,
 CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'change' WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'save' ELSE 'close' END AS kind, value FROM events
"""
FILES_SQL = """
SELECT doc_id, path, kind, lang, text, CAST(octet_length(encode(text)) AS BIGINT) AS size,
 TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS mtime FROM tex_sources
"""
ENVS_SQL = """
SELECT a.path, a.env, a.pos AS begin_pos, z.pos AS end_pos, z.env AS end_env, CAST(a.depth AS INT) AS depth FROM env_steps a
LEFT JOIN env_steps z ON a.path = z.path AND a.depth = z.depth AND a.nth = z.nth AND z.step = -1 WHERE a.step = 1
"""
ENV_STEPS_SQL = """
SELECT *, row_number() OVER (PARTITION BY path, depth, step ORDER BY pos) AS nth FROM (SELECT path, pos, step, env, r - least(low, r) + (step = -1)::INT AS depth
 FROM (SELECT *, least(0, coalesce(min(r) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low
  FROM (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY pos) AS r FROM (SELECT path, pos, CASE WHEN name = 'begin' THEN 1 ELSE -1 END AS step, rargs[1] AS env FROM args WHERE name IN ('begin', 'end')))) WHERE NOT (step = -1 AND r < low))
"""


def opt(key: str, parts: str = "parts") -> str:
    """Value of ``key=`` among optional arguments."""
    return f"list_filter({parts}, lambda x: starts_with(x, '{key}='))[1][{len(key) + 2}:]"


REGIONS_SQL = f"""
SELECT path, begin_pos, end_pos, env, depth, kind, lang, source, target, structure,
 CASE WHEN env IN ('module', 'module*', 'smentry') THEN coalesce(id, path || '#' || begin_pos) WHEN kind IN ('module', 'binding') THEN rargs[2] END AS module,
 CASE WHEN env IN ('module', 'module*', 'smentry') AND id IS NULL THEN 3 ELSE 0 END AS access
FROM (SELECT e.path, e.begin_pos, coalesce(e.end_pos, 1099511627776) AS end_pos, e.env, e.depth, a.rargs, {opt('id')} AS id,
   CASE WHEN e.env IN ('modsig', 'module', 'module*', 'smentry', 'gviewsig') THEN 'module' WHEN e.env IN ('mhmodnl', 'modnl', 'gviewnl') THEN 'binding'
    WHEN e.env IN ('mhview', 'mhviewnl') THEN 'view' WHEN e.env IN ('gstructure', 'gstructure*') THEN 'structure' END AS kind,
   CASE WHEN e.env IN ('mhmodnl', 'modnl', 'gviewnl') THEN a.rargs[3] END AS lang,
   CASE WHEN e.env = 'gviewsig' THEN a.rargs[3] WHEN e.env IN ('gviewnl', 'mhview', 'mhviewnl') THEN a.rargs[-2] END AS source,
   CASE WHEN e.env = 'gviewsig' THEN a.rargs[4] WHEN e.env IN ('gviewnl', 'mhview', 'mhviewnl') THEN a.rargs[-1] END AS target,
   CASE WHEN e.env IN ('gstructure', 'gstructure*') THEN a.rargs[3] END AS structure
  FROM envs e JOIN args a ON a.path = e.path AND a.pos = e.begin_pos) WHERE kind IS NOT NULL
"""
MODULES_SQL = "SELECT path, begin_pos AS pos, module, env AS module_type, access FROM regions WHERE kind = 'module'"
BINDINGS_SQL = "SELECT path, begin_pos AS pos, module, lang FROM regions WHERE kind = 'binding'"
PLACED_SQL = """
SELECT a.*, n.around, n.env, n.module, n.lang, n.source, n.target FROM args a LEFT JOIN
 (SELECT a.path, a.pos, r.kind AS around, r.env, r.module, r.lang, r.source, r.target FROM args a JOIN regions r ON a.path = r.path AND r.begin_pos < a.pos AND r.end_pos > a.pos
  QUALIFY row_number() OVER (PARTITION BY a.path, a.pos ORDER BY r.begin_pos DESC) = 1) n USING (path, pos)
"""
_NAME = f"coalesce({opt('name')}, CASE WHEN regexp_matches(name, '^(sym|var)def[*]?$') THEN rargs[1] WHEN regexp_matches(name, '^m?am?([dDtT]ref|[dD]ef)') THEN array_to_string(rargs[2:], '-') ELSE array_to_string(rargs, '-') END)"
SYMBOLS_SQL = f"""
SELECT path, module, env AS module_type, pos, {_NAME} AS name,
 CASE WHEN regexp_matches(name, '^sym[ivx]+[*]?$') THEN 'sym' WHEN regexp_matches(name, '^(sym|var)def[*]?$') THEN 'symdef' WHEN regexp_matches(name, '^[ma]*[dD]ef') THEN 'def' ELSE 'dref' END AS def_type,
 list_contains(parts, 'noverb') AS noverb, coalesce(list_sort(string_split(regexp_replace({opt('noverb')}, '^[{{]|[}}]$', '', 'g'), ',')), []) AS noverbs
FROM placed WHERE around = 'module' AND regexp_matches(name, '^(sym[ivx]+|symdef|vardef|[ma]*[dD]ef[ivx]+s?|[ma]*[dD]ref[ivx]+s?)[*]?$')
"""
_REPO = f"coalesce({opt('mhrepos')}, {opt('repos')})"
_HINT = f"""CASE WHEN regexp_matches(name, '^g(import|use)[*]?$') THEN
  coalesce('/hub/' || list_filter(parts, lambda x: NOT contains(x, '='))[1] || '/source', regexp_extract(path, '^(.*)/[^/]*$', 1)) || '/' || rargs[1] || '.tex'
 WHEN {opt('load')} IS NOT NULL THEN '/hub/' || {opt('load')} || '/' || rargs[1] || '.tex'
 WHEN {opt('dir')} IS NOT NULL THEN coalesce('/hub/' || {_REPO} || '/source', regexp_extract(path, '^(.*/source)/', 1)) || '/' || {opt('dir')} || '/' || rargs[1] || '.tex'
 WHEN {opt('path')} IS NOT NULL THEN coalesce('/hub/' || {_REPO} || '/source', regexp_extract(path, '^(.*/source)/', 1)) || '/' || {opt('path')} || '.tex'
 WHEN {_REPO} IS NULL THEN path END"""
_BESIDE = "regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || {0} || '.tex'"
IMPORT = "regexp_matches(name, '^(g(import|use)|(import|use)(mh)?module)[*]?$')"
DEPS_SQL = f"""
SELECT path, pos, rargs[1] AS module, name AS macro, contains(name, 'import') AS export, false AS quiet, {_HINT} AS hint FROM args WHERE {IMPORT}
UNION ALL SELECT path, begin_pos, m, env, true, true, {_BESIDE.format('m')} FROM
 (SELECT path, begin_pos, env, module AS m FROM regions WHERE kind = 'binding' UNION ALL SELECT path, begin_pos, env, structure FROM regions
  UNION ALL SELECT path, begin_pos, env, source FROM regions UNION ALL SELECT path, begin_pos, env, target FROM regions) WHERE m IS NOT NULL
"""
REFS_SQL = f"""
SELECT path, pos, 0 AS nth, name AS macro, t AS target, CASE WHEN contains(t, '?') THEN nullif(split_part(t, '?', 1), '') ELSE nullif(t, '') END AS module,
 coalesce(CASE WHEN contains(t, '?') THEN nullif(string_split(t, '?')[-1], '') END, {_NAME}) AS symbol, module AS scope
FROM (SELECT *, coalesce(list_filter(parts, lambda x: NOT contains(x, '='))[1], '') AS t FROM placed WHERE regexp_matches(name, '^[ma]*[dDtT]ref[ivx]+s?[*]?$'))
UNION ALL SELECT path, pos, 0, name, '', module, {_NAME}, module FROM placed WHERE around = 'binding' AND regexp_matches(name, '^[ma]*[dD]ef[ivx]+s?[*]?$')
UNION ALL SELECT path, pos, 0, name, rargs[1], CASE WHEN contains(rargs[1], '?') THEN split_part(rargs[1], '?', 1) ELSE source END, CASE WHEN contains(rargs[1], '?') THEN string_split(rargs[1], '?')[-1] ELSE rargs[1] END, module
 FROM placed WHERE source IS NOT NULL AND regexp_matches(name, '^[tv]assign[*]?$')
UNION ALL SELECT path, pos, 1, name, '', target, rargs[2], module FROM placed WHERE source IS NOT NULL AND regexp_matches(name, '^vassign[*]?$')
"""

_VIEWS = {
    "tex_sources": (TEX_SQL, ()), "tokens": (TOKENS_SQL, ()), "verbatim": (VERBATIM_SQL, ("tex_sources",)), "parts": (PARTS_SQL, ("verbatim",)), "depths": (DEPTHS_SQL, ("parts",)), "items": (ITEMS_SQL, ("depths",)), "runs": (RUNS_SQL, ("items",)), "macros": (MACROS_SQL, ("runs",)), "args": (ARGS_SQL, ("macros",)),
    "env_steps": (ENV_STEPS_SQL, ("args",)), "envs": (ENVS_SQL, ("env_steps",)), "regions": (REGIONS_SQL, ("envs",)), "placed": (PLACED_SQL, ("regions",)),
    "edits": (EDITS_SQL, ()), "files": (FILES_SQL, ("tex_sources",)), "modules": (MODULES_SQL, ("regions",)), "bindings": (BINDINGS_SQL, ("regions",)),
    "symbols": (SYMBOLS_SQL, ("placed",)), "deps": (DEPS_SQL, ("regions",)), "refs": (REFS_SQL, ("placed",)),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` text that defines the named views and what they need, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _VIEWS[n][1]:
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('parts', 'runs', 'args', 'envs', 'placed') else ''}({_VIEWS[n][0]})" for n in order)


class Tables:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._args: DataFrame | None = None
        self._tex: DataFrame | None = None
        self._own: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str, table: str) -> DataFrame:
        """A view's SQL over one given table, under a name of its own."""
        self.table(table).createOrReplaceTempView(f"marklens_{table}")
        return self.spark.sql(text.replace(f"FROM {table}", f"FROM marklens_{table}"))

    def tex_sources(self) -> DataFrame:
        """Written once: the texts are made of long expressions, which plans with many branches would repeat."""
        if self._tex is None:
            self._tex = write_table(self._sql(TEX_SQL, "documents"), "tex")
        return self._tex

    def files(self) -> DataFrame:
        size = F.octet_length("text").cast("long")
        mtime = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)")
        return self.tex_sources().select("doc_id", "path", "kind", "lang", "text", size.alias("size"), mtime.alias("mtime"))

    def tokens(self, together: bool = False) -> DataFrame:
        """All tokens; ``together``: those of a document lie in one partition."""
        docs = self.table("documents").select("doc_id", "text")
        t = tokens.words(features.together(docs) if together else docs, "doc_id", F.lower("text"), "[a-z0-9]+")
        n, p = F.length("token"), F.col("pos")
        label = F.when((n >= 9) & (p % 7 == 0), 2).when((n >= 7) & (p % 3 == 0), 1).otherwise(0)
        pred = F.when((n >= 9) & (p % 2 == 1), 2).when(n >= 8, 1).otherwise(0)
        return t.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", n.cast("long").alias("len"), label.alias("label"), pred.alias("pred"))

    def macros(self) -> DataFrame:
        return markup.macros(self.tex_sources())

    def args(self) -> DataFrame:
        """The macro table, written once: everything else stands on it."""
        if self._args is None:
            self._args = write_table(markup.with_offsets(markup.arguments(self.macros())), "macros")
        return self._args

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._own:
            self._own[name] = write_table(build(), name)
        return self._own[name]

    def envs(self) -> DataFrame:
        return self._once("envs", lambda: tokens.environments(self.args()))

    def regions(self) -> DataFrame:
        return self._once("regions", lambda: markup.regions(self.args(), self.envs()))

    def placed(self) -> DataFrame:
        return self._once("placed", lambda: markup.placed(self.args(), self.regions()))

    def modules(self) -> DataFrame:
        return markup.modules(self.regions())

    def bindings(self) -> DataFrame:
        return markup.bindings(self.regions())

    def symbols(self) -> DataFrame:
        return markup.symbols(self.placed())

    def deps(self) -> DataFrame:
        return markup.dependencies(self.args(), self.regions())

    def refs(self) -> DataFrame:
        return markup.references(self.placed())

    def edits(self) -> DataFrame:
        return self._sql(EDITS_SQL, "events")
