"""Diagnostics: every broken rule as a row of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.sources.shared import checkpoint

from . import link, markup

# fixed values: severities and diagnostic codes
SEVERITY = {"error": 1, "warning": 2, "information": 3, "hint": 4}
CODES = {
    "redundant-import-check": 2, "duplicate-symbol-check": 1, "invalid-redefinition": 1, "location-check": 1, "is-current-dir-check": 2,
    "repos-deprecation-check": 2, "mtref-deprecation-check": 2, "mtref-questionmark-check": 1, "filename-mismatch-check": 2, "parser-exception": 1,
    "unique-dependency-name-check": 1, "undefined-symbol": 1, "undefined-module-not-exported": 1, "access-modifier-check": 1, "cyclic-dependency-check": 1,
    "file-not-found": 1, "reference-type-check": 1, "referenced-noverb-symbol": 2, "generic-trefier-tag-hint": 3, "missing-import-hint": 3,
}


def severity(text: Column) -> Column:
    """Severity from a name or number, error by default."""
    names = F.create_map(*(F.lit(v) for n, s in SEVERITY.items() for v in (n, s)))
    return F.coalesce(F.element_at(names, F.lower(text)), F.when(text.rlike("^[1-4]$"), text.try_cast("int")), F.lit(1))


# fixed values: tags of codes whose markup is unnecessary (1) or deprecated (2)
TAGS = {"redundant-import-check": 1, "is-current-dir-check": 1, "repos-deprecation-check": 2, "mtref-deprecation-check": 2}


def _rows(df: DataFrame, code: str, message: Column, related: Column | None = None) -> DataFrame:
    """Rows of one rule: ``tags`` by the code, ``related`` the place of another macro in the same file, or null."""
    tags = F.array(*([F.lit(TAGS[code])] if code in TAGS else [])).cast("array<int>")
    return df.select("path", "pos", F.lit(code).alias("code"), F.lit(CODES[code]).alias("severity"), message.alias("message"), tags.alias("tags"), (F.lit(None) if related is None else related).cast("long").alias("related"))


def deprecated(args: DataFrame) -> DataFrame:
    """Deprecated markup: module references by ``mtref``, without ``?``, and ``repos=``."""
    m = args.filter(F.col("name").rlike("^mtref"))
    bare = m.filter(~F.col("oarg").contains("?"))
    r = args.filter(F.exists("parts", lambda x: x.startswith("repos=")))
    return reduce(DataFrame.union, [_rows(m, "mtref-deprecation-check", F.lit("mtref is deprecated")), _rows(bare, "mtref-questionmark-check", F.lit("mtref without ?")), _rows(r, "repos-deprecation-check", F.lit("repos is deprecated"))])


# fixed values: codes of imports without one module to mean
UNRESOLVED = {"unique-dependency-name-check": "several modules: ", "undefined-module-not-exported": "no such module: ", "file-not-found": "no file for: ", "access-modifier-check": "private: "}


def unresolved(resolved: DataFrame) -> DataFrame:
    """Rows for imports whose status is one of the codes above, in one pass."""
    own = lambda values: F.element_at(F.create_map(*(F.lit(v) for c in UNRESOLVED for v in (c, values[c]))), F.col("status"))
    message = F.concat(own(UNRESOLVED), F.lit('"'), F.concat_ws("", "module"), F.lit('"'))
    bad = resolved.filter(F.col("status").isin(*UNRESOLVED))
    return bad.select("path", "pos", F.col("status").alias("code"), own(CODES).alias("severity"), message.alias("message"), F.array().cast("array<int>").alias("tags"), F.lit(None).cast("long").alias("related"))


def all_checks(placed: DataFrame, regions: DataFrame, envs: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, pos, code, severity, message, tags, related)`` of all rules that a corpus alone decides, one branch each; cycles and
    predicted tags come from ``cycle_rows`` and ``tag_rows``."""
    quoted = lambda *c: F.concat(F.lit('"'), F.concat_ws("?", *c), F.lit('"'))
    say = lambda text, *c: F.concat(F.lit(text), quoted(*c))
    modules, bindings, symbols = markup.modules(regions), markup.bindings(regions), markup.symbols(placed)
    deps, refs = markup.dependencies(placed, regions), markup.references(placed)
    named = refs.filter("module IS NOT NULL")
    undefined = checkpoint(link.gated(named, modules, symbols))
    hints = link.missing_import_hints(undefined, symbols)
    error = markup.import_error(F.col("name"), F.col("parts"))
    wrong = placed.select("path", "pos", error.alias("why")).filter("why IS NOT NULL")
    counts = markup.kinds(placed).filter("arity_error").select("path", "pos", F.format_string("%s takes %d arguments, not %d", "name", "wanted", "n_args").alias("why"))
    open_envs = envs.filter(F.col("end_pos").isNull() | (F.col("env") != F.col("end_env"))).select("path", F.col("begin_pos").alias("pos"), F.concat(F.lit("not closed: "), "env").alias("why"))
    parts = [
        _rows(link.redundant_imports(deps, envs), "redundant-import-check", say("already imported: ", "module"), F.col("first_pos")),
        _rows(link.duplicate_symbols(symbols), "duplicate-symbol-check", say("defined before: ", "module", "name"), F.col("first_pos")),
        _rows(link.invalid_redefinitions(symbols), "invalid-redefinition", say("differs from the first: ", "module", "name"), F.col("first_pos")),
        misplaced(placed, regions),
        _rows(link.current_places(placed), "is-current-dir-check", F.concat(F.lit("is the current one: "), "what")),
        _rows(link.name_mismatches(modules, bindings), "filename-mismatch-check", say("file and module differ: ", "module")),
        _rows(wrong.union(counts).union(open_envs), "parser-exception", F.col("why")),
        unresolved(link.resolve_modules(deps, modules, files)),
        _rows(undefined, "undefined-symbol", say("no such symbol: ", "module", "symbol")),
        _rows(hints, "missing-import-hint", F.format_string("%s is in %d modules", "symbol", "n_modules")),
        _rows(link.noverb_references(named, symbols, bindings), "referenced-noverb-symbol", say("noverb: ", "module", "symbol")),
        deprecated(placed),
    ]
    return reduce(DataFrame.unionByName, parts)


def cycle_rows(deps: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imports within one component of ``nodes(node, component)``, so that the target leads back to the importing module; an import from one cycle to another isn't one."""
    own = deps.join(modules.select("path", F.col("module").alias("src")), "path").filter("NOT quiet")
    on = own.join(nodes.select(F.col("node").alias("module"), "component"), "module").join(nodes.select(F.col("node").alias("src"), "component"), ["src", "component"])
    return _rows(on, "cyclic-dependency-check", F.concat(F.lit("on a cycle: "), "src", F.lit(" > "), "module"))


def type_rows(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return _rows(link.type_mismatches(refs, symbols), "reference-type-check", F.concat(F.lit("of another type: "), "symbol"))


def tag_rows(tags: DataFrame) -> DataFrame:
    """Of ``tags(path, pos, token, score)``."""
    return _rows(tags, "generic-trefier-tag-hint", F.format_string('Label for "%s": %.2f', "token", "score"))


def misplaced(placed: DataFrame, regions: DataFrame) -> DataFrame:
    """Symbol macros outside modules, ``symi`` in modules that aren't signatures, assignments outside views, views inside something else."""
    n, around = F.col("name"), F.coalesce("around", F.lit("none"))
    needs = (n.rlike(markup.SYMBOL) & ~n.rlike("^vardef")) | n.rlike(r"^[ma]*[dD]ref[ivx]+s?\*?$")
    why = (
        F.when(needs & (around != "module"), "outside a module: ").when(n.rlike(markup.SYM) & ~F.col("env").isin("modsig", "gviewsig"), "only signatures hold: ")
        .when(n.rlike(markup.ASSIGNMENT) & F.col("source").isNull() & (around != "structure"), "outside a view: ")
    )
    own = placed.select("path", "pos", F.concat(why, n).alias("why")).filter("why IS NOT NULL")
    views = regions.filter((F.col("env") == "gviewsig") & (F.col("depth") > 1)).select("path", F.col("begin_pos").alias("pos"), F.lit("not at the root: gviewsig").alias("why"))
    return _rows(own.union(views), "location-check", F.col("why"))


def located(diagnostics: DataFrame, macros: DataFrame, sources: DataFrame) -> DataFrame:
    """``diagnostics`` plus 0-based ``line`` and ``character`` of their macro: ``macros(path, pos, place)`` and the texts tell."""
    from .tokens import line_and_character

    line, char = line_and_character(F.col("text"), F.col("place"))
    out = diagnostics.join(macros.select("path", "pos", "place"), ["path", "pos"]).join(sources.select("path", "text"), "path")
    return out.withColumns({"line": line, "character": char}).drop("text")


def at_most(diagnostics: DataFrame, level: int) -> DataFrame:
    return diagnostics.filter(F.col("severity") <= level)


def formatted(diagnostics: DataFrame) -> DataFrame:
    """One text line per diagnostic of ``located``, 1-based."""
    name = F.element_at(F.create_map(*(F.lit(v) for n, s in SEVERITY.items() for v in (s, n.capitalize()))), F.col("severity"))
    return diagnostics.select(F.format_string("%s:%d:%d %s - %s (%s)", "path", F.col("line") + 1, F.col("character") + 1, name, "message", "code").alias("line"))


def republish(runs: DataFrame) -> DataFrame:
    """Only the rows of each file's latest run."""
    return runs.withColumn("last", F.max("run").over(W.partitionBy("path"))).filter("run = last").drop("last")


def tag_hints(tags: DataFrame) -> DataFrame:
    return tags.select("*", F.format_string('Label for "%s": %.2f', "token", "score").alias("message"))
