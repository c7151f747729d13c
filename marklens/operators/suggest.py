"""Suggestions: what may be typed next, as prefix joins from contexts to candidates."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, markup

# fixed values: argument names that each kind of macro takes
KEYWORDS = {
    "import": ("dir", "load", "mhrepos", "path"),
    "symbol": ("name", "noverb"),
    "definition": ("name",),
    "environment": ("id", "title"),
}


def classify(context: Column) -> Column:
    """Struct ``(macro, part, fragment)`` of the unfinished macro at the end of a context; null where there is none.

    ``part`` is ``oarg`` or ``rarg``; ``fragment`` is what is typed of the last argument so far.
    """
    last = r"\\([A-Za-z]+\*?)(?:\[[^\[\]{}]*\])?(?:\{[^{}]*\})*"
    o = F.regexp_extract(context, r"\\([A-Za-z]+\*?)\[([^\[\]{}]*)$", 2)
    r = F.regexp_extract(context, last + r"\{([^{}]*)$", 2)
    in_o = context.rlike(r"\\[A-Za-z]+\*?\[[^\[\]{}]*$")
    in_r = context.rlike(last + r"\{[^{}]*$")
    macro = F.when(in_o, F.regexp_extract(context, r"\\([A-Za-z]+\*?)\[[^\[\]{}]*$", 1)).otherwise(F.regexp_extract(context, last + r"\{[^{}]*$", 1))
    part = F.when(in_o, "oarg").otherwise("rarg")
    fragment = F.substring_index(F.when(in_o, o).otherwise(r), ",", -1)
    return F.when(in_o | in_r, F.struct(macro.alias("macro"), part.alias("part"), fragment.alias("fragment")))


def prefix_join(wanted: DataFrame, candidates: DataFrame, value: str, on: tuple[str, ...] = (), fragment: str = "fragment") -> DataFrame:
    """``wanted`` joined to the candidates whose ``value`` starts with ``fragment``, and that agree in ``on``.

    Each candidate stands under its prefixes, so this is an equi-join, not a comparison of all pairs.
    """
    return wanted.join(prefixes(candidates, wanted, value, fragment), [*on, fragment])


def prefixes(candidates: DataFrame, wanted: DataFrame, value: str, fragment: str = "fragment") -> DataFrame:
    """``candidates`` once for each prefix of ``value`` that is as long as some ``fragment`` of ``wanted``, as ``fragment``."""
    lengths = wanted.select(F.length(fragment).alias("n")).agg(F.array_sort(F.collect_set("n")).alias("__lengths"))  # one row
    own = F.transform(F.filter("__lengths", lambda n: n <= F.length(value)), lambda n: F.substring(F.col(value), F.lit(1), n))
    return candidates.join(F.broadcast(lengths), F.lit(True)).withColumn(fragment, F.explode(own)).drop("__lengths")


def repositories(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """``wanted(module_type, fragment)`` with the repositories that hold modules of that type."""
    return prefix_join(wanted, modules.select("module_type", "repository").distinct(), "repository", ("module_type",))


def modules_in(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """``(place, fragment, module)`` for ``wanted(path, repository, fragment)``: modules of the repository, or of the file's own folder where none is
    given. ``modules(path, repository, module)``."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = wanted.select(F.coalesce("repository", folder).alias("place"), "fragment").distinct()
    known = modules.select(F.col("repository").alias("place"), "module").union(modules.select(folder, "module")).distinct()
    return prefix_join(own, known, "module", ("place",))


def matching(wanted: DataFrame, candidates: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Candidates that agree with every given constraint; a null in ``wanted`` asks for nothing, so a row of nulls gets all.

    One equi-join for each pattern of given columns; of rows without constraints one stands for all, so its join adds constants.
    """
    parts = []
    right = candidates.select(*(F.col(c).alias(f"k_{c}") for c in candidates.columns))
    for given in product((False, True), repeat=len(columns)):
        on = [c for c, g in zip(columns, given) if g]
        rows = wanted.select(*columns).distinct().filter(reduce(Column.__and__, [F.col(c).isNotNull() if g else F.col(c).isNull() for c, g in zip(columns, given)]))
        parts.append(rows.join(right, reduce(Column.__and__, [F.col(c) == F.col(f"k_{c}") for c in on])) if on else right.join(F.broadcast(rows), F.lit(True)).select(*columns, *right.columns))
    return reduce(DataFrame.unionByName, parts)


def keywords(wanted: DataFrame) -> DataFrame:
    """``wanted(kind, fragment)`` with the argument names of the kind that start so."""
    rows = F.explode(F.create_map(*(x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))))
    table = wanted.sparkSession.range(1).select(rows.alias("kind", "ks")).select("kind", F.explode("ks").alias("keyword"))
    return wanted.join(F.broadcast(table), "kind").filter(F.startswith("keyword", "fragment"))  # a table of fixed values


def symbol_names(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """``wanted(path, fragment)`` with names of the file's own symbols."""
    return prefix_join(wanted, symbols.select("path", "name").distinct(), "name", ("path",))


def qualified(wanted: DataFrame, symbols: DataFrame, sets: DataFrame) -> DataFrame:
    """``(module, fragment, name)`` for ``wanted(module, fragment)``: names that the module has or sees through ``sets`` (of ``link.reached``), noverb ones
    left out. ``symbols(module, name, text, noverb)``; modules and names go by numbers, only ``text`` is compared.

    What is left out goes before symbols meet the sets. A seen name that is also the module's own is noverb or among its own here.
    """
    rows = prefixes(symbols, wanted, "text")
    own = rows.filter("NOT noverb").select("module", "fragment", "name")
    plain = rows.join(symbols.filter("noverb").select("name").distinct(), "name", "left_anti").filter("module <> 0")
    seen = graph.members(sets, plain.select(F.col("module").alias("node"), "fragment", "name").distinct())
    return own.union(seen.select(F.col("root").alias("module"), "fragment", "name")).join(wanted, ["module", "fragment"], "left_semi").distinct()


def contexts(args: DataFrame) -> DataFrame:
    """``(path, pos, context)``: lines broken off inside the first argument of each macro, optional ones first."""
    head = F.concat(F.lit("\\"), F.col("name"))
    o = F.concat(head, F.substring("oarg", 1, 4))
    r = F.concat(head, F.col("oarg"), F.substring("rarg", 1, 3))
    whole = args.filter((F.col("oarg") != "") | (F.col("rarg") != ""))
    return whole.select("path", "pos", F.when(F.length("oarg") > 5, o).otherwise(r).alias("context"))


def kind_of(macro: Column) -> Column:
    """The keyword table's kind of a macro."""
    return (
        F.when(macro.isin("begin", "end"), "environment").when(macro.rlike(markup.IMPORTS), "import")
        .when(macro.rlike(markup.SYMBOL), "symbol").when(macro.rlike(markup.DEFINITION), "definition").otherwise("other")
    )
