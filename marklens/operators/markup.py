"""Markup extraction: one pass over the texts makes the macro table, every kind is a filter and projection on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nesting

# fixed values: names of the markup's macros and environments
SIGNATURE_ENVS = ("modsig", "gviewsig")
MODULE_ENVS = ("modsig", "module", "module*", "smentry", "gviewsig")
BINDING_ENVS = ("mhmodnl", "modnl", "gviewnl")
VIEW_ENVS = ("gviewsig", "gviewnl", "mhview", "mhviewnl")
STRUCTURE_ENVS = ("gstructure", "gstructure*")
SCOPE_ENVS = ("omtext", "nomtext", "example", "omgroup", "frame")
GIMPORTS = r"^g(import|use)\*?$"
IMPORTS = r"^(g(import|use)|(import|use)(mh)?module)\*?$"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
SYM = r"^sym[ivx]+\*?$"
SYMBOL = r"^(sym[ivx]+|symdef|vardef)\*?$"
DEFINITION = r"^[ma]*[dD]ef[ivx]+s?\*?$"
REFERENCE = r"^[ma]*[dDtT]ref[ivx]+s?\*?$"
ASSIGNMENT = r"^[tv]assign\*?$"
PRIVATE = 3
END = nesting.END


def nested(depth: int, more: str = "") -> str:
    """Text with braces that pair, ``depth`` levels of them. ``more='+'`` makes Java's matcher commit to what it has read,
    which changes no match and keeps it linear."""
    p = rf"[^{{}}]*{more}"
    for _ in range(depth):
        p = rf"(?:[^{{}}]+{more}|\{{{p}\}})*{more}"
    return p


LEVELS = 12  # of braces that one pattern reads; deeper texts are swept


def argument_parts(more: str = "") -> tuple[str, str]:
    """Patterns of an optional argument and of a required one, in texts whose braces nest up to ``LEVELS`` deep."""
    inner = nested(LEVELS - 1, more)
    return rf"\[(?:[^\[\]{{}}]+{more}|\{{{inner}\}})*{more}\]", rf"\{{{inner}\}}"


VERBATIM = (
    r"\\(?:verb|lstinline)\*?(?:\|[^|\n]*\||![^!\n]*!|\+[^+\n]*\+)|\\lstinline\{[^{}\n]*\}"
    r"|\\begin\{(?:verbatim|lstlisting)\*?\}(?s:.*?)\\end\{(?:verbatim|lstlisting)\*?\}"
)
MASKED = "∖"  # what a backslash becomes where it starts no macro
#: Each match: what stays, what is masked, what stays.
VERBATIM_RUN = rf"([^\\]*)(?:({VERBATIM})|(\\[\\%]|\\)|\z)"
COMMENT_RUN = r"([^\\%]*)(?:(%[^\n]*)|(\\[\\%]|\\)|\z)"


def _hidden(part: Column) -> Column:
    return F.replace(part, F.lit("\\"), F.lit(MASKED))


def mask_verbatim(text: Column) -> Column:
    """Contents of verbatim macros and environments stay as text: their backslashes no longer start macros. No place moves."""
    # what comes before the first backslash of a match has none, and an escape is two characters at most
    parts = F.transform(F.regexp_extract_all(text, F.lit(VERBATIM_RUN), F.lit(0)), lambda m: F.when(F.length(m) - F.instr(m, "\\") >= 2, _hidden(m)).otherwise(m))
    return F.when(text.rlike(r"\\(?:verb|lstinline|begin\{(?:verbatim|lstlisting))"), F.array_join(parts, "")).otherwise(text)


def mask_comments(text: Column) -> Column:
    """Comments hold no macros; no place moves. An escaped ``%`` starts none."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(COMMENT_RUN), F.lit(0)), lambda m: F.when(F.rlike(m, F.lit(r"^[^\\]*%")), _hidden(m)).otherwise(m))
    return F.when(text.contains("%"), F.array_join(parts, "")).otherwise(text)


def brace_depth(text: Column) -> Column:
    """How deep braces nest in a text; a closing one without an opening one counts for nothing."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, brace):
        now = F.greatest(acc["now"] + F.when(brace == "{", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0)), start, step, lambda acc: acc["most"])


def is_deep(text: Column) -> Column:
    """Whether braces nest deeper than ``LEVELS``. Few opening ones can't; of more, pairs with nothing between them go ``LEVELS`` times, and only texts
    that still have an opening one are gone through brace by brace."""
    opening = F.length(text) - F.length(F.replace(text, F.lit("{")))
    left = F.regexp_replace(text, r"[^{}]++", "")
    for _ in range(LEVELS):
        left = F.replace(left, F.lit("{}"))
    return F.when(opening <= LEVELS, F.lit(False)).when(~left.contains("{"), F.lit(False)).otherwise(brace_depth(text) > LEVELS)


def macros(sources: DataFrame) -> DataFrame:
    """``(path, pos, name, oarg, rarg, rargs, lead, span)`` in document order, macros inside arguments included.

    Arguments follow the name without a gap, optional and required ones in any order. ``oarg`` holds the optional ones in one pair of brackets, with commas
    between; ``rarg`` the required ones with their braces, ``rargs`` each without. ``lead`` is the length of the text between the macro's
    backslash and the name before it, ``span`` that of the macro with its arguments. Verbatim text and comments hold none.

    Texts whose braces nest up to ``LEVELS`` deep are read in place, by two patterns. Deeper ones go through ``swept``, at any depth.
    """
    deep = is_deep(F.col("text"))  # masking leaves braces alone, so this comes first and once for either way
    clean = lambda own: own.select("path", mask_comments(mask_verbatim(F.col("text"))).alias("clean"))
    return _read(clean(sources.filter(~deep))).union(swept(clean(sources.filter(deep))))


def _options(given: Column) -> Column:
    """Optional arguments, each in brackets, as one."""
    inner = F.transform(given, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(F.size(given) > 0, F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))).otherwise("")


def _braced(given: Column) -> Column:
    return F.array_join(F.transform(given, lambda x: F.concat(F.lit("{"), x, F.lit("}"))), "")


def _read(clean: DataFrame) -> DataFrame:
    optional, required = argument_parts("+")
    head = r"[^\\]*+(?:\\(?![A-Za-z])[^\\]*+)*+\\([A-Za-z]++\*?+)"
    matched = clean.select("path", F.regexp_extract_all("clean", F.lit(head), F.lit(0)).alias("heads"), F.regexp_extract_all("clean", F.lit(rf"{head}(?=((?:{optional}|{required})*+))"), F.lit(2)).alias("args"))
    rows = matched.select("path", F.posexplode(F.arrays_zip("heads", "args")).alias("pos", "x"))
    out = rows.select("path", F.col("pos").cast("long").alias("pos"), F.substring_index("x.heads", "\\", -1).alias("name"), F.col("x.args").alias("args"), F.length("x.heads").alias("size"))
    each = F.regexp_extract_all("args", F.lit(rf"{optional}|{required}"), F.lit(0))
    out = out.withColumn("each", each)
    opts, req = F.filter("each", lambda x: x.startswith("[")), F.filter("each", lambda x: x.startswith("{"))
    rargs = F.transform(req, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    size = F.length("name") + 1
    return out.select("path", "pos", "name", _options(opts).alias("oarg"), F.array_join(req, "").alias("rarg"), rargs.alias("rargs"), (F.col("size") - size).alias("lead"), (size + F.length("args")).alias("span"))


def swept(clean: DataFrame) -> DataFrame:
    """``macros`` of ``clean(path, clean)`` at any depth of braces: delimiters are rows, their running depth pairs them, and an
    argument belongs to the macro that only arguments part it from.

    All windows are within a text, in order, so it moves once. Then it falls into chunks, each from a macro outside all
    braces up to the next, in which the macros look up their arguments.
    """
    parts = F.regexp_extract_all("clean", F.lit(r"\\[A-Za-z]++\*?+|[{}\[\]]|[^\\{}\[\]]++|\\"), F.lit(0))
    own = clean.select("path", F.posexplode(parts).alias("i", "part"))
    kind = F.when(F.col("part").isin("{", "}", "[", "]"), F.col("part")).when(F.col("part").rlike(r"^\\[A-Za-z]"), "m").otherwise("t")
    order = W.partitionBy("path").orderBy("i")
    rows = own.withColumn("kind", kind).withColumn("step", F.when(F.col("kind") == "{", 1).when(F.col("kind") == "}", -1).otherwise(0))
    rows = rows.withColumn("at", F.sum(F.length("part")).over(order) - F.length("part"))
    rows = nesting.with_depth(rows, ["path"], ["i"]).withColumn("kind", F.when(F.col("stray"), "t").otherwise(F.col("kind")))
    opens, closes = F.col("kind") == "{", F.col("kind") == "}"
    # a brace pairs with the next one of its depth; one that is never closed is text, and what follows isn't inside it
    rows = rows.withColumn("inner", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth")))
    rows = rows.withColumn("close", F.when(opens, F.lead("at").over(W.partitionBy("path", "inner", F.col("kind").isin("{", "}")).orderBy("i"))))
    rows = rows.withColumn("lift", F.sum((opens & F.col("close").isNull()).cast("int")).over(order))
    # an opening brace stands for its pair one level above; a closing one parts what its pair holds from what the next pair holds
    rows = rows.withColumn("level", F.col("inner") - F.when(opens, 1).otherwise(0))
    rows = rows.withColumn("group", F.sum(closes.cast("int")).over(W.partitionBy("path", "level").orderBy("i")))
    rows = rows.withColumn("chunk", F.sum(((F.col("kind") == "m") & (F.col("level") == F.col("lift"))).cast("int")).over(order))
    items = rows.filter("kind <> '}'").withColumn("kind", F.when(opens & F.col("close").isNotNull(), "g").when(opens, "t").otherwise(F.col("kind")))
    # brackets pair with the next bracket beside them; a pair is one item, and what it holds a sequence of its own
    signs = F.col("kind").isin("[", "]")
    w = W.partitionBy("path", "level", "group", signs).orderBy("i")
    items = items.withColumn("z", F.when((F.col("kind") == "[") & (F.lead("kind").over(w) == "]"), F.lead("at").over(w)))
    items = items.withColumn("shut", (F.col("kind") == "]") & (F.lag("kind").over(w) == "["))
    mark = F.when(F.col("z").isNotNull(), F.col("i")).when(F.col("shut"), -1)
    held = F.coalesce(F.last(mark, ignorenulls=True).over(W.partitionBy("path", "level", "group").orderBy("i")), F.lit(-1))
    items = items.withColumn("held", F.when(signs, -1).otherwise(held)).filter("NOT coalesce(shut, false)")
    items = items.withColumn("kind", F.when(F.col("z").isNotNull(), "o").when(signs, "t").otherwise(F.col("kind")))
    argument = F.col("kind").isin("g", "o")
    anchor = F.when(~argument, F.struct(F.when(F.col("kind") == "m", F.col("i")).alias("i")))
    items = items.withColumn("mine", F.last(anchor, ignorenulls=True).over(W.partitionBy("path", "level", "group", "held").orderBy("i"))["i"])
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    found = items.filter("mine IS NOT NULL AND kind <> 't'").groupBy("path", "chunk", "mine").agg(
        F.max(of("m", F.struct("at", "part"))).alias("m"), F.array_sort(F.collect_list(of("o", F.struct(F.col("at").alias("a"), "z")))).alias("o"),
        F.array_sort(F.collect_list(of("g", F.struct(F.col("at").alias("a"), F.col("close").alias("z"))))).alias("r"),
        F.max(F.coalesce(F.col("close"), F.col("z"))).alias("end"))
    macros = found.groupBy("path", "chunk").agg(F.collect_list(F.struct("m", "o", "r", "end")).alias("macros"))
    texts = rows.groupBy("path", "chunk").agg(F.min("at").alias("from"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"))
    cut = lambda a, z: F.substring("text", (a - F.col("from") + 1).cast("int"), (z - a).cast("int"))
    full = F.transform("macros", lambda x: F.struct(
        x["m"]["at"].alias("place"), F.substring(x["m"]["part"], F.lit(2), F.length(x["m"]["part"])).alias("name"), x["end"].alias("end"),
        F.transform(x["o"], lambda r: cut(r["a"], r["z"] + 1)).alias("opts"), F.transform(x["r"], lambda r: cut(r["a"] + 1, r["z"])).alias("rargs")))
    out = texts.join(macros, ["path", "chunk"]).select("path", F.explode(full).alias("x")).select("path", "x.*")
    w, size = W.partitionBy("path").orderBy("place"), F.length("name") + 1
    lead = (F.col("place") - F.lag(F.col("place") + size, 1, 0).over(w)).cast("int")
    span = F.coalesce(F.col("end") + 1 - F.col("place"), size).cast("int")
    return out.select("path", (F.row_number().over(w) - 1).cast("long").alias("pos"), "name", _options(F.col("opts")).alias("oarg"), _braced(F.col("rargs")).alias("rarg"), "rargs", lead.alias("lead"), span.alias("span"))


def with_offsets(m: DataFrame) -> DataFrame:
    """``macros`` plus ``place``, the 0-based offset of each backslash in its text."""
    size = F.col("lead") + F.length("name") + 1
    ends = F.sum(size).over(W.partitionBy("path").orderBy("pos"))
    return m.withColumn("place", ends - F.length("name") - 1)


def split_options(text: Column) -> Column:
    """Pieces between commas, those that braces protect left alone at any depth; empty ones are dropped."""
    count = lambda p, c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def step(acc, p):
        own = F.when(acc["depth"] > 0, F.concat(acc["open"], F.lit(","), p)).otherwise(p)
        depth = F.greatest(acc["depth"] + count(p, "{") - count(p, "}"), F.lit(0))
        return F.struct(F.when(depth > 0, acc["done"]).otherwise(F.array_append(acc["done"], own)).alias("done"), F.when(depth > 0, own).otherwise(F.lit("")).alias("open"), depth.alias("depth"))

    pieces = F.split(text, ",")
    guarded = F.aggregate(pieces, start, step, lambda acc: F.when(acc["depth"] > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.filter(F.when(text.contains("{"), guarded).otherwise(pieces), lambda p: p != "")


def arguments(m: DataFrame) -> DataFrame:
    """``macros`` plus ``parts``, the optional arguments; braces protect what is inside them."""
    inner = F.substring("oarg", F.lit(2), F.length("oarg") - 2)
    return m.select("*", split_options(inner).alias("parts"))


def named(parts: Column, key: str) -> Column:
    """Value of ``key=`` among optional arguments, or null."""
    hit = F.get(F.filter(parts, lambda x: x.startswith(key + "=")), F.lit(0))
    return F.substring(hit, F.lit(len(key) + 2), F.length(hit))


def unnamed(parts: Column) -> Column:
    return F.filter(parts, lambda x: ~x.contains("="))


def noverb_languages(parts: Column) -> Column:
    """Languages of ``noverb=de`` or ``noverb={de,en}``, in order; none without."""
    return F.array_sort(F.coalesce(F.split(F.regexp_replace(named(parts, "noverb"), r"^\{|\}$", ""), ","), F.expr("cast(array() as array<string>)")))


def regions(args: DataFrame, envs: DataFrame) -> DataFrame:
    """Environments that name modules: ``(path, begin_pos, end_pos, env, depth, kind, module, lang, access, source, target, structure)``.

    ``kind`` is module, binding, view or structure; a view over a signature is a module as well. A module without a name is private
    and goes by ``path#pos``.
    """
    own = args.filter("name = 'begin'").select("path", F.col("pos").alias("begin_pos"), "rargs", "parts")
    e = envs.select("path", "begin_pos", F.coalesce("end_pos", F.lit(END)).alias("end_pos"), "env", "depth")
    kind = F.when(F.col("env").isin(*MODULE_ENVS), "module").when(F.col("env").isin(*BINDING_ENVS), "binding").when(F.col("env").isin(*VIEW_ENVS), "view").when(F.col("env").isin(*STRUCTURE_ENVS), "structure")
    r = own.join(e.hint("merge"), ["path", "begin_pos"]).withColumn("kind", kind).filter("kind IS NOT NULL")
    arg = lambda i: F.get("rargs", F.lit(i))
    nameless = F.concat("path", F.lit("#"), F.col("begin_pos").cast("string"))
    module = F.when(F.col("env").isin("module", "module*", "smentry"), F.coalesce(named(F.col("parts"), "id"), nameless)).when(F.col("kind").isin("module", "binding"), arg(1))
    view = F.col("env").isin(*VIEW_ENVS)
    from_end = lambda i: F.when(view, F.try_element_at("rargs", F.lit(i)))
    return r.select(
        "path", "begin_pos", "end_pos", "env", "depth", "kind", module.alias("module"), F.when(F.col("kind") == "binding", arg(2)).alias("lang"),
        F.when(F.col("env").isin("module", "module*", "smentry") & named(F.col("parts"), "id").isNull(), PRIVATE).otherwise(0).alias("access"),
        F.when(F.col("env") == "gviewsig", arg(2)).otherwise(from_end(-2)).alias("source"), F.when(F.col("env") == "gviewsig", arg(3)).otherwise(from_end(-1)).alias("target"),
        F.when(F.col("kind") == "structure", arg(2)).alias("structure"),
    )


def modules(found: DataFrame) -> DataFrame:
    """Of ``regions``: ``(path, pos, module, module_type, access)``."""
    return found.filter("kind = 'module'").select("path", F.col("begin_pos").alias("pos"), "module", F.col("env").alias("module_type"), "access")


def bindings(found: DataFrame) -> DataFrame:
    """Of ``regions``: ``(path, pos, module, lang)``; a binding depends on its signature, see ``dependencies``."""
    return found.filter("kind = 'binding'").select("path", F.col("begin_pos").alias("pos"), "module", "lang")


def placed(args: DataFrame, found: DataFrame) -> DataFrame:
    """``args`` plus the nearest region around each: ``around`` (its kind), ``env``, ``module``, ``lang``, ``source``, ``target``, null outside all."""
    r = found.select("path", "begin_pos", "end_pos", F.col("kind").alias("around"), "env", "module", "lang", "source", "target")
    near = nesting.nearest(args, r)
    return near.select(*args.columns, "near.around", "near.env", "near.module", "near.lang", "near.source", "near.target")


def symbol_name(name: Column, rargs: Column, parts: Column) -> Column:
    """``name=`` wins; symbol definitions take their first argument; else the arguments joined, without the shown form of an ``a`` variant."""
    shown = name.rlike("^m?am?([dDtT]ref|[dD]ef)")
    joined = F.array_join(F.when(shown, F.slice(rargs, F.lit(2), F.greatest(F.size(rargs), F.lit(1)))).otherwise(rargs), "-")
    return F.coalesce(named(parts, "name"), F.when(name.rlike(r"^(sym|var)def\*?$"), F.get(rargs, F.lit(0))).otherwise(joined))


def symbols(own: DataFrame) -> DataFrame:
    """Of ``placed``: ``(path, module, module_type, pos, name, def_type, noverb, noverbs)``: symbol macros in a module, and there definitions and ``drefi``."""
    n = F.col("name")
    kind = F.when(n.rlike(SYM), "sym").when(n.rlike(SYMBOL), "symdef").when(n.rlike(DEFINITION), "def").when(n.rlike("^[ma]*[dD]ref"), "dref")
    inside = own.filter((F.col("around") == "module") & (n.rlike(SYMBOL) | n.rlike(DEFINITION) | n.rlike(r"^[ma]*[dD]ref[ivx]+s?\*?$")))
    return inside.select("path", "module", F.col("env").alias("module_type"), "pos", symbol_name(n, F.col("rargs"), F.col("parts")).alias("name"), kind.alias("def_type"), F.array_contains("parts", "noverb").alias("noverb"), noverb_languages(F.col("parts")).alias("noverbs"))


def references(own: DataFrame) -> DataFrame:
    """Of ``placed``: ``(path, pos, nth, macro, target, module, symbol, scope)``, ``nth`` of the references at one place: ``module?symbol`` split, the rest from the arguments.

    ``trefi`` and ``drefi``; definitions outside modules, which mean the binding's module; assignments in views, with the view's
    source or target as the module. ``scope`` is the module or binding around, which ``module`` means where it is null.
    """
    n = F.col("name")
    t = own.filter(n.rlike(REFERENCE)).withColumn("target", F.coalesce(F.get(unnamed(F.col("parts")), F.lit(0)), F.lit("")))
    both = F.col("target").contains("?")
    module = F.when(both, F.nullif(F.substring_index("target", "?", 1), F.lit(""))).otherwise(F.nullif("target", F.lit("")))
    given = F.when(both, F.nullif(F.substring_index("target", "?", -1), F.lit("")))
    refs = t.select("path", "pos", n.alias("macro"), "target", module.alias("m"), F.coalesce(given, symbol_name(n, F.col("rargs"), F.col("parts"))).alias("symbol"), F.col("module").alias("scope"))
    none = F.lit("")
    d = own.filter(n.rlike(DEFINITION) & (F.col("around") == "binding"))
    defs = d.select("path", "pos", n.alias("macro"), none.alias("target"), F.col("module").alias("m"), symbol_name(n, F.col("rargs"), F.col("parts")).alias("symbol"), F.col("module").alias("scope"))
    a = own.filter(n.rlike(ASSIGNMENT) & F.col("source").isNotNull()).withColumn("first", F.get("rargs", F.lit(0)))
    split = F.col("first").contains("?")
    sources = a.select("path", "pos", n.alias("macro"), F.col("first").alias("target"), F.when(split, F.substring_index("first", "?", 1)).otherwise(F.col("source")).alias("m"), F.when(split, F.substring_index("first", "?", -1)).otherwise(F.col("first")).alias("symbol"), F.col("module").alias("scope"))
    targets = a.filter(n.startswith("v")).select("path", "pos", n.alias("macro"), none.alias("target"), F.col("target").alias("m"), F.get("rargs", F.lit(1)).alias("symbol"), F.col("module").alias("scope"))
    first = refs.union(defs).union(sources).withColumn("nth", F.lit(0))
    return first.union(targets.withColumn("nth", F.lit(1))).withColumnRenamed("m", "module").select("path", "pos", "nth", "macro", "target", "module", "symbol", "scope")


def import_hint(path: Column, name: Column, module: Column, parts: Column, root: str = "/hub") -> Column:
    """File that an import means. ``load``: below the root; ``mhrepos`` and ``dir`` or ``path``: in that repository's sources, or the
    file's own; an import with none of them: the same file; ``gimport``: the repository's sources, or the same folder."""
    repo = F.coalesce(named(parts, "mhrepos"), named(parts, "repos"))
    source = F.when(repo.isNotNull(), F.concat(F.lit(f"{root}/"), repo, F.lit("/source"))).otherwise(F.regexp_extract(path, r"^(.*/source)/", 1))
    load, folder, file = named(parts, "load"), named(parts, "dir"), named(parts, "path")
    plain = (
        F.when(load.isNotNull(), F.concat(F.lit(f"{root}/"), load, F.lit("/"), module, F.lit(".tex"))).when(folder.isNotNull(), F.concat(source, F.lit("/"), folder, F.lit("/"), module, F.lit(".tex")))
        .when(file.isNotNull(), F.concat(source, F.lit("/"), file, F.lit(".tex"))).when(repo.isNull(), path)
    )
    given = F.get(unnamed(parts), F.lit(0))
    beside = F.when(given.isNotNull(), F.concat(F.lit(f"{root}/"), given, F.lit("/source"))).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    return F.when(name.rlike(GIMPORTS), F.concat(beside, F.lit("/"), module, F.lit(".tex"))).otherwise(plain)


def import_error(name: Column, parts: Column) -> Column:
    """Why an import's arguments can't stand together, or null."""
    has = lambda k: named(parts, k).isNotNull()
    repo = has("mhrepos") | has("repos")
    mh = (
        F.when(has("dir") & has("path"), "dir and path").when(repo & ~(has("dir") | has("path")), "mhrepos without dir or path").when(has("load"), "load not allowed")
    )
    plain = F.when(repo | has("dir") | has("path"), "mhrepos, dir or path not allowed").when(~has("load"), "load missing")
    return F.when(name.rlike(r"^(import|use)mhmodule\*?$"), mh).when(name.rlike(r"^(import|use)module\*?$"), plain)


def dependencies(own: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, pos, module, macro, export, quiet, hint)``: imports, a binding's signature, a structure's
    module, a view's source and target. Quiet ones are implied and never reported as redundant."""
    n, arg = F.col("name"), F.get("rargs", F.lit(0))
    imports = own.filter(n.rlike(IMPORTS)).select("path", "pos", arg.alias("module"), n.alias("macro"), n.contains("import").alias("export"), F.lit(False).alias("quiet"), import_hint(F.col("path"), n, arg, F.col("parts")).alias("hint"))
    beside = lambda m: F.concat(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("/"), m, F.lit(".tex"))
    implied = lambda kind, m: found.filter(kind & m.isNotNull()).select("path", F.col("begin_pos").alias("pos"), m.alias("module"), F.col("env").alias("macro"), F.lit(True).alias("export"), F.lit(True).alias("quiet"), beside(m).alias("hint"))
    view = F.col("env").isin(*VIEW_ENVS)
    return (
        imports.union(implied(F.col("kind") == "binding", F.col("module"))).union(implied(F.col("kind") == "structure", F.col("structure")))
        .union(implied(view, F.col("source"))).union(implied(view, F.col("target")))
    )


def arity(name: Column) -> Column:
    """Arguments that a macro's roman suffix asks for, one more with the ``a`` variant; null without a suffix."""
    suffix = F.regexp_extract(name, r"(?:sym|def|tref|dref|Def|Tref|Dref)([ivx]+)s?\*?$", 1)
    table = F.create_map(*(F.lit(v) for i, r in enumerate(ROMAN, 1) for v in (r, i)))
    return F.when(suffix != "", F.element_at(table, suffix) + F.when(name.rlike("^m?am?[dDtT]"), 1).otherwise(0))


def kinds(args: DataFrame) -> DataFrame:
    """``(path, pos, name, kind, n_args, wanted, arity_error)``."""
    n = F.col("name")
    kind = (
        F.when(n.isin("begin", "end"), "environment").when(n.rlike(IMPORTS), "import").when(n.rlike(SYMBOL), "symbol")
        .when(n.rlike(REFERENCE), "reference").when(n.rlike(DEFINITION), "definition").when(n.rlike(ASSIGNMENT), "assignment").otherwise("other")
    )
    got, want = F.size("rargs"), arity(n)
    return args.select("path", "pos", "name", kind.alias("kind"), got.alias("n_args"), want.alias("wanted"), F.coalesce(got != want, F.lit(False)).alias("arity_error"))


def displayed(name: Column, rargs: Column) -> Column:
    """What a reference or definition shows: its own text for an ``a`` variant, else its arguments; capital for ``D`` and ``T``; ``s`` at the end for plurals."""
    own = F.when(name.rlike("^m?am?[dDtT]"), F.get(rargs, F.lit(0))).otherwise(F.array_join(rargs, " "))
    own = F.when(name.rlike("^[ma]*[DT]"), F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, F.lit(2), F.length(own)))).otherwise(own)
    return F.when(name.rlike(r"[ivx]s\*?$"), F.concat(own, F.lit("s"))).otherwise(own)
