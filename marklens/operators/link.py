"""Linking: resolve references over the import graph with joins, anti-joins, closures and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.functions import matching
from marklens.sources.shared import checkpoint

from . import graph, markup, nesting

FILES_OF_A_BLOCK = 512
NAMES_OF_A_BLOCK = 20_000  # of all lengths, that a symbol meets in one group of a join


def contained(symbol_type: Column, mask: Column) -> Column:
    return mask.bitwiseAND(symbol_type) == symbol_type


def overlaps(symbol_type: Column, mask: Column) -> Column:
    return mask.bitwiseAND(symbol_type) != 0


def _repeatable(symbols: DataFrame) -> Column:
    """Kinds that may stand again: symbol definitions, ``drefi``, and definitions in plain modules."""
    return F.col("def_type").isin("symdef", "dref") | ((F.col("def_type") == "def") & F.col("module_type").isin("module", "module*", "smentry"))


def duplicate_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that may not repeat whose module already has one of that name and kind, with the first one's place."""
    own = W.partitionBy("path", "module", "name", "def_type").orderBy("pos")
    out = symbols.select("*", F.row_number().over(own).alias("nth"), F.first("pos").over(own).alias("first_pos"))
    return out.filter((F.col("nth") > 1) & ~_repeatable(out))


def invalid_redefinitions(symbols: DataFrame) -> DataFrame:
    """Symbols that may repeat, but with the kind, noverb flag and languages of the first of their name; these differ."""
    own = W.partitionBy("path", "module", "name").orderBy("pos")
    sig = F.struct("def_type", "noverb", "noverbs")
    out = symbols.select("*", F.first("pos").over(own).alias("first_pos"), (F.first(sig).over(own) != sig).alias("differs"))
    return out.filter(F.col("differs") & _repeatable(out))


def redundant_imports(deps: DataFrame, envs: DataFrame) -> DataFrame:
    """Imports of a module that the same or an enclosing scope imports before, with the first such place. Quiet ones aren't reported."""
    scoped = nesting.nearest(deps, envs.select("path", "begin_pos", "end_pos"))
    before = scoped.select("path", "module", F.col("pos").alias("b_pos"), F.coalesce("near.begin_pos", F.lit(-1)).alias("b"), F.coalesce("near.end_pos", F.lit(nesting.END)).alias("f"))
    hit = deps.filter("NOT quiet").join(before, ["path", "module"]).filter("b_pos < pos AND b < pos AND f > pos")
    return hit.groupBy("path", "pos", "module").agg(F.min("b_pos").alias("first_pos"))


def resolve_modules(deps: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """Each import with the number of modules of that name in the file it hints at, and the verdict."""
    known = files.select(F.col("path").alias("hint"), F.lit(True).alias("there")).distinct()
    found = modules.groupBy(F.col("path").alias("hint"), "module").agg(F.count("*").alias("n_modules"), F.max("access").alias("access"))
    out = deps.join(known, "hint", "left").join(found, ["hint", "module"], "left").withColumn("n_modules", F.coalesce("n_modules", F.lit(0)))
    status = (
        F.when(F.col("there").isNull(), "file-not-found").when(F.col("n_modules") == 0, "undefined-module-not-exported").when(F.col("n_modules") > 1, "unique-dependency-name-check")
        .when(F.col("access") == 3, "access-modifier-check").otherwise("ok")
    )
    return out.withColumn("status", status).drop("there", "access")


def undefined_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Qualified references without a symbol of that name in the named module."""
    return refs.filter(F.col("module").isNotNull()).join(symbols.select("module", F.col("name").alias("symbol")).distinct(), ["module", "symbol"], "left_anti")


def gated(refs: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """Undefined references whose module did resolve: others are reported at the module."""
    return undefined_symbols(refs, symbols).join(modules.select("module").distinct(), "module", "left_semi")


def noverb_references(refs: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """References to a symbol marked noverb, for all languages or for that of the file's binding."""
    own = symbols.filter(F.col("noverb") | (F.size("noverbs") > 0)).select("module", F.col("name").alias("symbol"), "noverb", "noverbs")
    lang = bindings.groupBy(F.col("path").alias("b_path")).agg(F.min_by("lang", "pos").alias("lang"))
    hit = refs.join(own, ["module", "symbol"]).join(lang, F.col("path") == F.col("b_path"), "left")
    return hit.filter(F.col("noverb") | F.coalesce(F.array_contains("noverbs", F.col("lang")), F.lit(False))).select(*refs.columns).distinct()


def name_mismatches(modules: DataFrame, bindings: DataFrame) -> DataFrame:
    """``(path, pos, module, stem)``: signatures whose name isn't their file's stem, bindings whose name and language aren't."""
    own = modules.filter(F.col("module_type").isin("modsig", "gviewsig")).select("path", "pos", "module")
    both = own.union(bindings.select("path", "pos", F.concat_ws(".", "module", "lang")))
    return both.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.tex$", 1)).filter(F.col("module") != F.col("stem"))


def current_places(args: DataFrame) -> DataFrame:
    """``(path, pos, what)``: imports that name the repository, folder or file they stand in."""
    parts, name = F.col("parts"), F.col("name")
    repo, source = F.regexp_extract("path", "/([^/]+)/source/", 1), F.regexp_extract("path", r"/source/(.*)\.tex$", 1)
    given = F.when(name.rlike(markup.GIMPORTS), F.get(markup.unnamed(parts), F.lit(0))).otherwise(F.coalesce(markup.named(parts, "mhrepos"), markup.named(parts, "repos")))
    folder = F.regexp_extract(source, "^(.*)/[^/]*$", 1)
    what = F.when(given == repo, "repository").when(markup.named(parts, "dir") == folder, "dir").when(markup.named(parts, "path") == source, "path")
    return args.filter(name.rlike(markup.IMPORTS)).select("path", "pos", what.alias("what")).filter("what IS NOT NULL")


def reached(edges: DataFrame, roots: DataFrame | None = None, rule: str = "export") -> tuple[DataFrame, DataFrame]:
    """What each root reaches, packed: ``(root, word, bits)`` of ``graph.reach``, by the numbers ``(name, id)`` that come with it. ``edges(src, dst[, export])``.

    Direct edges all count; with ``rule='export'`` later hops follow exported edges only. A null end is number 0, and nothing leads on from it.
    """
    edges = checkpoint(edges.distinct())
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    names = graph.numbers(ends if roots is None else ends.union(roots.select("node")))
    first = edges if roots is None else edges.join(roots.select(F.col("node").alias("src")), "src", "left_semi")
    onward = (edges.filter("export") if rule == "export" else edges).filter("src IS NOT NULL").select("src", "dst").distinct()
    ids = lambda df: graph.numbered(graph.numbered(df.select("src", "dst"), "src", names), "dst", names)
    return graph.reach(graph.packed(ids(first).toDF("root", "node")), ids(onward)), names


def closure(edges: DataFrame, roots: DataFrame | None = None, rule: str = "export", pairs: bool = True) -> DataFrame:
    """``(root, node)``: what each root reaches, see ``reached``, a row a pair.

    Without ``pairs`` only what some root reaches counts, with a null root, so rows don't multiply by roots.
    """
    if pairs:
        sets, names = reached(edges, roots, rule)
        nodes = names.select(F.col("id").alias("node"), "name").union(edges.sparkSession.range(1).select(F.lit(0), F.lit(None)))
        own = graph.members(sets, nodes).select("root", F.col("name").alias("node"))
        return own.join(names.withColumnRenamed("name", "__root"), F.col("root") == F.col("id"), "left").select(F.col("__root").alias("root"), "node")
    edges = checkpoint(edges.distinct())  # every round reads them
    first = edges if roots is None else edges.join(roots.select(F.col("node").alias("src")), "src", "left_semi")
    onward = (edges.filter("export") if rule == "export" else edges).select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    new = checkpoint(first.select(F.col("dst").alias("node")).distinct())
    known, rounds = new, 0
    while not new.isEmpty():
        new = checkpoint(new.join(onward, "node").select(F.col("next").alias("node")).distinct().join(known, "node", "left_anti"))
        rounds += 1
        known = known.union(new)  # each part is a checkpoint of its own; a few at a time become one
        if rounds % 8 == 0:
            known = checkpoint(known)
    return known.select(F.lit(None).cast("string").alias("root"), "node")


def reach_ends(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``(root, n, low, high)`` of ``reached``: how many nodes, the first and the last by name."""
    real, base = F.col("word") > 0, F.col("word") * graph.WORD
    out = sets.groupBy("root").agg(F.sum(F.bit_count("bits")).alias("n"), F.min(F.when(real, base + graph.lowest(F.col("bits")))).alias("low"), F.max(F.when(real, base + graph.highest(F.col("bits")))).alias("high"))
    for c in ("root", "low", "high"):
        out = out.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c, "left").drop(c).withColumnRenamed(f"{c}_name", c)
    return out.select("root", "n", "low", "high")


def cyclic(edges: DataFrame) -> DataFrame:
    """``(node, component)``: nodes of ``edges(src, dst)`` that reach themselves, by the strongly connected components they form."""
    return graph.components(edges)


def visible_symbols(sets: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(root, name)`` by numbers: distinct names that a module sees through its imports, less its own. ``sets`` is of
    ``reached``, ``symbols(module, name)`` has numbers for both."""
    seen = graph.members(sets, symbols.filter("module <> 0").select(F.col("module").alias("node"), "name").distinct()).select("root", "name").distinct()
    return seen.join(symbols.select(F.col("module").alias("root"), "name").distinct(), ["root", "name"], "left_anti")


def users(deps: DataFrame, refs: DataFrame, modules: DataFrame) -> DataFrame:
    """``(used, user)``: files with an import of, or a reference into, another file.

    Every pair comes up once, so pairs are neither told apart nor moved. Through a module of one file a pair is made by that. Modules of several
    files go by class: files that use, or hold, the same such modules. Two classes meet once, whatever they share, and their files then in
    blocks; all pairs of them are in the result, whose size can't be less.
    """
    edges, m = checkpoint(uses(deps, refs).withColumnRenamed("path", "user")), checkpoint(modules.select("module", F.col("path").alias("used")).filter("module IS NOT NULL").distinct())
    several = checkpoint(m.groupBy("module").agg(F.count("*").alias("n")).filter("n > 1").select("module"))

    def classed(rows: DataFrame, file: str, to: str) -> tuple[DataFrame, DataFrame]:
        sets = checkpoint(rows.join(several.hint("merge"), "module", "left_semi").groupBy(file).agg(F.array_sort(F.collect_set("module")).alias(to)))
        sizes = checkpoint(sets.groupBy(to).agg(F.ceil(F.count("*") / FILES_OF_A_BLOCK).cast("int").alias(f"{to}_blocks")))
        return sets.join(sizes.hint("merge"), to).withColumn(f"{to}_block", F.pmod(F.xxhash64(file), F.col(f"{to}_blocks")).cast("int")).drop(f"{to}_blocks"), sizes

    (a, of_a), (b, of_b) = classed(edges, "user", "a"), classed(m, "used", "b")
    met = of_a.withColumn("module", F.explode("a")).join(of_b.withColumn("module", F.explode("b")).hint("merge"), "module").drop("module").distinct()
    tasks = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * m.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda df: df.repartition(tasks, "b", "b_block")  # noqa: E731  by number: pairs are many where rows are few
    blocks = met.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    pairs = dealt(blocks.join(a.hint("merge"), ["a", "a_block"]).select("user", "b", "b_block")).join(dealt(b).hint("merge"), ["b", "b_block"]).filter("user <> used").select("used", "user")
    one = edges.join(m.join(several.hint("merge"), "module", "left_anti").hint("merge"), "module").filter("user <> used").select("used", "user").distinct()
    one = one.join(a.select("user", "a").hint("merge"), "user", "left").join(b.select("used", "b").hint("merge"), "used", "left")
    return pairs.union(one.join(met.select("a", "b").hint("merge"), ["a", "b"], "left_anti").select("used", "user"))


def uses(deps: DataFrame, refs: DataFrame) -> DataFrame:
    """``(path, module)``: the modules that a file imports or refers into, each once."""
    return deps.select("path", "module").union(refs.select("path", "module")).filter("module IS NOT NULL").distinct()


def newest_used(deps: DataFrame, refs: DataFrame, modules: DataFrame, builds: DataFrame) -> DataFrame:
    """``(path, newest)``: the latest of the ``builds(path, built_at)`` of other files whose modules a file uses.

    A module's latest build and the latest of any other of its files say that for every user, so users never meet a module's files in pairs.
    """
    built = modules.select("module", "path").join(builds.select("path", "built_at"), "path").filter("module IS NOT NULL AND built_at IS NOT NULL")
    built = built.groupBy("module", "path").agg(F.max("built_at").alias("built_at"))
    first = built.groupBy("module").agg(F.max(F.struct("built_at", "path")).alias("first"))
    second = F.max(F.when(F.col("path") != F.col("first.path"), F.col("built_at")))
    best = built.join(first, "module").groupBy("module").agg(F.first("first").alias("first"), second.alias("second"))
    theirs = F.when(F.col("path") != F.col("first.path"), F.col("first.built_at")).otherwise(F.col("second"))
    return uses(deps, refs).join(best, "module").groupBy("path").agg(F.max(theirs).alias("newest")).filter("newest IS NOT NULL")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """``(name, paths)``: the files that provide each name."""
    return symbols.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def missing_import_hints(undefined: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules that define the name of an unresolved reference, counted: by name first, so that a common name's modules don't meet its references one by one."""
    found = symbols.groupBy(F.col("name").alias("symbol")).agg(F.countDistinct("module").alias("n_modules"), F.min("module").alias("first_module"))
    return undefined.select("path", "pos", "symbol").distinct().join(found, "symbol").select("path", "pos", "symbol", "n_modules", "first_module")


def _signed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """``df`` with the length of ``column`` and four whole numbers of bits: two of its numbered characters, two of its pairs of neighbours."""
    text = F.col(column)
    twos = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    bits = {f"{prefix}{k}{part}": _bits(items, part) for k, items in (("c", matching.numbered_characters(text)), ("t", twos)) for part in (0, 1)}
    return df.select(column, F.length(text).alias("n" if prefix == "a" else "m"), *(x.alias(c) for c, x in bits.items()))


def _bits(items: Column, part: int) -> Column:
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(2 * graph.WORD))
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(graph.word(place(x)) == part, graph.bit(place(x))).otherwise(F.lit(0).cast("long"))))


def _may_be_near() -> Column:
    """An edit takes away at most one character and two pairs of neighbours, so ``k`` edits leave no more bits apart than that. Loses none."""
    apart = lambda x, y, k: sum(F.bit_count(F.col(f"{x}{k}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}{i}")))) for i in (0, 1))
    near = F.lit(True)
    for kind, edits in (("c", F.col("k")), ("t", 2 * F.col("k"))):
        near &= (apart("a", "b", kind) <= edits) & (apart("b", "a", kind) <= edits)
    return near


def _edits() -> Column:
    return F.floor((1 - F.col("least")) * F.greatest("n", "m") + 1e-6).cast("int")


def _within(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Pairs of ``a`` and ``b`` at most ``most`` edits apart: two such share one of any ``most`` + 1 pieces that one of them is cut into, at most
    ``most`` places moved. So candidates come from an equi-join on lengths, number and text of pieces."""
    beside = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - most, F.lit(1)), F.col(c) + most))
    start, end = F.floor(F.col("i") * F.col("m") / (F.col("k") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("m") / (F.col("k") + 1)).cast("int")
    cut = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    b = cut(b.withColumn("n", beside("m")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))))
    b = b.withColumn("piece", F.substring("name", start + 1, end - start))
    a = cut(a.withColumn("m", beside("n")).withColumn("k", F.least(_edits(), F.lit(most))).filter("k >= abs(n - m) AND k > 0"))
    a = a.withColumn("at", F.explode(F.sequence(F.greatest(start - F.col("k"), F.lit(0)), F.greatest(F.least(start + F.col("k"), F.col("n") - (end - start)), F.lit(0)))))
    a = a.withColumn("piece", F.substring("symbol", F.col("at") + 1, end - start)).drop("at").dropDuplicates(["symbol", "m", "i", "piece"])
    # neither side is broadcast: Spark guesses sizes from before the explodes. The distance parts pairs before they are told apart
    return a.join(b.hint("merge"), ["n", "m", "k", "i", "piece"])


def _by_length(a: DataFrame, b: DataFrame, known: int = 0) -> DataFrame:
    """Pairs of ``a`` and ``b`` whose lengths let them be like enough with over ``known`` edits, each once. Names of a length are dealt into blocks, and symbols go to all of them."""
    spark = a.sparkSession
    blocks, tasks = -(-b.count() // NAMES_OF_A_BLOCK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lengths = F.sequence(F.greatest(F.ceil(F.col("least") * F.col("n") - 1e-6), F.lit(1)).cast("int"), F.floor(F.col("n") / F.col("least") + 1e-6).cast("int"))
    a = a.withColumn("m", F.explode(lengths)).withColumn("k", _edits()).filter(F.col("k") > known).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = b.withColumn("block", F.pmod(F.hash("name"), F.lit(blocks)))
    b = b.join(a.select("n", "m").distinct().hint("merge"), "m")
    dealt = lambda df: df.repartition(tasks, "n", "m", "block")  # noqa: E731  by number: pairs are many where rows are few
    return dealt(a).join(dealt(b).hint("merge"), ["n", "m", "block"])


def similar_names(wanted: DataFrame, names: DataFrame, least: float = 0.6, best: int = 3) -> DataFrame:
    """``(symbol, name, ratio)``: up to three names of Levenshtein similarity ``least`` or more.

    All are found. Names one edit away come first, then two. A symbol whose ``best`` are better than any name further away can be is done;
    the others meet all names whose lengths allow more edits and a ratio as good as the last of those they have, very like ones
    first. Before the distance is worked out, bits of characters bound it from below.
    """
    a = checkpoint(_signed(wanted.select("symbol").distinct().filter("symbol <> ''"), "symbol", "a").withColumn("least", F.lit(least)))
    b = checkpoint(_signed(names.select("name").distinct().filter("name <> ''"), "name", "b"))
    own = W.partitionBy("symbol").orderBy(F.desc("ratio"), "name")
    ratio = F.round(1 - F.levenshtein("symbol", "name") / F.greatest("n", "m"), 6)
    # one condition of steps in order: as several, Spark would put the distance first
    near = F.when((F.col("symbol") != F.col("name")) & _may_be_near(), F.when(F.expr("levenshtein(symbol, name, k) >= 0"), ratio >= least))
    done, found = [], None
    for most, like in ((1, 1.0), (2, 1.0), (None, least + (1 - least) / 4), (None, least + (1 - least) / 8)):
        pairs = _within(a, b, most) if most else _by_length(a.withColumn("least", F.greatest("least", F.lit(like - 1e-6))), b, 2)
        found = _best(pairs.filter(near).select("symbol", "name", ratio.alias("ratio")), found, own, best)
        further = F.round(F.col("n") / (F.col("n") + most + 1), 6) if most else F.lit(like - 1e-6)  # what a name not met yet can come to
        last = a.join(found.filter(F.col("nth") == best).select("symbol", F.col("ratio").alias("last")).hint("merge"), "symbol", "left")
        last = last.withColumn("open", (further >= least) & (F.coalesce("last", F.lit(0.0)) <= further))
        last = checkpoint(last.withColumn("least", F.coalesce(F.col("last") - 1e-6, F.col("least"))).drop("last"))  # it is rounded
        done.append(found.join(last.filter("NOT open").select("symbol").hint("merge"), "symbol", "left_semi"))
        found, a = found.join(last.filter("open").select("symbol").hint("merge"), "symbol", "left_semi"), last.filter("open").drop("open")
    done.append(_best(_by_length(a, b, 2).filter(near).select("symbol", "name", ratio.alias("ratio")), found, own, best))
    return reduce(DataFrame.union, done).drop("nth")


def _best(new: DataFrame, found: DataFrame | None, own, best: int) -> DataFrame:
    """The first ``best`` rows of each window ``own``, of new ones and those found before."""
    out = new if found is None else new.union(found.drop("nth"))
    return checkpoint(out.distinct().withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= best))


def ancestors(parents: DataFrame) -> DataFrame:
    """``(node, ancestor, distance)`` of ``parents(node, parent)``, round by round like ``closure``; ends on cycles too."""
    new = checkpoint(parents.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    out, up = new, checkpoint(parents.filter("parent IS NOT NULL").select(F.col("node").alias("ancestor"), "parent"))
    while not new.isEmpty():
        step = new.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        new = checkpoint(step.join(out, ["node", "ancestor"], "left_anti"))
        out = out.union(new)
    return out


def private_access(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports of a module that is private (``access = 3``)."""
    own = modules.filter("access = 3").select("module").distinct()
    return deps.join(own, "module", "left_semi")


def visible_access(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``(node, visible)``: modifiers of a node and all above it, joined by OR. A private one (3) has all bits, so
    what is above it changes nothing and the walk need not stop there."""
    up = ancestors(parents).select("node", F.col("ancestor").alias("at")).union(nodes.select("node", F.col("node").alias("at")))
    return up.join(nodes.select(F.col("node").alias("at"), "access"), "at").groupBy("node").agg(F.bit_or("access").alias("visible"))


def namespaces(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(path, pos, names)``: names of the ``ranges(path, name, begin_pos, end_pos)`` around each point, from the begin on and before the end, outer to inner; only points inside one."""
    near = nesting.nearest(points.select("path", "pos"), ranges.select("path", "begin_pos", "end_pos"), half_open=True)
    chains = nesting.chains(ranges, "name").hint("merge")  # grows with the corpus: never broadcast
    return near.select("path", "pos", F.col("near.begin_pos").alias("begin_pos")).join(chains, ["path", "begin_pos"]).select("path", "pos", "names")


def smallest_reference(points: DataFrame, refs: DataFrame) -> DataFrame:
    """``points`` with the smallest of the ``refs(path, begin_pos, end_pos, nth, module, symbol)`` around each, the end left out. References nest as
    their macros do; of those at one place the first (least ``nth``) wins."""
    own = refs.groupBy("path", "begin_pos", "end_pos").agg(F.min(F.struct("nth", "module", "symbol")).alias("x")).select("path", "begin_pos", "end_pos", "x.module", "x.symbol")
    return nesting.nearest(points.select("path", "pos").distinct(), own, half_open=True).filter("near IS NOT NULL").select("path", "pos", "near.module", "near.symbol")


def definitions_at(points: DataFrame, refs: DataFrame, targets: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(path, pos, d_path, d_pos)``: the ``targets(module, symbol, d_path, d_pos)`` of the smallest reference around a point, and all
    modules and definitions that contain it, the nested ``ranges(path, begin_pos, end_pos)``, by where they begin."""
    # all of these grow with the corpus, far beyond what their compressed files let Spark guess, so none is broadcast
    meant = smallest_reference(points, refs).join(targets.hint("merge"), ["module", "symbol"]).select("path", "pos", "d_path", "d_pos")
    around = namespaces(points.distinct(), ranges.withColumn("name", F.col("begin_pos").cast("string")))
    return meant.union(around.select("path", "pos", F.col("path").alias("d_path"), F.explode(F.col("names").cast("array<bigint>")).alias("d_pos"))).distinct()


def references_to(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """``(module, symbol, path, pos)``: the definitions ``targets(path, pos, module, symbol)`` and all references to them."""
    found = refs.select("module", "symbol", "path", "pos").join(targets.select("module", "symbol").distinct(), ["module", "symbol"])
    return found.select("module", "symbol", "path", "pos").union(targets.select("module", "symbol", "path", "pos")).distinct()


def maintain_index(index: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """``(name, path)`` rows after files changed: theirs go, their new ones come."""
    return index.join(changed.select("path").distinct(), "path", "left_anti").select("name", "path").union(new.select("name", "path")).distinct()


def type_mismatches(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose name exists in the module, but with a type outside their mask."""
    s = symbols.select("module", F.col("name").alias("symbol"), "type").distinct()
    return refs.join(s, ["module", "symbol"]).filter(~contained(F.col("type"), F.col("mask")))
