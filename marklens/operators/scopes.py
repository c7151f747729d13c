"""Scopes of files as trees, what imports bring into them, and the outward lookup of identifier paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.sources.shared import Grown, checkpoint

from . import graph, markup, nesting

# fixed values: bits of what a name may stand for
SYMBOL, DEFINITION, MODULE, BINDING = 1, 2, 4, 8
COPY = ">"  # marks the copy of a module that an import brings: its public symbols only


def scope_id(path: Column, begin: Column) -> Column:
    """A scope by its file and where it begins; a file's own scope goes by the path."""
    return F.coalesce(F.concat(path, F.lit("#"), begin.cast("string")), path)


def scopes(regions: DataFrame, envs: DataFrame) -> DataFrame:
    """``(path, begin_pos, end_pos, scope, parent, kind, name, access)``: modules, bindings, views, structures and text scopes, each with
    the scope around it; the outermost ones' parent is their file."""
    r = regions.select("path", "begin_pos", "end_pos", "kind", F.col("module").alias("name"), "access")
    e = envs.filter(F.col("env").isin(*markup.SCOPE_ENVS)).select("path", "begin_pos", "end_pos", F.lit("scope"), "env", F.lit(0))
    out = nesting.with_parents(r.union(e))
    return out.select("path", "begin_pos", "end_pos", scope_id(F.col("path"), F.col("begin_pos")).alias("scope"), scope_id(F.col("path"), F.col("parent")).alias("parent"), "kind", "name", "access")


def in_scope(points: DataFrame, found: DataFrame) -> DataFrame:
    """``points(path, pos, ...)`` plus ``scope``, the innermost of ``scopes`` around each, or the file."""
    near = nesting.nearest(points, found.select("path", "begin_pos", "end_pos"))
    return near.select(*points.columns, scope_id(F.col("path"), F.col("near.begin_pos")).alias("scope"))


def children(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(parent, name, node, type)``: the named scopes and the ``symbols(path, pos, name, type)`` that each scope holds. A
    symbol belongs to the innermost module around it, whatever text scopes lie between."""
    kind = F.when(F.col("kind") == "module", MODULE).when(F.col("kind") == "binding", BINDING)
    named = found.filter("kind IN ('module', 'binding') AND name IS NOT NULL").select("parent", "name", F.col("scope").alias("node"), kind.alias("type"))
    own = in_scope(symbols.select("path", "pos", "name", "type"), found.filter("kind = 'module'"))
    return named.union(own.select(F.col("scope").alias("parent"), "name", scope_id(F.col("path"), F.col("pos")).alias("node"), "type"))


def outward(found: DataFrame) -> DataFrame:
    """``(scope, bound, distance, inside, top)``: each scope, and each file, with itself and all that lies around it, out to the file.

    ``top`` is the nearest module or binding, itself included, beyond which names can't be reached through; scopes up to it are ``inside``. Where there is
    none, ``top`` is the file and all are inside. One join a level of nesting, over scopes, not references.
    """
    tree = checkpoint(found.select(F.col("scope").alias("bound"), F.col("parent").alias("up"), F.col("kind").isin("module", "binding").alias("wall")))
    own = found.select("scope").union(found.select("path")).distinct()
    now = own.select("scope", F.col("scope").alias("bound"), F.lit(0).alias("distance"), F.lit(True).alias("inside"))
    parts = []
    while True:
        now = checkpoint(now.join(tree, "bound", "left"))
        parts.append(now)
        now = now.filter("up IS NOT NULL").select("scope", F.col("up").alias("bound"), (F.col("distance") + 1).alias("distance"), (F.col("inside") & ~F.col("wall")).alias("inside"))
        if now.isEmpty():
            break
    out = reduce(DataFrame.union, parts)
    top = out.filter("inside").groupBy("scope").agg(F.max_by("bound", "distance").alias("top"))
    return checkpoint(out.select("scope", "bound", "distance", "inside").join(top, "scope"))


def imports(deps: DataFrame, found: DataFrame, around: DataFrame) -> DataFrame:
    """``(path, pos, scope, node, module, export, n_modules)``: the public modules that imports and implied dependencies bring into their scope.

    The file that an import hints at decides, not the name alone. Where that file is the import's own and has no such module at its
    root, the scopes around the import are searched outward. Several modules of the name bring nothing.
    """
    d = in_scope(deps.filter("NOT quiet"), found).union(deps.filter("quiet").withColumn("scope", scope_id(F.col("path"), F.col("pos"))))
    m = found.filter("kind = 'module' AND name IS NOT NULL").select(F.col("path").alias("m_path"), F.col("name").alias("module"), F.col("parent").alias("m_parent"), F.col("scope").alias("node"), "access")
    root = m.filter("m_parent = m_path").drop("m_parent").withColumnRenamed("m_path", "hint")
    count = root.groupBy("hint", "module").agg(F.count("*").alias("n_modules"), F.min("node").alias("node"), F.max("access").alias("access"))
    hit = checkpoint(d.join(count, ["hint", "module"], "left"))
    keys = ["path", "pos", "scope", "module", "export"]
    direct = hit.filter("n_modules = 1 AND access = 0").select(*keys, "node", "n_modules")
    missed = hit.filter("n_modules IS NULL AND hint = path").select(*keys)
    beside = m.filter("access = 0").select(F.col("m_parent").alias("bound"), "module", "node")
    fallback = missed.join(around.select("scope", "bound"), "scope").join(beside, ["bound", "module"]).select(*keys, "node", F.lit(1).cast("long").alias("n_modules"))
    return direct.union(fallback).select("path", "pos", "scope", "node", "module", "export", "n_modules")


def brought(found: DataFrame, imported: DataFrame, around: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(scope, node, below)``: modules that each scope gets: those that it imports, and what these import in turn and export.

    The state of the walk is the module and whether it is ``below`` a use-import, which the first step decides, as later ones follow
    exported imports only. Below one, the module that the scope lies in isn't imported again, nor anything through it. Each round joins
    the newest states with the edges and drops what is known. ``roots(scope)`` narrows where walks begin.
    """
    names = found.filter("kind = 'module'").select(F.col("scope").alias("node"), "name")
    first = imported if roots is None else imported.join(roots.select("scope").distinct(), "scope", "left_semi")
    home = around.filter("bound = top").select("scope", F.col("bound").alias("node")).join(found.select(F.col("scope").alias("node"), F.col("name").alias("home")), "node").select("scope", "home")
    edges = checkpoint(imported.filter("export").select(F.col("scope").alias("node"), F.col("node").alias("next")).distinct())
    start = first.select("scope", "node", (~F.col("export")).alias("below")).distinct().join(home, "scope", "left")
    new = checkpoint(start)
    known, rounds = new, 0
    while not new.isEmpty():
        step = new.join(edges, "node").select("scope", F.col("next").alias("node"), "below", "home").distinct()
        step = step.join(names, "node").filter(~(F.col("below") & F.coalesce(F.col("name") == F.col("home"), F.lit(False)))).drop("name")
        new = checkpoint(step.select("scope", "node", "below", "home").join(known, ["scope", "node", "below"], "left_anti"))
        known, rounds = known.union(new), rounds + 1
        if rounds % 8 == 0:
            known = checkpoint(known)
    return known.select("scope", "node", "below")


def asked(refs: DataFrame, around: DataFrame, found: DataFrame) -> DataFrame:
    """``(scope, name)``: the names that ``lookup`` of ``refs`` asks of scopes. What imports bring holds no scopes, so scopes further on come from the trees alone."""
    own = found.filter("kind IN ('module', 'binding') AND name IS NOT NULL").select("parent", "name", F.col("scope").alias("node"))
    longest = refs.agg(F.max(F.size("ids"))).first()[0] or 0  # one row
    now = refs.join(around, "scope").select(F.col("bound").alias("scope"), "ids").distinct()
    parts = [refs.select("scope", F.lit("").alias("name")).limit(0)]
    for k in range(longest):
        now = checkpoint(now.filter(F.size("ids") > k).withColumn("name", F.get("ids", F.lit(k))))
        parts.append(now.select("scope", "name"))
        now = now.withColumnRenamed("scope", "parent").join(own, ["parent", "name"]).select(F.col("node").alias("scope"), "ids").distinct()
    return reduce(DataFrame.union, parts).filter("name IS NOT NULL").distinct()


def brought_by_name(found: DataFrame, imported: DataFrame, around: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(scope, node)``: of what ``brought`` gives, the modules of the names that are ``wanted(scope, name)`` of a scope.

    A module that the scope imports itself needs no walk. For other names, walks begin at imported modules rather than at scopes, once
    for all scopes that import one, and only where a name that isn't settled is some exported import's. Below a use-import the walk
    goes by the module and the name that it mustn't meet, if any import could bring that. Modules and names go by number; known rows stay where they are.
    """
    n = lambda df, nodes=(), names=(): reduce(lambda d, c: graph.numbered(d, c, ids), nodes, reduce(lambda d, c: graph.numbered(d, c, words), names, df))
    modules = found.filter("kind = 'module' AND name IS NOT NULL").select(F.col("scope").alias("node"), "name")
    got = imported.select("scope", "node", "export").distinct().join(modules, "node")
    ids, words = graph.numbers(got.select(F.col("node").alias("name"))), graph.numbers(got.select("name"))
    got = checkpoint(n(got, ("node",), ("name",)))
    want = checkpoint(n(wanted.join(got.select("scope").distinct(), "scope", "left_semi"), (), ("name",)).filter("name > 0"))
    direct = checkpoint(want.join(got.select("scope", "name", "node").distinct(), ["scope", "name"]))
    edges = got.filter("export").select("scope", F.col("node").alias("next"), "name").distinct()
    edges = checkpoint(edges.join(ids.select(F.col("name").alias("scope"), F.col("id").alias("node")), "scope").select("node", "next", "name"))
    single = got.select("name", "node").distinct().groupBy("name").agg(F.count("*").alias("n")).filter("n = 1").select("name")
    onward = checkpoint(edges.select("name").distinct())
    left = want.join(onward, "name", "left_semi").join(direct.join(single, "name", "left_semi").select("scope", "name"), ["scope", "name"], "left_anti")
    home = around.filter("bound = top").select("scope", F.col("bound").alias("node")).join(found.select(F.col("scope").alias("node"), "name"), "node").select("scope", "name")
    home = n(home, (), ("name",)).join(onward, "name").select("scope", F.col("name").alias("home"))
    first = got.withColumnRenamed("name", "first").join(home, "scope", "left").withColumn("shun", F.when(~F.col("export"), F.col("home"))).fillna(0, ["shun"])
    asks = checkpoint(left.join(first, "scope").select("scope", "name", F.col("node").alias("start"), "shun", "first"))
    known = Grown(found.sparkSession, "start", "shun", "node")
    known.add(asks.select("start", "shun", F.col("start").alias("node"), F.col("first").alias("name")).distinct())
    while not (new := known.latest()).isEmpty():
        step = new.drop("name").join(edges, "node").filter("name <> shun").select("start", "shun", F.col("next").alias("node"), "name")
        step = step.groupBy("start", "shun", "node").agg(F.first("name").alias("name"))
        known.add(step.join(known.all(), ["start", "shun", "node"], "left_anti").select("start", "shun", "node", "name"))
    hits = asks.join(known.all(), ["start", "shun", "name"]).select("scope", "node").union(direct.select("scope", "node")).distinct()
    return hits.join(ids.select(F.col("id").alias("node"), F.col("name").alias("__node")), "node").select("scope", F.col("__node").alias("node"))


def visible(found: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """``children`` with what imports bring: a copy of each module that a scope gets, and the copy's public symbols."""
    own = children(found, symbols)
    got = reached.select("scope", "node").distinct()
    names = found.filter("kind = 'module' AND access = 0").select(F.col("scope").alias("node"), "name")
    copies = got.join(names, "node").select(F.col("scope").alias("parent"), "name", F.concat(F.lit(COPY), "node").alias("node"), F.lit(MODULE).alias("type"))
    inside = own.filter(F.col("type").isin(SYMBOL, DEFINITION)).join(got.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
    return own.union(copies).union(inside.select(F.concat(F.lit(COPY), "parent").alias("parent"), "name", "node", "type")).distinct()


def lookup(refs: DataFrame, around: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look identifier paths up: ``refs(path, ref, scope, ids, mask)`` against ``seen``, the ``visible`` children.

    Gives ``(path, ref, node, distance)``, every symbol that the path names from the scope itself or from one around it, if its type is in
    the mask and it lies inside the nearest module or binding; and ``(path, ref, depth)``, how many leading identifiers resolved at most.
    A path that starts further out counts only if it leads through that module or binding. One join per identifier. Paths without
    identifiers find nothing, a null identifier matches no name.
    """
    longest = refs.agg(F.max(F.size("ids"))).first()[0] or 0  # one row
    r = refs.select("path", "ref", "scope", "ids", "mask")
    now = r.join(around, "scope").select("path", "ref", "ids", "mask", F.col("bound").alias("node"), "distance", F.col("inside").alias("entered"), "top")
    edge = seen.select(F.col("parent").alias("node"), "name", F.col("node").alias("next"), "type")
    hits, depths = [], [r.select("path", "ref", F.lit(0).alias("depth"))]
    for k in range(1, longest + 1):
        step = now.filter(F.size("ids") >= k).withColumn("name", F.get("ids", F.lit(k - 1))).join(edge, ["node", "name"])
        now = checkpoint(step.select("path", "ref", "ids", "mask", F.col("next").alias("node"), "distance", (F.col("entered") | (F.col("next") == F.col("top"))).alias("entered"), "top", "type"))
        depths.append(now.select("path", "ref", F.lit(k).alias("depth")))
        hits.append(now.filter((F.size("ids") == k) & F.col("entered") & (F.col("mask").bitwiseAND(F.col("type")) == F.col("type"))).select("path", "ref", "node", "distance"))
        now = now.drop("type")
    none = r.select("path", "ref", F.col("scope").alias("node"), F.lit(0).alias("distance")).limit(0)
    nodes, depth = reduce(DataFrame.union, hits, none), reduce(DataFrame.union, depths)
    return nodes.groupBy("path", "ref", "node").agg(F.min("distance").alias("distance")), depth.groupBy("path", "ref").agg(F.max("depth").alias("depth"))


def resolve(placed: DataFrame, regions: DataFrame, envs: DataFrame, deps: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lookup`` of all ``identifier_paths`` of a corpus; ``symbols(path, pos, name, type)``."""
    found = checkpoint(scopes(regions, envs))
    around = outward(found)
    imported = checkpoint(imports(deps, found, around))
    refs = checkpoint(in_scope(identifier_paths(placed), found))
    got = checkpoint(brought_by_name(found, imported, around, checkpoint(asked(refs, around, found))))
    seen = checkpoint(visible(found, symbols, got))
    return lookup(refs, around, seen)


def identifier_paths(own: DataFrame) -> DataFrame:
    """Of ``placed``: ``(path, ref, pos, ids, mask)``: every name that must resolve, as the identifiers of its path.

    References: the parts of ``module?symbol``, or the module around and the arguments. Imports: the module's name.
    """
    n = F.col("name")
    given = F.coalesce(F.get(markup.unnamed(F.col("parts")), F.lit(0)), F.lit(""))
    symbol = markup.symbol_name(n, F.col("rargs"), F.col("parts"))
    pieces = F.filter(F.split(given, r"\?"), lambda x: x != "")
    ids = F.when(given.contains("?") & ~given.endswith("?"), F.when(given.startswith("?"), F.array("module", pieces[0])).otherwise(pieces)).when(given != "", F.array_append(pieces, symbol)).otherwise(F.array("module", symbol))
    refs = own.filter(n.rlike(markup.REFERENCE)).select("path", F.col("pos").alias("ref"), "pos", ids.alias("ids"), F.when(n.startswith("a"), SYMBOL | DEFINITION).otherwise(SYMBOL).alias("mask"))
    imported = own.filter(n.rlike(markup.IMPORTS)).select("path", "pos", "pos", F.array(F.get("rargs", F.lit(0))), F.lit(MODULE))
    return refs.union(imported)
