"""Strongly connected components against a plain version, and cycles with a bridge."""

import random

from pyspark.sql import functions as F

from marklens.operators import checks, graph


def _plain(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a, to in reach.items():
            more = set().union(*(reach.get(b, set()) for b in to)) - to
            if more:
                to |= more
                changed = True
    return {a: min(b for b in to if a in reach.get(b, ())) for a, to in reach.items() if a in to}


def _got(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string") if edges else spark.createDataFrame([], "src string, dst string")
    return {r.node: r.component for r in graph.components(df).collect()}


def test_random_graphs(spark):
    rng, edges = random.Random(4), []
    for g, (n, m) in enumerate([(12, 14), (30, 33), (40, 70), (9, 40), (50, 52)]):  # several graphs at once
        edges += [(f"{g}-{rng.randrange(n):02}", f"{g}-{rng.randrange(n):02}") for _ in range(m)]
    edges += [("x", "x"), ("x", "y"), ("y", "z"), (None, "x"), ("x", None), ("x", "y")]
    assert _got(spark, edges) == _plain([e for e in edges if None not in e])
    assert _got(spark, []) == {}


def test_long_ring_and_chain(spark):
    """A ring and a chain of many nodes: rounds grow with the logarithm, rows with the nodes."""
    n = 80
    edges = [(f"r{i:04}", f"r{(i + 1) % n:04}") for i in range(n)] + [(f"c{i:04}", f"c{i + 1:04}") for i in range(n)] + [("c0005", "r0000")]
    assert _got(spark, edges) == {f"r{i:04}": "r0000" for i in range(n)}


def test_large_component(spark):
    """A component of 10^5 nodes, found without its pairs."""
    n = 100_000
    ids = spark.range(n)
    edges = ids.select("id", ((F.col("id") * 7919 + 13) % n).alias("d")).union(ids.select("id", ((F.col("id") * 31 + 7) % n).alias("d"))).union(ids.select("id", ((F.col("id") + 1) % n).alias("d")))
    got = graph.components(edges.select(F.col("id").alias("src"), F.col("d").alias("dst"))).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]


def test_an_edge_between_cycles_is_on_none(spark):
    modules = spark.createDataFrame([(f"/{m}", m) for m in "ABCDE"], "path string, module string")
    edges = [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("A", "C"), ("E", "A")]
    deps = spark.createDataFrame([(f"/{a}", i, b, False) for i, (a, b) in enumerate(edges)], "path string, pos long, module string, quiet boolean")
    nodes = graph.components(spark.createDataFrame(edges, "src string, dst string"))
    rows = checks.cycle_rows(deps, modules, nodes).collect()
    assert sorted(r.message for r in rows) == [f"on a cycle: {a} > {b}" for a, b in sorted(edges[:4])]
