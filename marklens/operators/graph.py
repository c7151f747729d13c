"""Strongly connected components of large graphs: (node, component) rows, never pairs of nodes. What nodes reach, 64 nodes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.sources.shared import bucketed, checkpoint


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges of nodes that nothing leads to or that lead nowhere: they lie on no cycle."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _links(edges: DataFrame, number: int) -> DataFrame:
    """``(node, before, after)``: nodes with one edge in and one out, no two of them neighbours: of neighbours, the larger hash is taken."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before")).filter("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).filter("n = 1").drop("n")
    c = into.join(out, "node").withColumn("h", F.xxhash64("node", F.lit(number)))
    beside = c.select(F.col("node").alias("other"), F.struct(F.col("h").alias("h"), F.col("node").alias("node")).alias("rank"))
    mine = F.struct(F.col("h").alias("h"), F.col("node").alias("node"))
    rival = c.join(beside, (F.col("before") == F.col("other")), "left").withColumnRenamed("rank", "a").drop("other")
    rival = rival.join(beside, (F.col("after") == F.col("other")), "left").withColumnRenamed("rank", "b").drop("other")
    beats = lambda x: F.col(x).isNull() | (mine > F.col(x))
    return rival.filter(beats("a") & beats("b")).select("node", "before", "after")


def _coloured(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the largest node that leads to each; nodes of one component have one colour."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = checkpoint(nodes.withColumn("colour", F.col("node")))
    moved = colour
    while not moved.isEmpty():
        offer = moved.select(F.col("node").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        new = checkpoint(colour.join(offer, "node", "left").withColumn("better", F.coalesce(F.col("offer") > F.col("colour"), F.lit(False))))
        moved = new.filter("better").select("node", F.col("offer").alias("colour"))
        colour = new.select("node", F.when(F.col("better"), F.col("offer")).otherwise(F.col("colour")).alias("colour"))
    return colour


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: nodes of ``edges(src, dst)`` on a cycle, with the smallest node of their strongly connected component.

    Nodes at open ends go first, chains shrink by links that have one way in and one way out (which later follow their neighbours), and what
    is left is coloured forward; each colour's root is the component of the nodes of its colour that lead to it. Rows are nodes
    and edges at every step, whatever the size of a component. Rounds: about log(length) for chains and rings, the diameter of
    what remains for the rest. Repeated edges count once; an edge with a null end is left out.
    """
    left = checkpoint(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    loops = left.filter("src = dst").select(F.col("src").alias("node"))
    found = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    undo, left, number = [], left.filter("src <> dst"), 0
    n = left.count()
    while n:
        number += 1
        left = checkpoint(_trimmed(left))
        links = checkpoint(_links(left, number))
        undo.append(links)
        gone = links.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        bridged = checkpoint(rest.select("src", "dst").union(links.select("before", "after")).distinct())
        loops = loops.union(bridged.filter("src = dst").select("src"))
        left = bridged.filter("src <> dst")
        before, n = n, left.count()
        if n and n > before * 0.8:  # nothing more to shrink: colour what is left, once
            colour = _coloured(left)
            same = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").filter("colour = c")
            same = checkpoint(same.select("src", "dst", "colour"))
            new = checkpoint(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
            got = new
            while not new.isEmpty():  # back along edges of the colour
                step = same.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("colour").alias("component")).distinct()
                new = checkpoint(step.join(got, "node", "left_anti"))
                got = got.union(new)
            got = checkpoint(got)
            found = found.union(got)
            done = got.select("node")
            left = checkpoint(same.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
            n = left.count()
    loops = checkpoint(loops.distinct())
    found = found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    many = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    found = checkpoint(found.join(many, "component", "left_semi").select("node", "component").union(found.join(loops, "node", "left_semi").select("node", "component")).distinct())
    for links in reversed(undo):
        a = links.join(found.select(F.col("node").alias("before"), F.col("component").alias("c")), "before").join(found.select(F.col("node").alias("after"), F.col("component").alias("d")), "after")
        own = a.filter("c = d").select("node", F.col("c").alias("component"))
        found = checkpoint(found.join(own, "node", "left_anti").select("node", "component").union(own))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


WORD = 64  # nodes that one row of a packed set holds, as the bits of a whole number


def numbers(names: DataFrame) -> DataFrame:
    """``(name, id)`` of the distinct ``names(name)``, in the order of the names, so that near names share a word; 0 to 63 are left to null."""
    own = checkpoint(names.filter("name IS NOT NULL").distinct())
    return checkpoint(own.orderBy("name").select("name", (F.monotonically_increasing_id() + WORD).alias("id")))


def numbered(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``df`` with the number of ``column`` in its place: 0 for null, null for what has none."""
    ids = known.select(F.col("name").alias(column), F.col("id").alias("__id"))
    return df.join(ids, column, "left").withColumn(column, F.when(F.col(column).isNull(), 0).otherwise(F.col("__id"))).select(*df.columns)


def word(node: Column) -> Column:
    return F.shiftright(node, 6)


def bit(node: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), node.bitwiseAND(F.lit(WORD - 1)).cast("int"))  # by a column


def packed(pairs: DataFrame) -> DataFrame:
    """``(root, word, bits)`` of ``pairs(root, node)`` of whole numbers: each root's nodes, those of one word in one row."""
    return pairs.groupBy("root", word(F.col("node")).alias("word")).agg(F.bit_or(bit(F.col("node"))).alias("bits"))


def members(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(node, ...)`` of each root that has the node in its packed set: ``(root, node, ...)``."""
    own = rows.withColumn("word", word(F.col("node"))).withColumn("bit", bit(F.col("node")))
    return sets.join(own, "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bits", "bit")


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, word, bits)``: what each root reaches from its ``start(root, word, bits)`` along ``edges(src, dst)`` of whole numbers.

    A round takes the newest bits along the edges and leaves out what is known. Rows hold 64 nodes, and what is known lies in buckets by
    root and word, so only what is new moves.
    """
    onward = edges.groupBy(word(F.col("src")).alias("word"), bit(F.col("src")).alias("from"), word(F.col("dst")).alias("next")).agg(F.bit_or(bit(F.col("dst"))).alias("to"))
    onward, known, zero = checkpoint(onward), bucketed(start.withColumn("fresh", F.col("bits")), "root", "word"), F.lit(0).cast("long")
    while not (new := known.filter("fresh <> 0")).isEmpty():
        step = new.join(onward, "word").filter(F.col("fresh").bitwiseAND(F.col("from")) != 0)
        step = step.groupBy("root", F.col("next").alias("word")).agg(F.bit_or("to").alias("got"))
        old, got = F.coalesce("bits", zero), F.coalesce("got", zero)
        known = bucketed(known.drop("fresh").join(step, ["root", "word"], "full").select("root", "word", old.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(old)).alias("fresh")), "root", "word")
    return known.drop("fresh")


def lowest(bits: Column) -> Column:
    """The place of the lowest bit; by shifts, as the last bit's number can't be negated."""
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.shiftleft(bits, n))
    return WORD - F.bit_count(bits)


def highest(bits: Column) -> Column:
    """The place of the highest bit."""
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
    return F.bit_count(bits) - 1
