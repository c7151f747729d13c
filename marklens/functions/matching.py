"""Likeness of two strings by their matching blocks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with_block(a: Column, b: Column, use) -> Column:
    """``use(i, k)`` of the longest block that ``a`` and ``b`` share, ``k`` characters from place ``i`` (from 1) of ``a``; of equally long ones
    the first in ``a``. Each step lengthens the block at a place by one, or goes on to the next place. ``a`` isn't empty."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("k"))

    def step(acc, _):
        at, k = acc["at"], acc["k"]
        longer = (at + k <= F.length(a)) & (F.position(F.substring(a, at, k + 1), b) > 0)
        at_this, at_next = F.struct(at.alias("at"), at.alias("i"), (k + 1).alias("k")), F.struct((at + 1).alias("at"), acc["i"].alias("i"), k.alias("k"))
        return F.when(longer, at_this).otherwise(at_next)  # one condition, evaluated once a step

    return F.aggregate(F.sequence(F.lit(1), 2 * F.length(a)), start, step, lambda acc: use(acc["i"], acc["k"]))


def matched(a: Column, b: Column) -> Column:
    """Characters in matching blocks: the longest block both share (first in ``a``, then in ``b``), and the same again left and right of it.

    What is still to compare is a stack of pairs; a step takes one off and puts what its block parts back. Null if either is null.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    filled = lambda p: (F.length(p["a"]) > 0) & (F.length(p["b"]) > 0)
    start = F.struct(F.filter(F.array(pair(a, b)), filled).alias("open"), F.lit(0).alias("sum"))

    def step(acc, _):
        top = F.get(acc["open"], F.lit(0))
        rest = F.slice(acc["open"], F.lit(2), F.size(acc["open"]))

        def parted(i, k):
            j = F.position(F.substring(top["a"], i, k), top["b"])
            sides = F.array(pair(F.substring(top["a"], F.lit(1), i - 1), F.substring(top["b"], F.lit(1), j - 1)),
                            pair(F.substring(top["a"], i + k, F.length(top["a"])), F.substring(top["b"], j + k, F.length(top["b"]))))
            return F.struct(F.when(k > 0, F.concat(F.filter(sides, filled), rest)).otherwise(rest).alias("open"), (acc["sum"] + k).alias("sum"))

        return F.when(F.size(acc["open"]) > 0, _with_block(top["a"], top["b"], parted)).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1), start, step, lambda acc: acc["sum"])
    return F.when(a.isNotNull() & b.isNotNull(), found)


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters; 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * matched(a, b) / total)


def numbered_characters(text: Column) -> Column:
    """A text's characters as a set of whole numbers: each code with how often it stood before, so what two texts share counts repeated ones.

    In order, equal ones lie together, so the number comes from the first one's place and no character is held against all.
    """
    number = lambda chars: F.transform(chars, lambda x, i: F.ascii(x).cast("long") + F.shiftleft((i - F.array_position(chars, x)).cast("long") + 1, 21))
    ordered = F.array_sort(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.get(F.transform(F.array(ordered), number), F.lit(0))  # the outer step holds the ordered ones, which would else be sorted anew for each
