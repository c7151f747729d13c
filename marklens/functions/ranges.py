"""Positions and ranges as structs ``(line, character)`` and ``(start, end)``; struct order is position order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column | None = None) -> Column:
    """Whether a range holds a position or another range, ends included."""
    return (outer_start <= start) & (outer_end >= (start if end is None else end))


def union(start: Column, end: Column) -> tuple[Column, Column]:
    """Aggregates: the smallest range over all of a group."""
    return F.min(start), F.max(end)


def enumeration(items: Column, word: str = "or") -> Column:
    """``"a", "b" or "c"``."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    n = F.size(quoted)
    return F.when(n < 2, F.array_join(quoted, "")).otherwise(F.concat(F.array_join(F.slice(quoted, F.lit(1), n - 1), ", "), F.lit(f" {word} "), F.element_at(quoted, -1)))
