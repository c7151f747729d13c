"""Nested ranges: what lies inside what, by one ordered sweep per path instead of range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.sources.shared import checkpoint

END = 1 << 40  # stands for the end of a range that is never closed
ORDER = ("__at", "__rank", "__tie")


def with_depth(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``events(step, ...)`` plus ``depth``, the number of open ones after each, and ``stray``: a close (-1) without an open one.

    The running sum less its lowest value so far: a close below that is stray and leaves the depth at 0.
    """
    w = W.partitionBy(*by).orderBy(*order)
    run = events.withColumn("__run", F.sum("step").over(w))
    low = run.withColumn("__low", F.least(F.lit(0), F.min("__run").over(w)))
    before = F.coalesce(F.lag("__low").over(w), F.lit(0))
    out = low.withColumn("stray", (F.col("step") == -1) & (F.col("__low") < before))
    return out.withColumn("depth", (F.col("__run") - F.col("__low")).cast("int")).drop("__run", "__low")


def nearest(points: DataFrame, ranges: DataFrame, half_open: bool = False, into: str = "near") -> DataFrame:
    """``points(path, pos, ...)`` plus the innermost of the ``ranges(path, begin_pos, end_pos, ...)`` around each, as a struct, or null.

    Ranges nest: two of a path are apart or one holds the other; an end may be null. Inside means strictly between the ends, or with
    ``half_open`` from the begin on and before the end. Begins, points and ends of a path go by once in order: the running number of open ranges is a
    point's depth, and the last begin at that depth is the one around it. A sort, so a long file isn't quadratic; no range join.
    Points at one place and repeated points get the same; repeated ranges are told apart by nothing, so one of them is named.
    """
    begin, point = (1, 2) if half_open else (2, 1)
    r = ranges.select("path", "begin_pos", F.coalesce("end_pos", F.lit(END)).alias("end_pos"), F.struct(*ranges.columns).alias("__r"))
    p = F.struct(*points.columns)
    kinds = points.select(p.alias("p")).schema["p"].dataType, r.schema["__r"].dataType
    none_p, none_r = F.lit(None).cast(kinds[0]), F.lit(None).cast(kinds[1])
    row = lambda df, at, rank, tie, step, pt, rg: df.select("path", F.col(at).cast("long").alias("__at"), F.lit(rank).alias("__rank"), tie.cast("long").alias("__tie"), F.lit(step).alias("step"), pt.alias("__p"), rg.alias("__r"))
    events = (
        row(points, "pos", point, F.lit(0), 0, p, none_r)
        .union(row(r, "begin_pos", begin, -F.col("end_pos"), 1, none_p, F.col("__r")))
        .union(row(r.filter(F.col("end_pos") < END), "end_pos", 0, -F.col("begin_pos"), -1, none_p, none_r))
    )
    depth = events.withColumn("__depth", F.sum("step").over(W.partitionBy("path").orderBy(*ORDER))).filter("step >= 0")
    hit = depth.withColumn("__near", F.last("__r", ignorenulls=True).over(W.partitionBy("path", "__depth").orderBy(*ORDER)))
    found = F.when(F.col("__depth") > 0, F.col("__near"))
    return hit.filter("__p IS NOT NULL").select("__p.*", found.alias(into))


def with_parents(ranges: DataFrame) -> DataFrame:
    """``ranges(path, begin_pos, end_pos, ...)`` plus ``parent``, the begin of the range around each, or null."""
    own = ranges.withColumn("pos", F.col("begin_pos"))
    return nearest(own, ranges.select("path", "begin_pos", "end_pos")).withColumn("parent", F.col("near.begin_pos")).drop("near", "pos")


def chains(ranges: DataFrame, name: str) -> DataFrame:
    """``(path, begin_pos, names)``: the names of the ranges around each range and its own, outermost first.

    Each round doubles how far up every chain reaches, so there are about log2(depth) rounds over the ranges.
    """
    now = checkpoint(with_parents(ranges.select("path", "begin_pos", "end_pos", name)).select("path", "begin_pos", "parent", F.array(name).alias("names")))
    while not now.filter("parent IS NOT NULL").isEmpty():
        up = now.select("path", F.col("begin_pos").alias("parent"), F.col("parent").alias("__next"), F.col("names").alias("__above"))
        step = now.join(up.hint("merge"), ["path", "parent"], "left")
        above = F.coalesce("__above", F.array().cast("array<string>"))
        now = checkpoint(step.select("path", "begin_pos", F.col("__next").alias("parent"), F.concat(above, F.col("names").cast("array<string>")).alias("names")))
    return now.select("path", "begin_pos", "names")
