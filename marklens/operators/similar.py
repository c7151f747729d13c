"""Similar names by matching blocks: what a reference that nothing resolves may have meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marklens.functions import matching

from .link import overlaps


def close_matches(wanted: DataFrame, names: DataFrame, least: float = 0.6, best: int = 3) -> DataFrame:
    """``(path, symbol, mask, name, ratio, nth)``: for ``wanted(path, symbol, mask)``, up to ``best`` of the names that its file sees,
    ``names(path, name, type)``, with a matching-blocks ratio of ``least`` or more; equally good ones by name, last first.

    Both are identifier paths, joined by ``?``. A name counts if its type overlaps the mask, or its last identifier is the wanted one's.
    None that passes is lost: the common characters, repeated ones counted, bound the ratio from above. A name and a reference of one
    file meet once. Nulls and empty names are like nothing; repeated rows count once. Names are compared whole, whatever their length.
    """
    share = least / 2
    held = lambda df, column, out: df.filter(F.length(column) > 0).distinct().withColumn(out, matching.numbered_characters(F.col(column)))
    a, b = held(wanted.select("path", "symbol", "mask"), "symbol", "__a"), held(names.select("path", "name", "type"), "name", "__b")
    last = lambda c: F.substring_index(c, "?", -1)
    total = F.length("symbol") + F.length("name")
    fits: Column = overlaps(F.col("type"), F.col("mask")) | (last("symbol") == last("name"))
    enough = F.size(F.array_intersect("__a", "__b")) >= share * total - 1e-9
    pairs = a.join(b.hint("merge"), "path").filter(fits & (F.least(F.length("symbol"), F.length("name")) >= share * total - 1e-9))
    pairs = pairs.filter(enough).select("path", "symbol", "mask", "name").distinct()
    known = pairs.select("symbol", "name").distinct().withColumn("ratio", matching.ratio(F.col("name"), F.col("symbol"))).filter(F.col("ratio") >= least)
    rank = F.row_number().over(W.partitionBy("path", "symbol", "mask").orderBy(F.desc("ratio"), F.desc("name")))
    return pairs.join(known, ["symbol", "name"]).select("path", "symbol", "mask", "name", "ratio", rank.alias("nth")).filter(F.col("nth") <= best)
