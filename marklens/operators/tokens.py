"""Text and token operators: masking, word tables, positions, environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nesting

WORD = r"[\p{L}\p{N}_]+(?:'s)?|[!$%&()\-'.?,:;\"|]"
# fixed values: environments whose contents are math
MATH_ENVS = ("align", "alignat", "displaymath", "eqnarray", "equation", "gather", "math", "multline")
MATH = r"\$\$[^$]*\$\$|\$[^$]*\$|\\\([^()]*\\\)|\\\[[^\[\]]*\\\]|" + "|".join(rf"\\begin\{{{e}\*?\}}(?s:.*?)\\end\{{{e}\*?\}}" for e in MATH_ENVS)


def words(docs: DataFrame, key: str, text: Column, pattern: str = WORD) -> DataFrame:
    """``(key, pos, token)``: every match of the pattern, numbered from 0."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "token"))


def strip_comments(text: Column) -> Column:
    """Without ``%`` and what follows on its line, unless the sign is escaped."""
    return F.regexp_replace(text, r"(^|[^\\])%[^\n]*", "$1")


def mask_math(text: Column) -> Column:
    return F.regexp_replace(text, MATH, " <math> ")


def drop_structural(tokens: DataFrame, key: str = "doc_id", pattern: str = r"^[\s!$%&()\-'.?,:;\"|]+$") -> DataFrame:
    """Tokens that aren't white space or structure, numbered anew in each document."""
    kept = tokens.filter(~F.col("token").rlike(pattern))
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("pos")).cast("long") - 1)


def line_and_character(text: Column, offset: Column) -> tuple[Column, Column]:
    """0-based line and character of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n")))
    return line, F.length(F.substring_index(before, "\n", -1))


def text_at(text: Column, begin: Column, end: Column) -> Column:
    """The characters from offset ``begin`` up to ``end``, both 0-based; what lies past the text is left out."""
    return F.substring(text, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def german(text: Column) -> Column:
    """Escaped umlauts and sharp s as letters."""
    for a, b in (('\\"a', "ä"), ('\\"o', "ö"), ('\\"u', "ü"), ('\\"A', "Ä"), ('\\"O', "Ö"), ('\\"U', "Ü"), ("\\ss", "ß")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def environment_tokens(args: DataFrame) -> DataFrame:
    """Begin and end macros with the running depth and what they pair with: ``(path, pos, step, env, depth, nth)``. An end without a begin is left out."""
    own = args.filter(F.col("name").isin("begin", "end")).select("path", "pos", F.when(F.col("name") == "begin", 1).otherwise(-1).alias("step"), F.get("rargs", F.lit(0)).alias("env"))
    run = nesting.with_depth(own, ["path"], ["pos"]).filter("NOT stray").drop("stray")
    own = run.withColumn("depth", F.col("depth") + F.when(F.col("step") == -1, 1).otherwise(0))
    return own.withColumn("nth", F.row_number().over(W.partitionBy("path", "depth", "step").orderBy("pos")))


def environments(args: DataFrame) -> DataFrame:
    """``(path, env, begin_pos, end_pos, end_env, depth)``: begins paired with ends of their depth; unclosed ones have no end."""
    e = environment_tokens(args)
    a, z = e.filter("step = 1"), e.filter("step = -1").select("path", "depth", "nth", F.col("pos").alias("end_pos"), F.col("env").alias("end_env"))
    return a.join(z.hint("merge"), ["path", "depth", "nth"], "left").select("path", "env", F.col("pos").alias("begin_pos"), "end_pos", "end_env", "depth")


def unbalanced(envs: DataFrame) -> DataFrame:
    """Environments without an end, or with another's."""
    return envs.filter(F.col("end_pos").isNull() | (F.col("env") != F.col("end_env")))


def enclosing(points: DataFrame, envs: DataFrame) -> DataFrame:
    """``points(path, pos, ...)`` plus ``envs``: names of the environments around each, outermost first."""
    chain = nesting.chains(envs, "env").select("path", F.col("begin_pos").alias("__begin"), F.col("names").alias("envs"))
    near = nesting.nearest(points, envs.select("path", "begin_pos", "end_pos")).withColumn("__begin", F.col("near.begin_pos")).drop("near")
    out = near.join(chain, ["path", "__begin"], "left").select(*points.columns, "envs")
    return out.withColumn("envs", F.coalesce("envs", F.expr("cast(array() as array<string>)")))


def outermost(envs: DataFrame, pattern: str) -> DataFrame:
    """Environments whose name matches and that lie in no other that does."""
    own = envs.filter(F.col("env").rlike(pattern))
    return nesting.with_parents(own).filter("parent IS NULL").select(*envs.columns)
