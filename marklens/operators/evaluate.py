"""Evaluation of predicted classes: ``(y_true, y_pred[, weight])`` in, long tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    return pairs.groupBy("y_true", "y_pred").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def row_normalised(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("y_true")))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn, tn, accuracy, recall, precision, f1)``; 0 on empty denominators. One pass over the
    pairs makes the confusion matrix, the rest is arithmetic on it."""
    m = confusion(pairs)
    both = m.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    c = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    c = c.join(F.broadcast(m.agg(F.sum("n").alias("n"))), F.lit(True))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    r, p = div(tp, F.col("t")), div(tp, F.col("p"))
    return c.select("label", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("n") - tp - fp - fn).alias("tn"), ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"), r.alias("recall"), p.alias("precision"), div(2 * r * p, r + p).alias("f1"))


def averages(scores: DataFrame, kind: str = "macro") -> DataFrame:
    """Macro, micro, or binary (the scores of class 1)."""
    if kind == "binary":
        return scores.filter("label = 1").select("recall", "precision", "f1")
    if kind == "macro":
        return scores.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("f1").alias("f1"))
    s = scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    r, p = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.select(r.alias("recall"), p.alias("precision"), (2 * r * p / (r + p)).alias("f1"))


def score_table(scores: DataFrame, average: bool = False) -> DataFrame:
    """Long table ``(row, metric, score)``: classes, and the macro average on request."""
    own = scores.select(F.col("label").cast("string").alias("row"), "recall", "precision", "f1")
    if average:
        own = own.unionByName(averages(scores).withColumn("row", F.lit("average")))
    return own.unpivot("row", ["recall", "precision", "f1"], "metric", "score")
