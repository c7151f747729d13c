"""Keyword tagger: a class-weighted logistic regression on token features with context, and the choice of tags."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.functions import optimise
from marklens.sources.shared import write_table

from . import features

COLUMNS = ["tfidf", "keyphraseness", "len"]
INPUTS = [f"{side}{c}" for c in COLUMNS for side in ("", "before_", "after_")]
TOKENS_OF_A_ROW = 32  # few, as readers hold thousands of rows at once


def inputs(tokens: DataFrame, train: DataFrame) -> DataFrame:
    """``(doc_id, pos, keyword, weight, ...)``: features fitted on ``train``, with both neighbours' (0 at the ends).

    Written once, ``TOKENS_OF_A_ROW`` a row, each feature as an array in the order of the places, with a value more at either end. Neighbours are the same
    arrays moved by one, so tokens are neither sorted over partitions nor stored with their neighbours' values.
    """
    counts = features.packed(tokens.select("doc_id", "token", "pos", "len", (F.col("label") != 0).alias("keyword")))
    values = features.tfidf_terms(counts, features.word_values(train), more=("keyphraseness",)).fillna(0.0, ["keyphraseness"])
    words = values.groupBy("doc_id").agg(F.collect_list(F.struct("places", "tfidf", "keyphraseness")).alias("words"))
    at = lambda w: F.transform(w["places"], lambda p: F.struct(p["pos"].alias("pos"), p["keyword"].alias("keyword"), w["tfidf"].alias("tfidf"), w["keyphraseness"].alias("keyphraseness"), p["len"].cast("double").alias("len")))
    own = words.select("doc_id", F.array_sort(F.flatten(F.transform("words", at))).alias("at"))
    zero, size, starts = F.array(F.lit(0.0)), F.size("pos"), F.sequence(F.lit(1), F.size("pos"), F.lit(TOKENS_OF_A_ROW))
    own = own.select("doc_id", "at.pos", "at.keyword", *(F.concat(zero, F.col(f"at.{c}"), zero).alias(c) for c in COLUMNS))
    part = lambda i: F.struct(*(F.slice(c, i, F.lit(TOKENS_OF_A_ROW + 2 * (c in COLUMNS))).alias(c) for c in ("pos", "keyword", *COLUMNS)))
    own = write_table(own.select("doc_id", F.inline(F.transform(starts, part))), "inputs")
    sides = {f"{side}{c}": F.slice(c, F.lit(n), size) for n, side in ((1, "before_"), (3, "after_"), (2, "")) for c in COLUMNS}
    out = own.select("doc_id", "pos", "keyword", *(x.alias(c) for c, x in sides.items())).select("doc_id", F.inline(F.arrays_zip("pos", "keyword", *INPUTS)))
    weights = features.class_weights(train.select((F.col("label") != 0).cast("int").alias("label"))).select(F.col("label").cast("double").alias("keyword"), "weight")
    weights = write_table(weights, "weights")  # every pass of a fit meets them
    return out.withColumn("keyword", F.col("keyword").cast("double")).join(F.broadcast(weights), "keyword", "left").fillna(1.0, ["weight"])  # one row per class


def train(rows: DataFrame, max_iter: int = 10) -> PipelineModel:
    """Fit on ``inputs``; the optimiser's passes are distributed sums over the rows as they lie, of which Spark's own fit would keep nine inputs a token."""
    coefficients, intercept = fit(rows, max_iter)
    return PipelineModel([VectorAssembler(inputCols=INPUTS, outputCol="x"), _model(rows.sparkSession, coefficients, intercept)])


def _model(spark: SparkSession, coefficients: list[float], intercept: float) -> LogisticRegressionModel:
    """Spark's model with given values: its fit of two rows within bounds that leave no other."""
    rows = spark.createDataFrame([(0.0, Vectors.dense([0.0] * len(INPUTS))), (1.0, Vectors.dense([1.0] * len(INPUTS)))], ["keyword", "x"])
    c, b = DenseMatrix(1, len(INPUTS), coefficients), Vectors.dense([intercept])
    bounds = {"lowerBoundsOnCoefficients": c, "upperBoundsOnCoefficients": c, "lowerBoundsOnIntercepts": b, "upperBoundsOnIntercepts": b}
    return LogisticRegression(featuresCol="x", labelCol="keyword", standardization=False, **bounds).fit(rows)


def fit(rows: DataFrame, max_iter: int = 10) -> tuple[list[float], float]:
    """Coefficients and intercept of the weighted logistic loss: L-BFGS on standardised inputs from the classes' log odds, as in Spark's ``LogisticRegression``."""
    w, y = F.col("weight"), F.col("keyword")
    sums = [F.sum(w), F.sum(w * w), F.sum(w * y), *(F.sum(w * F.col(c)) for c in INPUTS), *(F.sum(w * F.col(c) * F.col(c)) for c in INPUTS)]
    total, squares, positive, *rest = rows.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
    size = len(INPUTS)
    mean = np.array(rest[:size]) / total
    variance = np.maximum(np.array(rest[size:]) - total * mean**2, 0) / (total - squares / total)
    scale = np.array([1 / v**0.5 if v > 1e-15 * m * m else 0.0 for v, m in zip(variance, mean)])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        own = x[:size] * scale
        margin = sum((F.col(c) * float(k) for c, k in zip(INPUTS, own)), F.lit(float(x[size] - own @ mean)))
        row = rows.select("*", margin.alias("m")).select("*", (w * (1 / (1 + F.exp(-F.col("m"))) - y)).alias("e"))
        value = w * (F.when(F.col("m") > 0, F.log1p(F.exp(-F.col("m")))).otherwise(F.log1p(F.exp(F.col("m"))) - F.col("m")) + (1 - y) * F.col("m"))
        first, e, *grads = row.agg(F.sum(value).alias("v"), F.sum("e").alias("e"), *(F.sum(F.col("e") * F.col(c)).alias(c) for c in INPUTS)).first()
        return first / total, np.append((np.array(grads) - e * mean) * scale, e) / total

    start = np.append(np.zeros(size), np.log(positive / (total - positive)))
    x = optimise.minimum(loss, start, max_iter)
    own = x[:size] * scale
    return own.tolist(), float(x[size] - own @ mean)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``(doc_id, pos, score)``: each token's probability of being a keyword."""
    return model.transform(rows).select("doc_id", "pos", vector_to_array("probability")[1].alias("score"))


def tags(scored: DataFrame, excluded: str) -> DataFrame:
    """Rows with a score over one half (and not over 1) that lie in no environment whose name matches ``excluded``."""
    return scored.filter((F.col("score") > 0.5) & (F.col("score") <= 1) & ~F.exists("envs", lambda e: e.rlike(excluded)))


def save(model: PipelineModel, path: str, settings: dict) -> None:
    """The model and one JSON row of its settings, with its class."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    text = json.dumps(settings | {"class": type(model.stages[-1]).__name__}, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str, expected: str = "LogisticRegressionModel") -> tuple[PipelineModel, dict]:
    """The model and its settings; another class is an error."""
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    if settings["class"] != expected:
        raise ValueError(f"a {settings['class']}, not a {expected}")
    return PipelineModel.load(f"{path}/model"), settings
