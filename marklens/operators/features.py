"""Token features: ``tokens(doc_id, pos, token, ...)`` are counted by document and word first, and all values come from those counts.

What is asked for by position travels with the counts: a row a document and word holds the word's places there, so tokens meet no
join or window of their own. Where ``tokens`` lie together by document (``together``), only joins by word and the way back move rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marklens.sources.shared import checkpoint

TOGETHER_BYTES = 8 << 20  # of documents as stored that are one partition of ``together``


def _doc():
    return W.partitionBy("doc_id")


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def together(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with all rows of a document in one partition; what is then split into tokens needs no exchange to be counted by document."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TOGETHER_BYTES)), 1 << 16), key)


def terms(tokens: DataFrame) -> DataFrame:
    """``(doc_id, token, c)``: how often a document has a word."""
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("c"))


def _with_length(counts: DataFrame) -> DataFrame:
    return counts.withColumn("l", F.sum("c").over(_doc()))


def packed(tokens: DataFrame, *more: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, token, c, places, ...)``: ``terms`` with all other columns of the tokens but those ``without``, a struct a place, and ``more`` aggregates.

    Positions alone are held without a struct, which would treble them.
    """
    rest = [c for c in tokens.columns if c not in ("doc_id", "token", *without)]
    place = F.col("pos") if rest == ["pos"] and not tokens.schema["pos"].nullable else F.struct(*rest)
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("c"), F.collect_list(place).alias("places"), *more)


def at_positions(values: DataFrame, *columns: str) -> DataFrame:
    """The tokens of ``packed`` rows again, with the named columns."""
    plain = not isinstance(values.schema["places"].dataType.elementType, StructType)
    return values.select("doc_id", "token", F.explode("places").alias("pos") if plain else F.inline("places"), *columns)


def by_word(rows: DataFrame, fitted: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``fitted`` by word. That is written first, so its true size tells whether the rows must move to meet it."""
    return rows.join(checkpoint(fitted), "token", how)


def _df(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def _n(counts: DataFrame) -> DataFrame:
    return counts.groupBy("doc_id").agg(F.lit(1)).agg(F.count("*").alias("n"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return _df(terms(tokens))


def n_documents(tokens: DataFrame) -> DataFrame:
    """One row: the number of documents with a token."""
    return _n(terms(tokens))


def _constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate."""
    return df.join(F.broadcast(one_row), F.lit(True))


def idf(tokens: DataFrame) -> DataFrame:
    counts = terms(tokens)
    out = _constants(_df(counts), _n(counts))
    return out.select("token", "df", F.when(F.col("df") > 0, F.log2(F.col("n") / F.col("df"))).otherwise(0.0).alias("idf"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return at_positions(_with_length(packed(tokens)).withColumn("tf", F.col("c") / F.col("l")), "tf")


def normalise(df: DataFrame, value: str, order: int = 1, times: Column | None = None) -> DataFrame:
    """``value`` divided by its document's Lp norm over all positions; 0 where the norm is 0. ``times``: positions a row stands for."""
    size = F.pow(F.abs(value), F.lit(order)) if order != 1 else F.abs(value)
    norm = F.sum(size if times is None else size * times).over(_doc())
    return df.withColumn(value, _zero(F.col(value), norm if order == 1 else F.pow(norm, F.lit(1 / order))))


def tfidf_terms(counts: DataFrame, fitted: DataFrame, order: int | None = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (``terms`` or ``packed``) with ``l, tf, tfidf`` by ``fitted(token, df, idf)``; a word without a fit counts 0. ``more`` columns of the fit come along."""
    own = _with_length(by_word(counts, fitted.select("token", "idf", *more), "left"))  # lengths after the join: they don't travel
    out = own.withColumn("tf", F.col("c") / F.col("l")).withColumn("tfidf", F.col("tf") * F.coalesce("idf", F.lit(0.0))).drop("idf")
    return normalise(out, "tfidf", order, F.col("c")) if order else out


def tfidf(tokens: DataFrame, fitted: DataFrame, order: int | None = 1) -> DataFrame:
    """``tokens`` with ``tf`` and ``tfidf`` by ``fitted(token, df, idf)``; a word without a fit counts 0."""
    return at_positions(tfidf_terms(packed(tokens), fitted, order), "tf", "tfidf")


def tfidf_leave_one_out(tokens: DataFrame) -> DataFrame:
    """TF-IDF of each token as fitted without its own document."""
    counts = terms(tokens)
    out = _constants(_with_length(by_word(packed(tokens), _df(counts))), _n(counts))
    value = F.when(F.col("df") > 1, F.log2((F.col("n") - 1) / (F.col("df") - 1))).otherwise(0.0)
    return at_positions(normalise(out.withColumn("tfidf", F.col("c") / F.col("l") * value), "tfidf", 1, F.col("c")), "tfidf")


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n_words"))


def _observed(tokens: DataFrame) -> DataFrame:
    counts = terms(tokens)
    own = by_word(_with_length(packed(tokens)), word_counts(tokens))
    lengths = counts.groupBy("doc_id").agg(F.sum("c").alias("l"))
    return _constants(own, lengths.agg(F.sum("l").alias("total"), F.count("*").alias("n")))


def _chi2(df: DataFrame, words: Column, rest: Column, n: Column, order: int | None) -> DataFrame:
    e1, e2 = words / n, rest / n
    part = lambda o, e: F.pow(o - e, F.lit(2)) / F.nullif(e, F.lit(0))
    value = F.when(words > 0, F.coalesce(part(F.col("c"), e1), F.lit(0.0)) + F.coalesce(part(F.col("l") - F.col("c"), e2), F.lit(0.0))).otherwise(0.0)
    out = df.withColumn("chi2", value)
    return at_positions(normalise(out, "chi2", order, F.col("c")) if order else out, "chi2")


def chi_square(tokens: DataFrame, order: int | None = None) -> DataFrame:
    """Chi-square of a word's count in its document against its average count per document, by an Lp norm where ``order`` is given."""
    w = F.col("n_words")
    return _chi2(_observed(tokens), w, F.col("total") - w, F.col("n"), order)


def chi_square_leave_one_out(tokens: DataFrame, order: int | None = None) -> DataFrame:
    return _chi2(_observed(tokens), F.col("n_words") - F.col("c"), F.col("total") - F.col("l"), F.nullif(F.col("n") - 1, F.lit(0)), order)


def _keyword_terms(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "token").agg(F.count_if(F.col("label") != 0).alias("own"))


def keyphraseness(tokens: DataFrame) -> DataFrame:
    """Keyword occurrences over documents, by word."""
    out = _keyword_terms(tokens).groupBy("token").agg(F.sum("own").alias("kf"), F.count("*").alias("df"))
    return out.withColumn("keyphraseness", F.col("kf") / F.col("df"))


def word_values(tokens: DataFrame) -> DataFrame:
    """``(token, df, idf, keyphraseness)``: ``idf`` and ``keyphraseness`` from one count of the tokens, so that rows meet both by one join."""
    counts = _keyword_terms(tokens)
    out = _constants(counts.groupBy("token").agg(F.sum("own").alias("kf"), F.count("*").alias("df")), _n(counts))
    return out.select("token", "df", F.log2(F.col("n") / F.col("df")).alias("idf"), (F.col("kf") / F.col("df")).alias("keyphraseness"))


def keyphraseness_terms(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """``counts`` (``terms`` or ``packed``) with ``keyphraseness`` by word; a word without a fit gets 0."""
    return by_word(counts, fitted.select("token", "keyphraseness"), "left").fillna(0.0, ["keyphraseness"])


def keyphraseness_transform(tokens: DataFrame, fitted: DataFrame) -> DataFrame:
    """``tokens`` with ``keyphraseness`` by word; a word without a fit gets 0."""
    return at_positions(keyphraseness_terms(packed(tokens), fitted), "keyphraseness")


def keyphraseness_leave_one_out(tokens: DataFrame) -> DataFrame:
    fitted = _keyword_terms(tokens).groupBy("token").agg(F.sum("own").alias("kf"), F.count("*").alias("df"))
    out = by_word(packed(tokens, F.count_if(F.col("label") != 0).alias("own"), without=("label",)), fitted)
    return at_positions(out.withColumn("keyphraseness", F.when(F.col("df") > 1, (F.col("kf") - F.col("own")) / (F.col("df") - 1)).otherwise(0.0)), "keyphraseness")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, index)``: 1-based rank by count, then first place; ``doc_id`` is a whole number.

    Ranks add up from three levels, so no task orders the whole vocabulary: words of higher counts (one row for each distinct
    count), words of the same count first met in earlier ranges of documents, and the order inside a range.
    """
    own = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    own = own.withColumn("part", F.shiftright(F.col("first.doc_id").cast("long"), 16))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = own.groupBy("n", "part").agg(F.count("*").alias("k"))
    higher = sizes.groupBy("n").agg(F.sum("k").alias("k")).select("n", earlier("k", W.orderBy(F.desc("n"))).alias("higher"))
    before = sizes.join(higher, "n").select("n", "part", (F.col("higher") + earlier("k", W.partitionBy("n").orderBy("part"))).alias("before"))
    nth = F.row_number().over(W.partitionBy("n", "part").orderBy("first"))
    return own.join(before, ["n", "part"]).select("token", (F.col("before") + nth).cast("long").alias("index"))


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab, "token")


def unknown(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab, "token", "left_anti")


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "pos", "index").join(vocab, "index")


def random_vector(size: int, seed: int = 0) -> list[float]:
    """The vector that all unknown words share: from -1 to 1, drawn once from the seed by a linear congruential generator."""
    out, x = [], seed
    for _ in range(size):
        x = (1103515245 * x + 12345) % 2147483648  # fixed values of the generator
        out.append(x / 1073741824 - 1)
    return out


def embed(tokens: DataFrame, table: DataFrame, size: int, missing: str = "zero") -> DataFrame:
    """Vectors by word from ``table(token, vec)``; an unknown word gets zeros, one fixed random vector, or goes."""
    known = table.join(tokens.select("token").distinct(), "token", "left_semi")  # few of a large table's words occur
    if missing == "drop":
        return at_positions(by_word(packed(tokens), known), *(c for c in table.columns if c != "token"))
    default = [0.0] * size if missing == "zero" else random_vector(size)
    out = at_positions(by_word(packed(tokens), known, "left"), *(c for c in table.columns if c != "token"))
    return out.withColumn("vec", F.coalesce("vec", F.array(*map(F.lit, default)).cast("array<float>")))


def moments(table: DataFrame, vec: str = "vec") -> DataFrame:
    x = table.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def pca(table: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """``table`` plus ``reduced``: the centred vectors on their first ``size`` principal components (signs are free)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = table.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))
    own = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(own).transform(own)
    out = PCA(k=size, inputCol="__c", outputCol="__r").fit(own).transform(own)
    return out.withColumn("reduced", vector_to_array("__r")).drop("__v", "__c", "__r")


def one_hot(tokens: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """0/1 array over the sorted categories; an unknown value gives zeros."""
    cats = categories.agg(F.array_sort(F.collect_set(column)).alias("cats"))  # the tag set is a fixed alphabet
    return _constants(tokens, cats).withColumn("one_hot", F.transform("cats", lambda c: (c == F.col(column)).cast("int"))).drop("cats")


def pad_front(rows: DataFrame, column: str) -> DataFrame:
    """Arrays front-padded with 0 to the longest."""
    longest = rows.agg(F.max(F.size(column)).alias("longest"))
    return _constants(rows, longest).withColumn("padded", F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("longest") - F.size(column)), column)).drop("longest")


def unpad(padded: Column, n: Column) -> Column:
    return F.slice(padded, F.size(padded) - n + 1, n)


def split_of(key: Column) -> Column:
    """train 0.7, validation 0.1, test 0.2 by the key's last digit."""
    return F.when(key % 10 < 7, "train").when(key % 10 < 8, "validation").otherwise("test")


def class_weights(tokens: DataFrame, padding: bool = False) -> DataFrame:
    """``(label, n, weight)``: minus the log of each class's share; padding counts as class 0."""
    counts = tokens.groupBy("label").agg(F.count("*").alias("n"))
    if padding:
        longest = tokens.groupBy("doc_id").agg(F.count("*").alias("l")).agg((F.max("l") * F.count("*") - F.sum("l")).alias("pads"))
        counts = _constants(counts, longest).select("label", (F.col("n") + F.when(F.col("label") == 0, F.col("pads")).otherwise(0)).alias("n"))
    return _constants(counts, counts.agg(F.sum("n").alias("all"))).select("label", "n", (-F.log(F.col("n") / F.col("all"))).alias("weight"))
