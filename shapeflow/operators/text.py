"""Tokens, rare terms, tf-idf, set overlap and information gain."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from shapeflow.functions import stemmer

WORD = r"[\p{L}\p{N}_]+"


#: Terms that are broadcast at most (counted first).
BROADCAST_TERMS = 500_000


def tokens(df: DataFrame, text: str, from_col: int = 0, stop_words: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """One row per token (``distinct``: per different token) of the lower-cased text, the first ``from_col`` tokens left out: adds token."""
    t = F.slice(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)), from_col + 1, 2147483647)
    d = df.withColumn("token", F.explode(F.array_distinct(t) if distinct else t))
    return d.where(~F.col("token").isin(stop_words)) if stop_words else d


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


@F.pandas_udf(StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter stems, each distinct word of a batch once."""
    for s in words:
        yield s.map({w: stemmer.stem(w) for w in s.dropna().unique()})


def drop_rare(counts: DataFrame, threshold: float) -> DataFrame:
    """(token, n): those with n / (number of distinct tokens) > threshold."""
    return counts.join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("_v"))), F.lit(True)).where(F.col("n") / F.col("_v") > threshold).drop("_v")


def tfidf(toks: DataFrame, doc: str, idf: bool = True, salts: int = 16) -> DataFrame:
    """(doc, token, tf, weight): tf * (ln((1 + N) / (1 + df)) + 1), or tf alone, L2-normalised by document.

    The document frequencies are broadcast if their counted number allows it; else a token's rows
    are dealt over ``salts`` tasks, so that a frequent token is not one task's.
    """
    tf = toks.groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf"))
    if idf:
        df_ = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        if df_.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            w = tf.join(F.broadcast(df_), "token")
        else:
            salt = F.pmod(F.xxhash64(F.col(doc)), F.lit(salts)).cast("int")
            w = tf.withColumn("_s", salt).join(df_.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["token", "_s"]).drop("_s")
        n = F.broadcast(toks.agg(F.countDistinct(doc).alias("N")))
        w = w.join(n, F.lit(True)).withColumn("w", F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    else:
        w = tf.withColumn("w", F.col("tf").cast("double"))
    return w.select(doc, "token", "tf", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("weight"))


def sparse_features(toks: DataFrame, doc: str, buckets: int = 1 << 16) -> DataFrame:
    """(doc, features): tf-idf weights as one sparse vector of hashed terms a document, for the learners."""
    w = tfidf(toks, doc).groupBy(doc, F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("i")).agg(F.sum("weight").alias("v"))
    g = w.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("t"))

    @F.udf(VectorUDT())
    def vector(t):
        return Vectors.sparse(buckets, [x["i"] for x in t], [x["v"] for x in t])

    return g.select(doc, vector("t").alias("features"))


def asymmetric_jaccard(toks: DataFrame, cls: str) -> DataFrame:
    """(a, b, share): share of class a's distinct tokens that class b has too. Classes without tokens do not occur."""
    d = toks.select(F.col(cls).alias("c"), "token").distinct()
    n = d.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sets = d.groupBy("token").agg(F.collect_set("c").alias("cs"))  # at most one entry a class
    both = sets.select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    grid = n.select(F.col("c").alias("a"), "n").join(n.select(F.col("c").alias("b")), F.lit(True))
    return grid.join(both, ["a", "b"], "left").select("a", "b", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("share"))


def info_gain(toks: DataFrame, rows: DataFrame, cls: str) -> DataFrame:
    """(token, n, p_token, gain): gain = sum over classes of P(class|token) ln(P(class|token) / P(class)); class priors from ``rows``."""
    prior = rows.groupBy(F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("m"))
    prior = prior.withColumn("prior", F.col("m") / F.sum("m").over(Window.partitionBy())).drop("m")
    g = toks.groupBy("token", F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(prior), "c")
    g = g.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("token")))
    t = g.groupBy("token").agg(F.sum("k").alias("n"), F.sum(F.col("p") * F.log(F.col("p") / F.col("prior"))).alias("gain"))
    return t.join(F.broadcast(t.agg(F.sum("n").alias("_all"))), F.lit(True)).select("token", "n", (F.col("n") / F.col("_all")).alias("p_token"), "gain")


def column_gain(rows: DataFrame, columns: list[str], cls: str) -> DataFrame:
    """:func:`info_gain` of the values of whole columns, such as user and category: (kind, token, n, p_token, gain); each column by itself."""
    out = None
    for c in columns:
        toks = rows.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("token"), cls)
        one = info_gain(toks, rows, cls).select(F.lit(c).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def weight_gain(rows: DataFrame, columns: list[str], cls: str, names: dict[str, str] | None = None) -> DataFrame:
    """(token, n, p_token, gain) of weight columns, such as referrers: P(class|column) is the class's share of the column's positive weight; class priors from row counts."""
    prior = rows.groupBy(F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("m"))
    prior = prior.withColumn("prior", F.col("m") / F.sum("m").over(Window.partitionBy())).drop("m")
    stack = ", ".join(f"'{(names or {}).get(c, c)}', cast(`{c}` as double)" for c in columns)
    g = rows.select(F.col(cls).alias("c"), F.expr(f"stack({len(columns)}, {stack}) as (token, w)")).where("w > 0").groupBy("token", "c").agg(F.sum("w").alias("k"))
    g = g.join(F.broadcast(prior), "c").withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("token")))
    t = g.groupBy("token").agg(F.sum("k").alias("n"), F.sum(F.col("p") * F.log(F.col("p") / F.col("prior"))).alias("gain"))
    return t.join(F.broadcast(t.agg(F.sum("n").alias("_all"))), F.lit(True)).select("token", "n", (F.col("n") / F.col("_all")).alias("p_token"), "gain")


def top_gains(gains: DataFrame, k: int = 100) -> DataFrame:
    """The k tokens of the largest (rounded) gain with their rank; of equals the last in the alphabet first. A top-k report."""
    best = gains.withColumn("_g", F.round("gain", 9)).orderBy(F.col("_g").desc(), F.col("token").desc()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_g").desc(), F.col("token").desc()))).drop("_g")


def mutual_information(gains: DataFrame) -> DataFrame:
    return gains.agg(F.sum(F.col("p_token") * F.col("gain")).alias("mi"))


def chi_square(df: DataFrame, cls: str, label: str) -> DataFrame:
    """(cls, chi2, dof): goodness of fit of each class's labels to the pooled distribution."""
    n = df.groupBy(cls, label).agg(F.count(F.lit(1)).alias("o"))
    by_class = n.groupBy(cls).agg(F.sum("o").alias("nc"))
    pooled = n.groupBy(label).agg(F.sum("o").alias("nl")).withColumn("all", F.sum("nl").over(Window.partitionBy()))
    grid = by_class.join(F.broadcast(pooled), F.lit(True)).join(n, [cls, label], "left").withColumn("e", F.col("nc") * F.col("nl") / F.col("all"))
    return grid.groupBy(cls).agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - F.col("e"), 2) / F.col("e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


@F.pandas_udf(DoubleType())
def chi_square_p(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """P(a chi-square variable of ``dof`` degrees exceeds ``chi2``)."""
    return pd.Series([_upper_gamma(d / 2, x / 2) for x, d in zip(chi2, dof, strict=True)], dtype=float)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: its series below a + 1, its continued fraction (Lentz) above."""
    if a <= 0 or x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c, f = x + 1 - a, 1e300, 0.0
    f = d = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * f
