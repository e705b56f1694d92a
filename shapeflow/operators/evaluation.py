"""Folds, scaling, confusion, precision and recall, confidence intervals, agreement of folds."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(id_col: str, seed: int = 0) -> Column:
    """A reproducible order of ids: md5 of "id:seed" as text."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary"))


def kfold(df: DataFrame, k: int, seed: int = 0, id_col: str = "series_id") -> DataFrame:
    """Adds fold: the rank by a hash of the id and the seed, modulo k, so that sizes differ by one at most.

    Ranks come from 4,096 buckets of the hash, each ranked in its own task, and the buckets' sizes.
    """
    d = df.withColumn("_h", hashed(id_col, seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # at most 4,096 rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1
    return d.join(F.broadcast(before), "_b").withColumn("fold", ((F.col("_before") + rank) % k).cast("int")).select(*df.columns, "fold")


def stratified(df: DataFrame, k: int, label: str, id_col: str = "series_id") -> DataFrame:
    """Adds fold: ids of each class in turn."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(id_col)) - 1) % k).cast("int"))


def chronological(df: DataFrame, order: str, last: int, id_col: str = "series_id") -> DataFrame:
    """Adds train: false for the ``last`` rows by ``order`` (ties by id). The cut comes from a top-k, not from a sort of the table."""
    cut = df.select(order, id_col).orderBy(F.col(order).desc(), F.col(id_col).desc()).limit(last).agg(F.min(F.struct(order, id_col)).alias("cut"))
    return df.join(F.broadcast(cut), F.lit(True)).withColumn("train", F.coalesce(F.struct(order, id_col) < F.col("cut"), F.lit(True))).drop("cut")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(v - mean) / population deviation; 0 for a constant column. One small row of statistics."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    d = df.join(F.broadcast(stats), F.lit(True))
    return d.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in columns])


def confusion(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(y, p, n, share of y's row)."""
    g = df.groupBy(F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def mean_confusion(df: DataFrame, fold: str = "fold", truth: str = "y", pred: str = "p") -> DataFrame:
    """Row-normalised confusion, averaged over folds (a cell that a fold lacks counts 0)."""
    g = df.groupBy(fold, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(fold, "y")))
    return g.crossJoin(F.broadcast(df.agg(F.countDistinct(fold).alias("folds")))).groupBy("y", "p").agg((F.sum("share") / F.first("folds")).alias("share"))


def report(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(label, precision, recall, f1, support) for each class and for macro, micro and weighted averages; 0 / 0 is 0."""
    a = df.select(F.explode(F.array(F.struct(F.col(truth).cast("string").alias("label"), F.lit("y").alias("side")), F.struct(F.col(pred).cast("string").alias("label"), F.lit("p").alias("side")))).alias("e"), (F.col(truth) == F.col(pred)).alias("hit"))
    count = lambda c: F.count(F.when(c, 1))
    g = a.where("e.label is not null").groupBy("e.label").agg(count(F.expr("e.side = 'y'")).alias("support"), count(F.expr("e.side = 'p'")).alias("found"), count(F.expr("hit and e.side = 'y'")).alias("tp"))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    g = g.withColumn("precision", ratio("tp", "found")).withColumn("recall", ratio("tp", "support")).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("found") + F.col("support")).cast("double")), F.lit(0.0)))
    own = g.select("label", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = own.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro").alias("label"), *names, "support")
    weighted = own.agg(*[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted").alias("label"), *names, "support")
    micro = g.agg(F.sum("tp").alias("tp"), F.sum("found").alias("found"), F.sum("support").alias("support")).select(
        F.lit("micro").alias("label"), ratio("tp", "found").alias("precision"), ratio("tp", "support").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("found") + F.col("support")).cast("double")), F.lit(0.0)).alias("f1"), "support"
    )
    return own.unionByName(macro).unionByName(micro).unionByName(weighted)


def report_by(df: DataFrame, by: str, truth: str = "y", pred: str = "p") -> DataFrame:
    """(by, label, precision, recall, f1, support) of each class in each group; 0 / 0 is 0."""
    side = lambda c, n: F.struct(F.col(c).cast("string").alias("label"), F.lit(n).alias("side"))
    a = df.select(by, F.explode(F.array(side(truth, "y"), side(pred, "p"))).alias("e"), (F.col(truth) == F.col(pred)).alias("hit"))
    count = lambda c: F.count(F.when(F.expr(c), 1)).cast("double")
    g = a.where("e.label is not null").groupBy(by, "e.label").agg(count("e.side = 'y'").alias("support"), count("e.side = 'p'").alias("found"), count("hit and e.side = 'y'").alias("tp"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return g.select(
        by, "label", ratio(F.col("tp"), F.col("found")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("found") + F.col("support")).alias("f1"), F.col("support").cast("long").alias("support"),
    )


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection on its distribution function (numerical integration)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float) -> float:
        n, h = 2000, t / 2000
        f = [c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
        return 0.5 + h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    low, high = 0.0, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


def _t_factor(level: float) -> Callable:
    @F.pandas_udf("double")
    def factor(n: pd.Series) -> pd.Series:
        return n.map({m: t_quantile(0.5 + level / 2, int(m) - 1) for m in n.unique() if m > 1}).astype(float)

    return factor


def confidence(df: DataFrame, value: str, group: str, level: float = 0.95) -> DataFrame:
    """(group, mean, half): half = t * s / sqrt(n); null for a single value."""
    g = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    half = F.when(F.col("n") > 1, F.nanvl(_t_factor(level)("n"), F.lit(None).cast("double")) * F.col("s") / F.sqrt("n"))
    return g.select(group, "mean", half.alias("half"), "n")


def summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Text "mean +- half" a group."""
    return confidence(df, value, group).select(group, F.format_string("%.4f +- %.4f", "mean", F.coalesce("half", F.lit(0.0))).alias("text"))


def fold_agreement(members: DataFrame, nearest: DataFrame) -> DataFrame:
    """members (fold, cluster, series_id), nearest (fold_i, k, fold_j, o: the cluster of j nearest to k of i) -> (fold_i, fold_j, agree, differ, share)."""
    a = members.select(F.col("fold").alias("fold_i"), F.col("cluster").alias("k"), "series_id")
    b = members.select(F.col("fold").alias("fold_j"), F.col("cluster").alias("o2"), "series_id")
    d = a.join(b, "series_id").where("fold_i <= fold_j").join(F.broadcast(nearest), ["fold_i", "k", "fold_j"])
    g = d.groupBy("fold_i", "fold_j").agg(F.count(F.when(F.expr("o = o2"), 1)).alias("agree"), F.count(F.when(F.expr("o <> o2"), 1)).alias("differ"))
    return g.withColumn("share", F.col("agree") / (F.col("agree") + F.col("differ")))
