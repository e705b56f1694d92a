"""The whole trend workflow: folds, clusters, curves, thresholds, decisions, agreement, reports.

Folds are clustered one after another (each is a loop of its own); everything after that carries
``fold`` as a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.operators import clustering, evaluation, trend


@dataclass
class Outcome:
    decisions: DataFrame  # fold, part (train or test), series_id, y, label, best_by, p
    report: DataFrame  # label, precision, recall, f1, support: decided test rows, clusters named as in fold 0
    agreement: DataFrame  # fold_i, fold_j, agree, differ, share
    undecided: DataFrame  # part, share


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run(series: DataFrame, k: int = 2, folds: int = 5, gamma_max: int = 20, target: float = 0.5, gamma: float = 1.0, seed: int = 0, max_iter: int | None = None) -> Outcome:
    """``series``: (series_id, x). Clusters of each fold's training rows are the classes; test rows' true class is the nearest centroid."""
    spark = series.sparkSession
    s = evaluation.kfold(series.select("series_id", "x"), folds, seed).persist()  # for the clusterings and thresholds; the result reads the series again
    labels, decided, members, every = list(range(k)), [], [], []
    for f in range(folds):
        train, test = s.where(F.col("fold") != f).select("series_id", "x"), s.where(F.col("fold") == f).select("series_id", "x")
        made = clustering.multiresolution(train, k, max_iter=max_iter, seed=seed)
        every.append(made.centroids)
        members.append(made.assigned.select(F.lit(f).alias("fold"), "cluster", "series_id"))
        model = (labels, np.arange(k), made.centroids)
        truth = made.assigned.select("series_id", F.col("cluster").alias("y"))
        curve = trend.curves(train, model, list(range(1, gamma_max + 1)), gamma)
        limits = trend.thresholds(trend.judged(curve, truth), labels, target, gamma_max)
        limits = spark.createDataFrame(limits.collect(), limits.schema)  # one row a label; else both parts take the curves for it again
        for part, own, own_truth in (("train", train, truth), ("test", test, clustering.assign(test, made.centroids).select("series_id", F.col("cluster").alias("y")))):
            d = trend.decide(trend.curves(own, model, list(range(1, gamma_max + 1)), gamma), limits).join(own_truth, "series_id")
            decided.append(d.select(F.lit(f).alias("fold"), F.lit(part).alias("part"), "series_id", "y", "label", "best_by", "p"))
    s.unpersist()
    decisions = _union(decided)
    near = []
    for i in range(folds):
        for j in range(i, folds):
            c, _, _ = clustering.nearest(every[i], every[j])
            near += [(i, a, j, int(b)) for a, b in enumerate(c)]
    nearest = spark.createDataFrame(near, "fold_i int, k int, fold_j int, o int")
    onto = spark.createDataFrame([(f, a, int(b)) for f in range(folds) for a, b in enumerate(clustering.nearest(every[f], every[0])[0])], "fold int, from int, to int")
    name = lambda c: onto.select("fold", F.col("from").alias(c), F.col("to").alias(f"{c}0"))
    test = decisions.where("part = 'test' and label is not null").join(F.broadcast(name("y")), ["fold", "y"]).join(F.broadcast(name("label")), ["fold", "label"])
    undecided = decisions.groupBy("part").agg(F.avg(F.col("label").isNull().cast("double")).alias("share"))
    return Outcome(decisions, evaluation.report(test, "y0", "label0"), evaluation.fold_agreement(_union(members), nearest), undecided)
