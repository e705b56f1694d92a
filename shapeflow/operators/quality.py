"""Cluster quality from sums of pair distances: series_id, c1, c2, n, d, dd (see clustering.pair_sums), or from pair distances and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.functions.kernels import rolling, top_eigenvectors
from shapeflow.operators import evaluation
from shapeflow.operators.clustering import _matrix, nearest


def cost(assigned: DataFrame) -> DataFrame:
    """Mean squared distance to the own centroid."""
    return assigned.agg(F.avg(F.col("dist") * F.col("dist")).alias("cost"))


def sums_of(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The sums from a table of pair distances (id1, id2, dist) and one of clusters (series_id, cluster), where these are there already."""
    a = clusters.select(F.col("series_id").alias("id1"), F.col("cluster").alias("c1"))
    b = clusters.select(F.col("series_id").alias("id2"), F.col("cluster").alias("c2"))
    d = pairs.join(a, "id1").join(b, "id2").groupBy(F.col("id1").alias("series_id"), "c1", "c2")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("d"), F.sum(F.col("dist") * F.col("dist")).alias("dd"))


def spread(sums: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Means and population deviations of distances within clusters (a series and itself included) and between them, and the ratio of their variations (larger is better)."""
    sums = sums if clusters is None else sums_of(sums, clusters)
    part = lambda c, own: F.sum(F.when(F.expr("c1 = c2") if own else F.expr("c1 <> c2"), F.col(c)))
    g = sums.agg(*[part(c, own).alias(f"{c}_{kind}") for kind, own in (("intra", True), ("inter", False)) for c in ("n", "d", "dd")])
    for kind in ("intra", "inter"):
        mean = F.try_divide(f"d_{kind}", f"n_{kind}")
        g = g.withColumn(f"{kind}_mean", mean).withColumn(f"{kind}_std", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(f"dd_{kind}", f"n_{kind}") - mean * mean)))
    g = g.select("intra_mean", "intra_std", "inter_mean", "inter_std")
    return g.withColumn("beta_cv", F.try_divide(F.try_divide("inter_std", "inter_mean"), F.try_divide("intra_std", "intra_mean")))


def silhouette(sums: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Mean over series of (b - a) / max(a, b): a own cluster's mean distance (itself included), b the least of the other clusters'; null with one cluster."""
    sums = sums if clusters is None else sums_of(sums, clusters)
    d = sums.withColumn("m", F.col("d") / F.col("n")).groupBy("series_id").agg(F.min(F.when(F.expr("c1 = c2"), F.col("m"))).alias("a"), F.min(F.when(F.expr("c1 <> c2"), F.col("m"))).alias("b"))
    return d.agg(F.avg(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))


def _local(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of a bounded sample and distances to the own centroid, from a random start until no assignment changes."""
    t, labels, shift, seen = x.shape[1], rng.integers(0, k, len(x)), np.zeros(len(x), int), set()
    while True:
        rolled = x[np.arange(len(x))[:, None], (np.arange(t)[None, :] - shift[:, None]) % t]
        n = np.sqrt((rolled * rolled).sum(1, keepdims=True))
        u = np.divide(rolled, n, out=np.zeros_like(rolled), where=n > 0)
        c = top_eigenvectors(np.stack([u[labels == i].T @ u[labels == i] for i in range(k)]))
        new, shift, dist = nearest(x, c)
        if (new == labels).all() or new.tobytes() in seen:
            return new, dist[np.arange(len(x)), new]
        seen.add(new.tobytes())
        labels = new


def sweep(series: DataFrame, ks: list[int] = list(range(2, 16)), samples: int = 5, size: int = 200, repeats: int = 5, seed: int = 0) -> DataFrame:  # noqa: B006
    """(k, metric, mean, half, n): quality of ``samples`` * ``repeats`` clusterings of ``size`` series for each k, with confidence intervals.

    Sampling is the feature: a sample is the ``size`` series of the least hash, bounded, so each (sample, k) is one task,
    which computes its pair distances once for all repeats.
    """
    s = series.select("series_id", "x")
    every = None
    for i in range(samples):
        one = s.orderBy(F.xxhash64("series_id", F.lit(seed + i)), "series_id").limit(size).select(F.lit(i).alias("sample"), "series_id", "x")
        every = one if every is None else every.unionByName(one)
    packed = every.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("series_id", "x"))).alias("s"))
    jobs = packed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).repartition(samples * len(ks), "sample", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, k, sample = _matrix(b.column("s")[r].values.field("x")), b.column("k")[r].as_py(), b.column("sample")[r].as_py()
                d, _ = rolling(x, x)
                np.fill_diagonal(d, 0.0)
                rows = []
                for n in range(repeats):
                    labels, dist = _local(x, k, np.random.default_rng([seed, sample, k, n]))
                    same = labels[:, None] == labels[None, :]
                    intra, inter = d[same], d[~same]
                    cv = lambda v: v.std() / v.mean() if len(v) and v.mean() else np.nan
                    beta = cv(inter) / cv(intra) if cv(intra) else np.nan
                    rows += [("intra", intra.mean()), ("inter", inter.mean() if len(inter) else np.nan), ("beta_cv", beta), ("cost", (dist * dist).mean())]
                rows = [(m, float(v)) for m, v in rows if np.isfinite(v)]
                yield pa.record_batch([pa.array([k] * len(rows), pa.int32()), pa.array([m for m, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.float64())], ["k", "metric", "v"])

    runs = jobs.select("sample", "k", "s").mapInArrow(run, "k int, metric string, v double").withColumn("g", F.struct("k", "metric"))
    return evaluation.confidence(runs, "v", "g").select("g.k", "g.metric", "mean", "half", "n")
