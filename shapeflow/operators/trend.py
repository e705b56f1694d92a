"""Early trend prediction: a series' first points against windows of reference series.

The score of a label is the sum over its references of exp(-gamma * d), d the least rolling
distance of the prefix to any window of the reference. ``curves`` takes a bounded set of
references (centroids) along to every task; ``scores_against`` takes any number of references as
a table, dealt in blocks: sums over blocks of references are partial sums of the same aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.functions import series as S
from shapeflow.functions.kernels import to_references
from shapeflow.operators.clustering import _classes, _matrix, _meeting, _members, _packed, _round

#: References that :func:`curves` carries along, at most.
MOST_REFERENCES = 10_000
#: Prefixes, and numbers in their products with windows, that are taken at once.
PREFIXES, PRODUCTS = 128, 1 << 18


def fit(refs: DataFrame, label: str = "label") -> tuple[list, np.ndarray, np.ndarray]:
    """Collects a bounded set of references: sorted labels, dense label index and matrix."""
    rows = refs.select(label, "x").limit(MOST_REFERENCES + 1).collect()
    if len(rows) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references: use scores_against")
    labels = sorted({r[0] for r in rows})
    return labels, np.array([labels.index(r[0]) for r in rows], int), np.array([r["x"] for r in rows], float)


def _kinds_of_windows(refs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The different windows of ``n`` points, rotations being the same, and which one each reference has at each place; None unless they are whole numbers and few."""
    if not 0 < n <= refs.shape[1] or not len(refs) or (refs < 0).any() or (refs != np.rint(refs)).any() or (refs.max() + 1.0) ** n >= 2.0**62:
        return None
    wins = np.lib.stride_tricks.sliding_window_view(refs.astype(np.int64), n, 1)
    base = int(refs.max()) + 1
    key = least = wins @ base ** np.arange(n - 1, -1, -1, dtype=np.int64)
    for i in range(n - 1):
        key = (key - wins[..., i] * base ** (n - 1)) * base + wins[..., i]
        least = np.minimum(least, key)
    kinds, at = np.unique(least, return_inverse=True)
    if len(kinds) * 4 > least.size:
        return None
    return (kinds[:, None] // base ** np.arange(n - 1, -1, -1, dtype=np.int64) % base).astype(float), at.reshape(least.shape)


def _tiled(prefix: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """:func:`to_references` by tiles that stay in a core's cache; windows of which there are few kinds are compared once a kind."""
    out, few = np.empty((len(prefix), len(refs))), _kinds_of_windows(refs, prefix.shape[1])
    if few:
        rows, wins, at = PRODUCTS // PREFIXES, *few
        for i in range(0, len(prefix), PREFIXES):
            d = np.concatenate([to_references(prefix[i : i + PREFIXES], wins[j : j + rows]).T for j in range(0, len(wins), rows)])
            for j in range(0, len(refs), rows):
                least = d[at[j : j + rows, 0]]
                for k in range(1, at.shape[1]):
                    np.minimum(least, d[at[j : j + rows, k]], out=least)
                out[i : i + PREFIXES, j : j + rows] = least.T
        return out
    rows = max(1, PRODUCTS // (PREFIXES * max(1, refs.shape[1] - prefix.shape[1] + 1)))
    for i in range(0, len(prefix), PREFIXES):
        for j in range(0, len(refs), rows):
            out[i : i + PREFIXES, j : j + rows] = to_references(prefix[i : i + PREFIXES], refs[j : j + rows])
    return out


def distances(series: DataFrame, refs: DataFrame, num_pts: int, digits: int | None = None, block: int = 1024) -> DataFrame:
    """(series_id, ref_id, dist) of prefixes to references (ref_id, x), block against block; equal prefixes and equal references meet once."""
    own = _classes(series.select("series_id", F.slice("x", 1, num_pts).alias("x")))
    other = _classes(refs.select(F.col("ref_id").alias("series_id"), "x"))
    n, m = (max(1, -(-d.count() // block)) for d in (own, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s, s2 = batch.column("s")[r].values, batch.column("s2")[r].values
                p, x = (_matrix(v.field("x")) if num_pts else np.zeros((len(v), 0)) for v in (s, s2))
                yield from _members(s.field("ids"), s2.field("ids"), _round(_tiled(p, x), digits), ["series_id", "ref_id", "dist"])

    columns = ("series_id", "x", "ids")
    return _meeting(_packed(own, n, *columns), n, _packed(other, m, *columns), m).mapInArrow(run, "series_id long, ref_id long, dist double")


def curves(series: DataFrame, model: tuple[list, np.ndarray, np.ndarray], num_pts: list[int], gamma: float = 1.0) -> DataFrame:
    """(series_id, num_pts, label, score, p) for every label and number of points, in one pass."""
    labels, index, refs = model
    rows = max(1, min(10_000, (1 << 24) // max(refs.size, 1)))  # distances of a slice to all windows stay within 16M numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, n in [(at, n) for at in range(0, batch.num_rows, rows) for n in num_pts]:
                part = batch.slice(at, rows)
                x, ids = _matrix(part.column("x")), part.column("series_id").to_numpy()
                e = np.exp(-gamma * to_references(x[:, :n], refs))
                score = np.stack([e[:, index == k].sum(1) for k in range(len(labels))], 1)
                p = score / score.sum(1, keepdims=True)
                k = len(labels)
                yield pa.record_batch(
                    [pa.array(np.repeat(ids, k)), pa.array(np.full(len(ids) * k, n, np.int32)), pa.array(np.tile(np.array(labels, np.int32), len(ids))), pa.array(score.ravel()), pa.array(p.ravel())],
                    ["series_id", "num_pts", "label", "score", "p"],
                )

    return series.select("series_id", "x").mapInArrow(run, "series_id long, num_pts int, label int, score double, p double")


def scores_against(series: DataFrame, refs: DataFrame, num_pts: int | list[int], gamma: float = 1.0, block: int = 512) -> DataFrame:
    """(series_id, num_pts, label, score) with all rows of ``refs`` ([ref_id,] label, x) as references, ``block`` series against 16 times as many references, for one or several numbers of points.

    Equal series are one and equal references of a label one reference that counts as often as it
    occurs; equal prefixes of a block's series are taken once. A series travels once for all numbers of
    points, and once a block of references, of which each task sums the scores.
    """
    points = [num_pts] if isinstance(num_pts, int) else list(num_pts)
    r = refs.groupBy("label", "x").agg(F.count(F.lit(1)).cast("double").alias("times"))
    r = r.withColumn("series_id", F.xxhash64("label", "x"))
    own = series.select("series_id", F.slice("x", 1, max(points)).alias("x"))
    q = own.groupBy("x").agg(F.min("series_id").alias("series_id"))
    nq, nr = max(1, -(-q.count() // block)), max(1, -(-r.count() // (16 * block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, ref = batch.column("s")[i].values, batch.column("s2")[i].values
                ids, x = own.field("series_id").to_numpy(), _matrix(own.field("x")) if max(points) else np.zeros((len(own), 0))
                other, (kinds, of) = _matrix(ref.field("x")), np.unique(ref.field("label").to_numpy(), return_inverse=True)
                times = np.zeros((len(ref), len(kinds)))
                times[np.arange(len(ref)), of] = ref.field("times").to_numpy()
                for n in points:
                    p, back = np.unique(x[:, :n], axis=0, return_inverse=True) if n and x.shape[1] else (x[:1, :n], np.zeros(len(x), int))
                    part = (np.exp(-gamma * _tiled(p, other)) @ times)[back.ravel()]
                    cols = [np.repeat(ids, len(kinds)), np.full(part.size, n, np.int32), np.tile(kinds, len(ids)).astype(np.int32), part.ravel()]
                    yield pa.record_batch([pa.array(c) for c in cols], ["series_id", "num_pts", "label", "score"])

    both = _meeting(_packed(q, nq, "series_id", "x"), nq, _packed(r, nr, "series_id", "label", "x", "times"), nr)
    parts = both.mapInArrow(run, "series_id long, num_pts int, label int, score double")
    scores = parts.groupBy("series_id", "num_pts", "label").agg(F.sum("score").alias("score")).withColumnRenamed("series_id", "rep")
    of = own.join(q.withColumnRenamed("series_id", "rep"), "x").select("series_id", "rep")
    return of.join(scores, "rep").select("series_id", "num_pts", "label", "score")


def curves_against(series: DataFrame, refs: DataFrame, num_pts: list[int], gamma: float = 1.0, block: int = 512) -> DataFrame:
    """As :func:`curves`, with any number of references."""
    s = scores_against(series, refs, num_pts, gamma, block)
    return s.withColumn("p", F.col("score") / F.sum("score").over(Window.partitionBy("series_id", "num_pts")))


def predict(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The label of the largest rounded score (the least of equals), its dense index and probability."""
    keys = by or ["series_id"]
    g = scores.withColumn("index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("label")) - 1).groupBy(*keys).agg(
        F.max(F.struct(F.round("score", 6).alias("s"), (-F.col("label")).alias("l"), "index", F.col("score").alias("raw"))).alias("best"), F.sum("score").alias("total")
    )
    return g.select(*keys, (-F.col("best.l")).alias("label"), F.col("best.index").alias("index"), (F.col("best.raw") / F.col("total")).alias("p"))


def judged(curve: DataFrame, truth: DataFrame) -> DataFrame:
    """(series_id, num_pts, y, label, p, p_true): predicted and true label with their probabilities."""
    g = curve.join(truth.select("series_id", "y"), "series_id").groupBy("series_id", "num_pts", "y").agg(
        F.max(F.struct(F.round("p", 6).alias("s"), (-F.col("label")).alias("l"), F.col("p").alias("raw"))).alias("best"), F.max(F.when(F.expr("label = y"), F.col("p"))).alias("p_true")
    )
    return g.select("series_id", "num_pts", "y", (-F.col("best.l")).alias("label"), F.col("best.raw").alias("p"), "p_true")


def best_by(judgements: DataFrame, k: int) -> DataFrame:
    """For each series the fewest points with a right prediction and p_true > 1/k, and p_true there; null if none."""
    ok = F.when(F.expr(f"label = y and p_true > 1D / {k}"), F.struct("num_pts", "p_true"))
    return judgements.groupBy("series_id").agg(F.min(ok).alias("b")).select("series_id", F.col("b.num_pts").alias("best_by"), F.col("b.p_true").alias("conf"))


def f1_by_class(judgements: DataFrame, labels: list[int]) -> DataFrame:
    """(num_pts, k, f1) from conditional counts in one aggregation."""
    one = [
        F.struct(F.lit(k).alias("k"), F.coalesce(F.try_divide(2.0 * F.count(F.when(F.expr(f"label = {k} and y = {k}"), 1)), (F.count(F.when(F.col("label") == k, 1)) + F.count(F.when(F.col("y") == k, 1))).cast("double")), F.lit(0.0)).alias("f1"))
        for k in labels
    ]
    return judgements.groupBy("num_pts").agg(F.array(*one).alias("a")).select("num_pts", F.explode("a").alias("a")).select("num_pts", "a.k", "a.f1")


def thresholds(judgements: DataFrame, labels: list[int], target: float, most: int, corrected: bool = False) -> DataFrame:
    """(k, min_pts, theta): the first n in [2, most) whose F1 reaches the target; theta is the class's mean p_true at n + 1 points (at n if ``corrected``); without such n: 0 and 1/len(labels)."""
    first = f1_by_class(judgements, labels).where((F.col("num_pts") >= 2) & (F.col("num_pts") < most) & (F.round("f1", 6) >= target)).groupBy("k").agg(F.min("num_pts").alias("min_pts"))
    mean = judgements.groupBy(F.col("y").alias("k"), "num_pts").agg(F.avg("p_true").alias("theta"))
    hit = first.join(mean.withColumn("min_pts", F.col("num_pts") - (0 if corrected else 1)).drop("num_pts"), ["k", "min_pts"])
    every = judgements.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in labels])).alias("k"))
    return every.join(hit, "k", "left").select("k", F.coalesce("min_pts", F.lit(0)).alias("min_pts"), F.coalesce("theta", F.lit(1.0 / len(labels))).alias("theta"))


def decide(curve: DataFrame, limits: DataFrame) -> DataFrame:
    """(series_id, label, best_by, p): the first n at which the top label's p exceeds its theta and n >= min_pts; nulls if never."""
    top = curve.groupBy("series_id", "num_pts").agg(F.max(F.struct(F.round("p", 6).alias("s"), (-F.col("label")).alias("l"), F.col("p").alias("raw"))).alias("t"))
    top = top.select("series_id", "num_pts", (-F.col("t.l")).alias("k"), F.col("t.raw").alias("p")).join(F.broadcast(limits), "k")
    ok = F.when(F.expr("round(p, 6) > round(theta, 6) and num_pts >= min_pts"), F.struct("num_pts", "k", "p"))
    return top.groupBy("series_id").agg(F.min(ok).alias("d")).select("series_id", F.col("d.k").alias("label"), F.col("d.num_pts").alias("best_by"), F.col("d.p").alias("p"))


def decision_report(decisions: DataFrame, series: DataFrame, truth: DataFrame) -> DataFrame:
    """(which, n, and quantiles .25/.5/.75 of peak - best_by - 1 and of the share of views that remain) for all, correct and incorrect decisions; undecided series are left out."""
    d = decisions.where("best_by is not null").join(series.select("series_id", "x"), "series_id").join(truth.select("series_id", "y"), "series_id")
    d = d.select(
        F.explode(F.array(F.lit("all"), F.when(F.expr("label = y"), F.lit("correct")).otherwise(F.lit("incorrect")))).alias("which"),
        (F.expr(S.argmax("x")) - F.col("best_by") - 1).cast("double").alias("peak"),
        F.coalesce(F.try_divide(F.expr(S.total("slice(x, best_by + 1, size(x))")), F.expr(S.total("x"))), F.lit(0.0)).alias("left"),
    )
    g = d.groupBy("which").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("peak")).alias("peak"), F.sort_array(F.collect_list("left")).alias("left"))
    once = "transform(array({}), a -> {})[0]"  # the list is sorted once a quantile, not once for each place that names it
    return g.select("which", "n", *[F.expr(once.format(c, S.mquantile("a", p))).alias(f"{c}_{int(p * 100)}") for c in ("peak", "left") for p in (0.25, 0.5, 0.75)])
