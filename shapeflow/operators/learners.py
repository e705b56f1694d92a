"""Learners by name, exact k-NN, grid search and importances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators import evaluation, regression
from shapeflow.operators.clustering import _matrix

#: Penalties C of the grids (fixed values); regParam is 1 / (C * rows).
GRID_C = [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 1e2, 1e3, 1e4]


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def learner(name: str, label: str = "label", seed: int = 0):
    """An unfitted estimator on (features, label). Trees are forests without bootstrap; RBF machines are linear ones on :func:`fourier_features`."""
    forest = dict(labelCol=label, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed)
    made = {
        "lr": lambda: LogisticRegression(labelCol=label, standardization=False, maxIter=50),
        "linear_svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=30), labelCol=label),
        "extra_trees": lambda: RandomForestClassifier(numTrees=20, impurity="gini", **forest),
        "extra_trees_100": lambda: RandomForestClassifier(numTrees=100, impurity="entropy", **forest),
        "extra_trees_entropy": lambda: RandomForestClassifier(numTrees=30, impurity="entropy", **forest),
        "extra_trees_shallow": lambda: RandomForestClassifier(numTrees=30, impurity="entropy", maxDepth=4, **forest),
        "extra_trees_regression": lambda: RandomForestRegressor(numTrees=20, **forest),
        "linear_regression": lambda: LinearRegression(labelCol=label),
        "huber_regression": lambda: LinearRegression(labelCol=label, loss="huber"),
    }
    if name not in made:
        raise ValueError(f"unknown learner {name}; known: {', '.join(made)}")
    return made[name]()


def _waves(dims: int, gamma: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of :func:`fourier_features`."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (n, dims)), rng.uniform(0, 2 * np.pi, n)


def fourier_features(df: DataFrame, x: str, dims: int, gamma: float = 1.0, n: int = 64, seed: int = 0) -> DataFrame:
    """Adds features: random Fourier features of the array ``x``, whose inner products approximate exp(-gamma * |x - y|^2)."""
    w, b = _waves(dims, gamma, n, seed)
    rows = ",".join("array(" + ",".join(f"{v!r}D" for v in map(float, (*r, c))) + ")" for r, c in zip(w, b, strict=True))
    wave = f"transform(array({rows}), r -> {float(np.sqrt(2 / n))!r}D * cos(aggregate(zip_with({x}, slice(r, 1, {dims}), (p, q) -> p * q), 0D, (s, v) -> s + v) + r[{dims}]))"
    return df.withColumn("features", array_to_vector(F.expr(wave)))


#: Least rows of a split tried in grids (fixed values).
GRID_SPLIT = [1, 2, 4, 8, 16, 32, 64, 128]
#: gamma of the grids of RBF machines (fixed values).
GRID_GAMMA = [1e-3, 1e-2, 1e-1, 1.0, 1e2, 1e3]


def grid_search(df: DataFrame, name: str = "lr", label: str = "label", folds: int = 3, values: list[float] | None = None, seed: int = 0):
    """Cross-validated over the learner's grid, refitted on all rows: the fitted model and the mean metric of each value.

    Penalties for linear learners, least rows of a split for trees; ``values``: instead of the whole grid.
    """
    est, n = learner(name, label, seed), df.count()
    regression = "regression" in name
    penalties = [1 / (c * max(n, 1)) for c in (values or GRID_C)]
    if name.startswith("extra_trees"):
        grid = [{est.minInstancesPerNode: int(v)} for v in (values or GRID_SPLIT)]
    elif name == "linear_svm":
        grid = [{est.classifier: LinearSVC(maxIter=30, regParam=v)} for v in penalties]
    else:
        grid = [{est.regParam: v} for v in penalties]
    judge = RegressionEvaluator(labelCol=label, metricName="rmse") if regression else MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    fitted = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=4, seed=seed).fit(df)
    return fitted.bestModel, fitted.avgMetrics


#: Numbers in rows of x up to which each fit of :func:`rbf_scores` is one task over all rows (64 MB).
TOGETHER = 1 << 23


def hinge(x: np.ndarray, y: np.ndarray, reg: float, iterations: int = 60, memory: int = 10) -> np.ndarray:
    """Linear machines of least mean hinge loss plus reg / 2 |w|^2 over scaled features: one column of weights, the intercept last, for each column of y (-1 or 1). All columns descend at once (L-BFGS)."""
    std = x.std(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    scale = np.divide(1, std, out=np.zeros_like(std), where=std > 0)
    xb = np.column_stack([x * scale, np.ones(len(x))])

    def loss(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = 1 - y * (xb @ w)
        g = xb.T @ np.where(m > 0, -y, 0) / len(x)
        g[:-1] += reg * w[:-1]
        return np.maximum(m, 0).mean(0) + reg / 2 * (w[:-1] ** 2).sum(0), g

    w = np.zeros((xb.shape[1], y.shape[1]))
    (f, g), past = loss(w), []
    for i in range(iterations):
        d, kept = -g, []
        for s, v, r in reversed(past):
            kept.append(r * (s * d).sum(0))
            d = d - kept[-1] * v
        if past:
            s, v, r = past[-1]
            d = d * np.where(r > 0, (s * v).sum(0) / np.maximum((v * v).sum(0), 1e-300), 1)
        for s, v, r in past:
            d = d + s * (kept.pop() - r * (v * d).sum(0))
        slope = (d * g).sum(0)
        d = np.where(slope < 0, d, -g)
        slope = (d * g).sum(0)
        step = np.ones(len(f)) if i else 0.5 / np.maximum(np.sqrt((g * g).sum(0)), 1e-12)
        for _ in range(20):
            f2, g2 = loss(w + step * d)
            ok = f2 <= f + 1e-4 * step * slope
            if ok.all():
                break
            step = np.where(ok, step, step / 2)
        s, v = np.where(ok, step, 0) * d, np.where(ok, g2 - g, 0)
        sv = (s * v).sum(0)
        past = [*past, (s, v, np.divide(1, sv, out=np.zeros_like(sv), where=sv > 1e-12))][-memory:]
        done = np.abs(np.where(ok, f - f2, 0)) <= 1e-6 * np.maximum(np.abs(f), 1e-6)
        w, f, g = w + s, np.where(ok, f2, f), np.where(ok, g2, g)
        if i and done.all():
            break
    return np.vstack([w[:-1] * scale[:, None], w[-1:]])


def _weighted_f1(y: np.ndarray, p: np.ndarray) -> float:
    kinds, n = np.unique(y, return_counts=True)
    f1 = [2 * ((y == k) & (p == k)).sum() / ((y == k).sum() + (p == k).sum()) for k in kinds]
    return float((n * f1).sum() / n.sum())


def rbf_scores(df: DataFrame, x: str, dims: int, label: str = "label", gammas: list[float] | None = None, penalties: list[float] | None = None, folds: int = 3, seed: int = 0, n: int = 64) -> list[tuple[float, float, float]] | None:
    """(gamma, C, mean weighted F1 over the folds) of RBF classifiers, a task for each fit; None if the table has more than ``TOGETHER`` numbers. Folds go by a hash of the row."""
    rows = df.count()
    if rows * dims > TOGETHER or not rows:
        return None
    t = df.select(F.col(x).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(x, label, F.lit(seed)).alias("h")).toArrow().sort_by("h")
    sent = df.sparkSession.sparkContext.broadcast((_matrix(t.column("x").combine_chunks()), t.column("y").to_numpy(), t.column("h").to_numpy() % folds))
    jobs = [(g, c, k) for g in gammas or GRID_GAMMA for c in penalties or GRID_C for k in range(folds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, y, fold = sent.value
        kinds = np.unique(y)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                g, c, k = jobs[i]
                w, b = _waves(dims, g, n, seed)
                d, own = np.sqrt(2 / n) * np.cos(raw @ w.T + b), fold == k
                score = 0.0
                if own.any() and not own.all():
                    m = hinge(d[~own], np.where(y[~own, None] == kinds, 1.0, -1.0), 1 / (c * rows))
                    score = _weighted_f1(y[own], kinds[(d[own] @ m[:-1] + m[-1]).argmax(1)])
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([score], pa.float64())], ["id", "score"])

    got = dict(map(tuple, df.sparkSession.range(len(jobs), numPartitions=len(jobs)).mapInArrow(run, "id long, score double").collect()))
    sent.unpersist()
    return [(float(jobs[i][0]), float(jobs[i][1]), sum(got[i + k] for k in range(folds)) / folds) for i in range(0, len(jobs), folds)]


def rbf_grid(df: DataFrame, x: str, dims: int, label: str = "label", gammas: list[float] | None = None, penalties: list[float] | None = None, folds: int = 3, seed: int = 0) -> list[tuple[float, float, float]]:
    """(gamma, C, metric) of RBF classifiers over gamma and C, without a model."""
    few = rbf_scores(df, x, dims, label, gammas, penalties, folds, seed)
    return few if few is not None else rbf_grid_search(df, x, dims, label, False, gammas, penalties, folds, seed)[2]


def rbf_grid_search(df: DataFrame, x: str, dims: int, label: str = "label", regression: bool = False, gammas: list[float] | None = None, penalties: list[float] | None = None, folds: int = 3, seed: int = 0):
    """RBF machine over gamma and C: (model, gamma, table of (gamma, C, metric)); the features of each gamma are made once."""
    name, rows, best = "huber_regression" if regression else "linear_svm", [], None
    for g in gammas or GRID_GAMMA:
        d = fourier_features(df, x, dims, g, seed=seed).select("features", label).persist()
        model, scores = grid_search(d, name, label, folds, penalties, seed)
        rows += [(g, c, float(s)) for c, s in zip(penalties or GRID_C, scores, strict=True)]
        top = min(scores) if regression else -max(scores)
        if best is None or top < best[0]:
            best = (top, model, g)
        d.unpersist()
    return best[1], best[2], rows


def compare(df: DataFrame, names: list[str], label: str = "label", fold: str = "fold") -> DataFrame:
    """(learner, mean, half, n): weighted F1 of each learner over the folds, with confidence intervals."""
    spark, rows = df.sparkSession, []
    for name in names:
        p = cross_val(df, name, label, fold)
        by = evaluation.report_by(p.select(fold, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")), fold)
        rows.append(by.groupBy(fold).agg(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1")).select(F.lit(name).alias("learner"), "f1"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return evaluation.confidence(out, "f1", "learner")


def experiment(df: DataFrame, label: str, y: str, fold: str = "fold", classifier: str = "lr", regressor: str = "linear_regression", values: list[float] | None = None, test_folds: list[int] | None = None) -> DataFrame:
    """Classification and regression on the same folds, both by grid search: (fold, metric, class, v).

    Per fold: precision, recall and f1 of each class, micro and macro F1, R^2, MSE and mean
    relative squared error. ``test_folds``: those that are tested; one of two gives a holdout.
    """
    out = None
    for k in test_folds if test_folds is not None else sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        clf, rgr = grid_search(train, classifier, label, values=values)[0], grid_search(train, regressor, y, values=values)[0]
        rep = evaluation.report(clf.transform(test).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")))
        parts = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("label").alias("class"), F.col(m).alias("v")) for m in ("precision", "recall", "f1")]))
        err = regression.errors(rgr.transform(test).select(F.col(y).alias("y"), F.col("prediction").alias("p")))
        errs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("class"), F.col(m).alias("v")) for m in ("r2", "mse", "mrse")]))
        one = rep.select(parts.alias("m")).unionByName(err.select(errs.alias("m"))).select(F.lit(k).alias("fold"), "m.*")
        out = one if out is None else out.unionByName(one)
    return out


def experiment_summary(results: DataFrame) -> DataFrame:
    """(metric, class, mean, half, n) over the folds."""
    return evaluation.confidence(results.withColumn("g", F.struct("metric", "class")), "v", "g").select("g.metric", "g.class", "mean", "half", "n")


def cross_val(df: DataFrame, name: str, label: str = "label", fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions: one fit a fold."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        m = learner(name, label).fit(df.where(F.col(fold) != k))
        p = m.transform(df.where(F.col(fold) == k)).select(*df.columns, "prediction")
        out = p if out is None else out.unionByName(p)
    return out


def importances(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, importance) of shallow entropy trees, most important first."""
    m = learner("extra_trees_shallow", label).fit(assemble(df, features))
    rows = sorted(zip(features, (float(v) for v in m.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


#: Queries of :func:`knn` that are broadcast at most.
QUERY_ROWS = 20_000


def knn(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Exact k nearest neighbours of a stated query set (id, x) among (id, x, label): (id, label), the mode of the k nearest, least label of equals.

    A query set of at most QUERY_ROWS is broadcast; a larger one meets ``train`` in blocks of that
    many, each a shuffled join. Each task keeps k candidates a query before the next shuffle.
    """
    q = queries.select(F.col(id_col).alias("qid"), F.col("x").alias("q"))
    if (n := q.count()) <= QUERY_ROWS:
        both = train.join(F.broadcast(q), F.col(id_col) != F.col("qid"))
    else:
        blocks = -(-n // QUERY_ROWS)
        spread = train.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
        own = q.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = spread.join(own, ["_b", "_s"]).where(F.col(id_col) != F.col("qid"))
    d = both.select("qid", F.col(id_col).alias("nid"), "label", F.round(F.expr("aggregate(zip_with(x, q, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)"), 9).alias("d"))
    n = d.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "nid"))).where(F.col("r") <= k)
    votes = n.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("qid").agg((-F.max(F.struct("v", (-F.col("label")).alias("l")))["l"]).alias("label")).withColumnRenamed("qid", id_col)


def pipeline(features: list[str], name: str, label: str = "label") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), learner(name, label)])
