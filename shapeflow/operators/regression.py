"""Relative-error and ordinary least squares from aggregated normal equations.

Only sums of products leave the executors (features squared, a class); the small systems are
solved on the driver by pseudo-inverse, so rank deficiency is no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.operators import evaluation
from shapeflow.operators.clustering import _matrix, chunked, sum_arrays


def errors(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Mean absolute error, mean relative squared error mean((p / y - 1)^2) over y <> 0, MSE and R^2."""
    a, b = F.col(y), F.col(p)
    g = df.agg(
        F.avg(F.abs(a - b)).alias("mae"), F.avg(F.pow(F.try_divide(b, a) - 1, 2)).alias("mrse"), F.avg((a - b) * (a - b)).alias("mse"), F.var_pop(a).alias("var"),
    )
    return g.select("mae", "mrse", "mse", (1 - F.try_divide("mse", "var")).alias("r2"))


def normal_equations(df: DataFrame, features: list[str], target: str, weight: str = "1D", group: str | None = None) -> dict:
    """{group: (G, b, n)} with G = sum(w f f'), b = sum(w f y); one aggregation for all groups."""
    f = [F.col(c).cast("double") for c in features]
    w, y = F.expr(weight), F.col(target).cast("double")
    sums = [F.sum(w * f[i] * f[j]).alias(f"g{i}_{j}") for i in range(len(f)) for j in range(i, len(f))] + [F.sum(w * x * y).alias(f"b{i}") for i, x in enumerate(f)]
    key = [F.col(group).alias("_k")] if group else [F.lit(0).alias("_k")]
    out = {}
    for r in df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(f))] for i in range(len(f))])
        out[r["_k"]] = (g, np.array([r[f"b{i}"] or 0.0 for i in range(len(f))]), r["n"])
    return out


def solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(g, hermitian=True) @ b


def linear(features: list[str], coef: np.ndarray):
    out = F.lit(0.0)
    for c, v in zip(features, coef, strict=True):
        out = out + F.col(c) * float(v)
    return out


def relative_fit(df: DataFrame, features: list[str], y: str = "y", group: str | None = None, intercept: bool = False) -> dict:
    """{group: coefficients} minimising the mean relative squared error: least squares of f / y on 1, i.e. weights 1 / y^2. Rows with y = 0 take no part."""
    d = df.where(F.col(y) != 0)
    if intercept:
        d, features = d.withColumn("_one", F.lit(1.0)), [*features, "_one"]
    return {k: solve(g, b) for k, (g, b, _) in normal_equations(d, features, y, f"1D / (`{y}` * `{y}`)", group).items()}


def routed(df: DataFrame, features: list[str], models: dict, by: str, default: float = 0.0) -> DataFrame:
    """Adds p: the prediction of the model of the row's class; a class without model gets ``default``. The models are a literal: one small row a class."""
    p = F.lit(default)
    for k, coef in models.items():
        p = F.when(F.col(by) == F.lit(k), linear(features, coef)).otherwise(p)
    return df.withColumn("p", p)


def multiclass(df: DataFrame, features: list[str], label: str, y: str, classifier) -> tuple[object, dict]:
    """A classifier (``fit(df, features, label)`` giving ``transform(df) -> prediction``) and one relative regression a class."""
    return classifier.fit(df, features, label), relative_fit(df, features, y, label)


def multiclass_predict(df: DataFrame, features: list[str], model: tuple[object, dict], return_class: bool = False) -> DataFrame:
    d = routed(model[0].transform(df), features, model[1], "prediction")
    return d if return_class else d.drop("prediction")


def loo_fit(df: DataFrame, features: list[str], y: str) -> tuple[np.ndarray, DataFrame]:
    """Ordinary least squares, and ``df`` with p and loo: the squared leave-one-out error (residual / (1 - h))^2, h = f' G+ f."""
    g, b, _ = normal_equations(df, features, y)[0]
    inv = np.linalg.pinv(g, hermitian=True)
    coef = inv @ b
    h = F.lit(0.0)
    for i, a in enumerate(features):
        h = h + F.col(a) * linear(features, inv[i])
    d = df.withColumn("p", linear(features, coef))
    return coef, d.withColumn("loo", F.pow(F.try_divide(F.col(y) - F.col("p"), 1 - h), 2))


def prefix_errors(series: DataFrame, group: str | None = None) -> DataFrame:
    """For each number of points tr: predicting a series' total from its first tr points, relative form: (series_id, tr, p, loo).

    One Gram matrix a group over all points; every tr takes its leading block.
    """
    t = series.select(F.max(F.size("x"))).first()[0] or 0
    s = series.select("series_id", "x", (F.col(group) if group else F.lit(0)).cast("int").alias("g")).where("aggregate(x, 0D, (a, v) -> a + v) <> 0")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, g = _matrix(b.column("x")), b.column("g").to_numpy()
                z = np.hstack([x / x.sum(1, keepdims=True), np.ones((len(x), 1))])
                for k in np.unique(g):
                    held[int(k)] = held.get(int(k), 0) + z[g == k].T @ z[g == k]
        yield from chunked(list(held), [m.ravel() for m in held.values()], "g")

    models = {}
    for k, m in sum_arrays(s.mapInArrow(gram, "g int, chunk int, v array<double>"), "g").items():
        m = m.reshape(t + 1, t + 1)
        models[k] = [(inv, inv @ m[:n, t]) for n in range(1, t + 1) for inv in [np.linalg.pinv(m[:n, :n], hermitian=True)]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, g, ids = _matrix(b.column("x")), b.column("g").to_numpy(), b.column("series_id").to_numpy()
            y = x.sum(1, keepdims=True)
            for k in np.unique(g):
                own = g == k
                for n, (inv, coef) in enumerate(models[int(k)], 1):
                    z = x[own, :n] / y[own]
                    h = np.einsum("ij,jk,ik->i", z, inv, z)
                    rest = 1 - z @ coef
                    loo = np.where(h < 1 - 1e-9, (rest / np.maximum(1 - h, 1e-9)) ** 2, 0.0)
                    yield pa.record_batch([pa.array(ids[own]), pa.array(np.full(own.sum(), n, np.int32)), pa.array((x[own, :n] @ coef)), pa.array(loo)], ["series_id", "tr", "p", "loo"])

    return s.mapInArrow(judge, "series_id long, tr int, p double, loo double")


def prefix_report(series: DataFrame, cls: str, best_by: str) -> DataFrame:
    """(model, class, mean, half, n): leave-one-out errors at each series' own reference day (tr = ``best_by``), of the model of all series and of the models of the classes; for the latter also class by class."""
    own = series.select("series_id", F.col(cls).cast("int").alias("class"), F.col(best_by).cast("int").alias("tr"))
    of = lambda group: prefix_errors(series, group).join(own, ["series_id", "tr"])
    every, by = of(None).select(F.lit("global").alias("model"), F.lit(None).cast("int").alias("class"), "loo"), of(cls)
    rows = every.unionByName(by.select(F.lit("class").alias("model"), F.lit(None).cast("int").alias("class"), "loo")).unionByName(by.select(F.lit("class").alias("model"), "class", "loo"))
    return evaluation.confidence(rows.withColumn("g", F.struct("model", "class")), "loo", "g").select("g.model", "g.class", "mean", "half", "n")
