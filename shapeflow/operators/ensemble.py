"""Boosting, co-training and stacking on top of class probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators import learners
from shapeflow.operators.regression import normal_equations, solve


class StackingError(ValueError):
    """An unknown stacker."""


#: Groups of rows that multinomial counts are drawn in.
DRAW_BUCKETS = 1024


def sample_weights(df: DataFrame, weight: str, n: int, seed: int = 0, id_col: str = "series_id") -> DataFrame:
    """``n`` rows drawn with replacement by weight: adds times, the multinomial count of a row, and repeats the row as often.

    The draws are dealt to buckets of a hash of the id by the buckets' total weights, then within
    each bucket (in its own task) to the rows: together one multinomial draw of exactly n.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(DRAW_BUCKETS)).cast("int")).where(F.col(weight) > 0)
    totals = {r["_b"]: float(r["w"]) for r in d.groupBy("_b").agg(F.sum(F.col(weight).cast("double")).alias("w")).collect()}  # at most DRAW_BUCKETS rows
    if not totals:
        return df.withColumn("times", F.lit(0)).where("false")
    keys = sorted(totals)
    share = np.array([totals[k] for k in keys])
    draws = dict(zip(keys, np.random.default_rng([seed, 1]).multinomial(int(n), share / share.sum()).tolist(), strict=True))

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_w"], kind="stable")
        w = rows["_w"].to_numpy(float)
        times = np.random.default_rng([seed, 2, int(key[0])]).multinomial(draws[int(key[0])], w / w.sum())
        return pd.DataFrame({"_row": rows["_row"].to_numpy(), "times": times.astype("int32")})

    # equal rows of one id are told apart by their number
    d = d.withColumn("_row", F.concat_ws(":", F.col(id_col).cast("string"), F.row_number().over(Window.partitionBy("_b", id_col).orderBy(weight)).cast("string")))
    counts = d.select("_b", "_row", F.col(id_col).cast("string").alias("_id"), F.col(weight).cast("double").alias("_w")).groupBy("_b").applyInPandas(deal, "_row string, times int")
    return d.join(counts.where("times > 0"), "_row").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_i", "_row", "_b")


def error(df: DataFrame, y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(F.when(F.col(y) != F.col(p), w).otherwise(0.0)) / F.sum(w)).alias("error"))


def alpha(err: float, classes: int) -> float:
    err = min(max(err, 1e-6), 1 - 1e-6)
    return math.log((1 - err) / err) + math.log(classes - 1)


def reweigh(df: DataFrame, a: float, y: str = "y", p: str = "p", weight: str = "w") -> DataFrame:
    """w * exp(alpha if wrong), summing to 1."""
    d = df.withColumn("_w", F.col(weight) * F.when(F.col(y) != F.col(p), F.lit(math.exp(a))).otherwise(1.0))
    return d.join(F.broadcast(d.agg(F.sum("_w").alias("_s"))), F.lit(True)).withColumn(weight, F.col("_w") / F.col("_s")).drop("_w", "_s")


def argmax_label(c: str = "probability"):
    return F.array_position(F.col(c), F.array_max(c)) - 1


class ClassBoost:
    """Two stages: base probabilities B (array column), then a classifier on rows drawn by the base's mistakes (``sample_factor`` times as many as there are; None: weighted rows instead); the two vote with their alphas."""

    def __init__(self, name: str = "lr", weighted_error: bool = False, sample_factor: float | None = 2.5, seed: int = 0):
        self.name, self.weighted_error, self.sample_factor, self.seed = name, weighted_error, sample_factor, seed

    def fit(self, df: DataFrame, classes: int, label: str = "label", base: str = "B", id_col: str = "series_id") -> ClassBoost:
        d = df.withColumn("_p", argmax_label(base).cast("double")).withColumn("w", F.lit(1.0))
        self.classes, self.base = classes, base
        self.base_alpha = alpha(error(d, label, "_p").first()[0], classes)
        d = reweigh(d, self.base_alpha, label, "_p")
        est = learners.learner(self.name, label)
        if self.sample_factor is None:
            self.model = est.setWeightCol("w").fit(d)
        else:
            self.model = est.fit(sample_weights(d, "w", round(self.sample_factor * d.count()), self.seed, id_col))
        p = self.model.transform(d)
        self.class_alpha = alpha(error(p, label, "prediction", "w" if self.weighted_error else None).first()[0], classes)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        d = self.model.transform(df).withColumn("_c", vector_to_array("probability"))
        vote = F.zip_with(F.col(self.base), F.col("_c"), lambda b, c: self.base_alpha * b + self.class_alpha * c)
        return d.withColumn("_v", vote).withColumn("p", argmax_label("_v").cast("int")).drop("_v", "_c")


#: Numbers in features up to which the rounds of co-training go on in the driver (64 MB).
TOGETHER = 1 << 23


def _surest(p: DataFrame, classes: int, columns: tuple[str, ...], id_col: str, n: int) -> list:
    """Ids by class and column: the ``n`` surest rows of each, least id of equals. One job; a task returns its own ``n`` of each."""
    order = [("p", "descending"), ("id", "ascending")]
    best = lambda x: x.take(pc.sort_indices(x, sort_keys=order)[:n])

    def run(batches):
        held: dict[tuple[int, int], pa.Table] = {}
        for b in batches:
            for k in range(classes):
                for c in range(len(columns)):
                    x = pa.table({"id": b.column("id"), "p": b.column(f"p{k}_{c}")})
                    held[k, c] = best(pa.concat_tables([held[k, c], x]) if (k, c) in held else x)
        for (k, c), x in held.items():
            same = [pa.array([v] * len(x), pa.int32()) for v in (k, c)]
            yield from pa.table([*same, x.column("id"), x.column("p")], ["k", "c", "id", "p"]).to_batches()

    flat = p.select(F.col(id_col).alias("id"), *[F.get(c, k).cast("double").alias(f"p{k}_{i}") for k in range(classes) for i, c in enumerate(columns)])
    t = flat.mapInArrow(run, f"k int, c int, id {p.schema[id_col].dataType.simpleString()}, p double").toArrow()
    out = []
    for k in range(classes):
        for c in range(len(columns)):
            out += [(i, k) for i in best(t.filter((pc.field("k") == k) & (pc.field("c") == c)).select(["id", "p"])).column("id").to_pylist()]
    return out


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, w: np.ndarray | None = None, steps: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Coefficients (features, classes) of a multinomial logistic regression without penalty, by L-BFGS from ``w``; a column of ones in ``x`` gives intercepts."""
    w = np.zeros((x.shape[1], classes)) if w is None else w
    rows, past = np.arange(len(y)), []

    def loss(w):
        z = x @ w
        z -= z.max(1, keepdims=True)
        own = z[rows, y].mean()
        np.exp(z, out=z)
        total = z.sum(1)
        z /= total[:, None]
        z[rows, y] -= 1
        return np.log(total).mean() - own, x.T @ z / len(y)

    f, g = loss(w)
    for _ in range(steps):
        d, kept = -g, []
        for s, v in reversed(past):
            kept.append(np.vdot(s, d) / np.vdot(s, v))
            d = d - kept[-1] * v
        if past:
            d = d * (np.vdot(past[-1][0], past[-1][1]) / np.vdot(past[-1][1], past[-1][1]))
        for (s, v), a in zip(past, reversed(kept), strict=True):
            d = d + (a - np.vdot(v, d) / np.vdot(s, v)) * s
        slope, step = np.vdot(d, g), 1.0 if past else 1 / max(np.linalg.norm(g), 1e-12)
        while True:
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if f2 >= f:
            break
        s, v = step * d, g2 - g
        if np.vdot(s, v) > 1e-12:
            past = [*past[-9:], (s, v)]
        done = f - f2 <= tol * max(abs(f), abs(f2), 1e-6) or np.linalg.norm(g2) <= tol * max(np.linalg.norm(g), 1.0)
        w, f, g = w + s, f2, g2
        if done:
            break
    return w


class CoTrain:
    """Starts from a labelled fraction; each round adds, class by class, the ``per_round`` rows that the classifier and that P are surest of, until none is left (or ``rounds``). Later classes overwrite.

    Logistic regression on a table of few numbers (counted) takes its rounds in the driver, each from the last one's
    coefficients; the last model is fitted by the learner in both cases.
    """

    def __init__(self, name: str = "lr", label_fract: float = 0.25, rounds: int | None = None, seed: int = 0, per_round: int = 1):
        self.name, self.fract, self.rounds, self.seed, self.per_round = name, label_fract, rounds, seed, per_round

    def _here(self, start: DataFrame, classes: int, P: str, id_col: str) -> dict:
        """The labels that all rounds add, by id."""
        t = start.select(F.col(id_col).alias("id"), "_l", vector_to_array("features").alias("x"), F.transform(P, lambda v: v.cast("double")).alias("p")).toArrow().combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")]))
        ids = t.column("id").combine_chunks().dictionary_encode("encode")
        of, names = ids.indices.to_numpy(), ids.dictionary.to_pylist()  # in the order of the ids
        own = t.column("_l").to_numpy()
        x = np.stack(t.column("x").to_numpy(zero_copy_only=False)).astype(np.float64)
        dev = x.std(0)
        x = np.column_stack([(x - x.mean(0)) * np.divide(1, dev, out=np.zeros_like(dev), where=dev > 0), np.ones(len(x))])
        sure = np.array([[v for v in [*(r or []), *[None] * classes][:classes]] for r in t.column("p").to_pylist()], np.float64)
        np.nan_to_num(sure, copy=False, nan=-np.inf)
        n_labels, more, w, done = int(np.nanmax(own)) + 1, np.full(len(names), np.nan), None, 0

        def best(p: np.ndarray) -> np.ndarray:
            n = min(self.per_round, len(p))
            least = -np.partition(-p, n - 1)[n - 1]
            top = np.flatnonzero(p >= least)
            return top[np.argsort(-p[top], kind="stable")[:n]]  # rows are in the order of the ids

        while True:
            label = np.where(np.isnan(more[of]), own, more[of])
            left = np.flatnonzero(np.isnan(label))
            if done == self.rounds or not len(left):
                return {names[i]: float(more[i]) for i in np.flatnonzero(~np.isnan(more)).tolist()}
            known = np.flatnonzero(~np.isnan(label))
            n_labels = max(n_labels, int(label[known].max()) + 1)
            if w is not None and w.shape[1] < n_labels:
                w = None
            w = softmax_fit(x[known], label[known].astype(np.int64), n_labels, w)
            z = x[left] @ w
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            done += 1
            for k in range(classes):
                for c in (z, sure[left]):
                    more[of[left[best(c[:, k] if k < c.shape[1] else np.zeros(len(left)))]]] = k

    def fit(self, df: DataFrame, classes: int, label: str = "label", P: str = "P", id_col: str = "series_id") -> CoTrain:
        h = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(id_col, F.lit(self.seed)))) - 1
        n = F.count(F.lit(1)).over(Window.partitionBy(label))
        start = df.withColumn("_l", F.when((h == 0) | (h < n * self.fract), F.col(label).cast("double"))).persist()  # every class is covered
        size = start.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("d"), F.count_distinct("_l").alias("c")).first()
        here = self.name == "lr" and size["c"] > 1 and size["n"] * size["d"] <= TOGETHER and not start.where(F.col(id_col).isNull()).limit(1).count()
        extra = self._here(start, classes, P, id_col) if here else {}
        done = 0
        while True:
            known = start
            if extra:
                more = df.sparkSession.createDataFrame(list(extra.items()), f"{id_col} {df.schema[id_col].dataType.simpleString()}, _more double")
                known = start.join(more, id_col, "left").withColumn("_l", F.coalesce("_more", "_l")).drop("_more")
            self.model = learners.learner(self.name, "_l").fit(known.where("_l is not null"))
            left = known.where("_l is null")
            if here or done == self.rounds or left.isEmpty():
                break
            done += 1
            p = self.model.transform(left).withColumn("_c", vector_to_array("probability")).select(id_col, "_c", P)
            for i, k in _surest(p, classes, ("_c", P), id_col, self.per_round):
                extra[i] = float(k)
        start.unpersist()
        self.P = P
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        d = self.model.transform(df).withColumn("_c", vector_to_array("probability"))
        return d.withColumn("_v", F.zip_with(F.col(self.P), F.col("_c"), lambda a, b: a * b)).withColumn("p", argmax_label("_v").cast("int")).drop("_v", "_c")


class MultiResponse:
    """One least-squares fit a class on 0/1 targets, from one shared matrix of products; the largest output of at least 0 wins."""

    def fit(self, df: DataFrame, features: list[str], classes: int, label: str) -> MultiResponse:
        self.features = features
        d = df
        for k in range(classes):
            d = d.withColumn(f"_t{k}", (F.col(label) == k).cast("double"))
        self.coef = [solve(*normal_equations(d, features, f"_t{k}")[0][:2]) for k in range(classes)]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        outs = []
        for c in self.coef:
            v = F.lit(0.0)
            for name, x in zip(self.features, c, strict=True):
                v = v + F.col(name) * float(x)
            outs.append(F.round(F.greatest(v, F.lit(0.0)), 9))
        return df.withColumn("_o", F.array(*outs)).withColumn("p", argmax_label("_o").cast("int")).drop("_o")


class TreeStack:
    """A forest without bootstrap, or (one tree) a decision tree, as the meta model."""

    def __init__(self, trees: int = 1):
        self.trees = trees

    def fit(self, df: DataFrame, features: list[str], classes: int, label: str) -> TreeStack:
        self.features = features
        est = learners.learner("extra_trees", label).setNumTrees(self.trees).setFeatureSubsetStrategy("all" if self.trees == 1 else "sqrt").setFeaturesCol("_f")
        self.model = est.fit(self._with(df))
        return self

    def _with(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="_f", handleInvalid="keep").transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.setPredictionCol("_prediction").setProbabilityCol("_pr").setRawPredictionCol("_raw").transform(self._with(df)).withColumn("p", F.col("_prediction").cast("int")).drop("_f", "_prediction", "_pr", "_raw")


STACKERS: dict[str, Callable] = {"linear": MultiResponse, "tree": TreeStack, "deco": lambda: TreeStack(20)}


class Stacking:
    """Out-of-fold probabilities of the base learners, next to given probabilities B, are the meta model's inputs. Base models stay fitted on the last fold's training rows."""

    def __init__(self, base: list[str], stacker: str = "linear", folds: int = 3):
        if stacker not in STACKERS:
            raise StackingError(stacker)
        self.base, self.stacker, self.folds = base, stacker, folds

    def _meta(self, df: DataFrame, models: list, classes: int, B: str | None) -> DataFrame:
        d = df
        for i, m in enumerate(models):
            d = m.transform(d).withColumn(f"_p{i}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        arrays = [F.col(f"_p{i}") for i in range(len(models))] + ([F.col(B)] if B else [])
        d = d.withColumn("_m", F.concat(*arrays))
        self.features = [f"m{i}" for i in range(classes * len(arrays))]
        return d.select(*df.columns, *[F.get("_m", i).alias(f"m{i}") for i in range(len(self.features))])

    def fit(self, df: DataFrame, classes: int, label: str = "label", B: str | None = None, fold: str = "fold") -> Stacking:
        self.classes, self.B, out = classes, B, None
        for k in range(self.folds):
            self.models = [learners.learner(n, label).fit(df.where(F.col(fold) != k)) for n in self.base]
            part = self._meta(df.where(F.col(fold) == k), self.models, classes, B)
            out = part if out is None else out.unionByName(part)
        self.meta = STACKERS[self.stacker]().fit(out, self.features, classes, label)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.meta.predict(self._meta(df, self.models, self.classes, self.B)).drop(*self.features)


def compare(train: DataFrame, test: DataFrame, static: list[str], probs: list[str], label: str, classes: int, name: str = "lr") -> DataFrame:
    """(model, accuracy, n) of trend only (argmax of probabilities), static features only, probabilities only, both, and stacked."""
    spark, rows = train.sparkSession, []

    def judge(kind: str, d: DataFrame, p: str) -> None:
        r = d.agg(F.avg((F.col(label) == F.col(p)).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
        rows.append((kind, float(r["a"] or 0.0), r["n"]))

    judge("trend", test.withColumn("p", (F.array_position(F.array(*probs), F.greatest(*probs)) - 1).cast("int")), "p")
    for kind, cols in (("features", static), ("probabilities", probs), ("both", static + probs)):
        judge(kind, learners.pipeline(cols, name, label).fit(train).transform(test), "prediction")
    b = lambda d: learners.assemble(d, static).withColumn("B", F.array(*probs))
    folds = F.pmod(F.xxhash64("series_id"), F.lit(3)).cast("int")
    judge("stacked", Stacking([name], "linear").fit(b(train).withColumn("fold", folds), classes, label, "B").predict(b(test)), "p")
    return spark.createDataFrame(rows, "model string, accuracy double, n long")
