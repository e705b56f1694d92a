import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shapeflow.functions import stemmer
from shapeflow.operators import ensemble, evaluation, learners, regression, tables, trend


@pytest.mark.parametrize("y,p,want", [([1, 1, 1], [0, 0, 0], 1), ([10, 10, 10], [1, 2, 3], 0.6466), ([1, 0.5, 0.8], [1, 0.5, 0.8], 0)])
def test_relative_error(spark, y, p, want):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")
    assert regression.errors(d).first()["mrse"] == pytest.approx(want, abs=1e-3)


def test_relative_fit(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0), (4.0, 8.0, 2.0)], "a double, b double, y double")
    z = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert regression.relative_fit(d, ["a", "b"])[0] == pytest.approx(np.linalg.pinv(z) @ np.ones(2))
    assert regression.relative_fit(d, ["a"])[0] == pytest.approx(np.linalg.pinv(z[:, :1]) @ np.ones(2))


def test_routed_regression(spark):
    X = [(1, 2), (1, 2), (4, 8), (4, 8), (200, 200), (199, 200.1), (200.2, 198)]
    d = spark.createDataFrame([(float(a), float(b), int(i > 3), [1.0, 1.0, 2.0, 2.0, 100.0, 100.0, 100.0][i]) for i, (a, b) in enumerate(X)], "a double, b double, c int, y double")

    class Clf:
        def fit(self, df, features, label):
            self.m = learners.pipeline(features, "extra_trees", label).fit(df)
            return self

        def transform(self, df):
            return self.m.transform(df)

    m = regression.multiclass(d, ["a", "b"], "c", "y", Clf())
    t = spark.createDataFrame([(0, 1.0, 2.0), (1, 200.0, 200.0), (2, 1.0, 2.0), (3, 200.0, 200.0)], "i int, a double, b double")
    p = {r["i"]: r["p"] for r in regression.multiclass_predict(t, ["a", "b"], m).collect()}
    assert p[0] == p[2] and p[1] == p[3] and p[0] != p[1]


def test_leave_one_out(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((8, 2)), rng.random(8)
    d = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, y double")
    got = {r["i"]: r["loo"] for r in regression.loo_fit(d, ["a", "b"], "y")[1].collect()}
    for i in range(8):
        k = np.arange(8) != i
        assert got[i] == pytest.approx((y[i] - x[i] @ np.linalg.lstsq(x[k], y[k], rcond=None)[0]) ** 2)


def test_prefix_errors(spark):
    rng = np.random.default_rng(1)
    x = rng.random((9, 4))
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, x array<double>")
    got = {(r["series_id"], r["tr"]): r["p"] for r in regression.prefix_errors(s).collect()}
    for n in (1, 3):
        z = x[:, :n] / x.sum(1, keepdims=True)
        coef = np.linalg.pinv(z) @ np.ones(9)
        assert got[2, n] == pytest.approx(x[2, :n] @ coef)


@pytest.mark.parametrize("n", [3, 1])
def test_trend(spark, n):
    rng = np.random.default_rng(2)
    base = {1: np.ones(10), 0: np.tile([90.0, 2000.0], 5)}
    rows = lambda m, at: [(at + 100 * y + i, y, (base[y] + rng.random(10)).tolist()) for y in (0, 1) for i in range(m)]
    refs = spark.createDataFrame(rows(10, 0), "series_id long, label int, x array<double>")
    test = spark.createDataFrame(rows(15, 1000), "series_id long, y int, x array<double>")
    got = trend.predict(trend.curves(test, trend.fit(refs), [n])).join(test, "series_id").collect()
    assert all(r["label"] == (r["y"] if n == 3 else 0) for r in got)
    block = {(r["series_id"], r["label"]): r["score"] for r in trend.scores_against(test, refs.select("label", "x"), n, block=7).collect()}
    for r in trend.curves(test, trend.fit(refs), [n]).collect():
        assert block[r["series_id"], r["label"]] == pytest.approx(r["score"])


def test_decisions(spark):
    curve = spark.createDataFrame([(1, n, k, p if k else 1 - p) for n, p in ((1, 0.5), (2, 0.7), (3, 0.9)) for k in (0, 1)] + [(2, 1, 0, 0.5), (2, 1, 1, 0.5)], "series_id long, num_pts int, label int, p double")
    limits = spark.createDataFrame([(0, 9, 0.5), (1, 3, 0.6)], "k int, min_pts int, theta double")
    got = {r["series_id"]: (r["label"], r["best_by"]) for r in trend.decide(curve, limits).collect()}
    assert got == {1: (1, 3), 2: (None, None)}


def test_report_of_unseen_label(spark):
    d = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, p int")
    r = {x["label"]: x for x in evaluation.report(d).collect()}
    assert r["0"]["recall"] == 0.5 and r["2"]["precision"] == 0 and r["2"]["support"] == 0 and r["micro"]["f1"] == pytest.approx(2 / 3)


def test_t_quantile():
    assert evaluation.t_quantile(0.975, 4) == pytest.approx(2.776, abs=1e-3)


def test_folds(spark):
    d = spark.range(100).withColumnRenamed("id", "series_id").withColumn("y", F.expr("series_id % 2"))
    assert evaluation.kfold(d, 5).select("fold").distinct().count() == 5
    n = evaluation.stratified(d, 5, "y").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in n} == {10}


def test_ensembles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 3), [float(v) for v in rng.random(2) + (i % 3)], [0.8 if k == i % 3 else 0.1 for k in range(3)], i % 3) for i in range(60)]
    d = spark.createDataFrame([(i, y, *x, b, f) for i, y, x, b, f in rows], "series_id long, label double, x0 double, x1 double, B array<double>, fold int").withColumn("fold", F.expr("cast(series_id div 3 % 3 as int)"))
    d = learners.assemble(d, ["x0", "x1"])
    for made in (ensemble.ClassBoost().fit(d, 3), ensemble.CoTrain(rounds=2).fit(d.withColumnRenamed("B", "P"), 3), ensemble.Stacking(["lr"], "linear").fit(d, 3, B="B")):
        own = d.withColumnRenamed("B", "P") if isinstance(made, ensemble.CoTrain) else d
        assert made.predict(own).where("p = label").count() >= 54
    with pytest.raises(ensemble.StackingError):
        ensemble.Stacking(["lr"], "no such")
    with pytest.raises(ValueError):
        learners.learner("no such")


def test_tables(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", None, 0.0)], "c string, l string, v double")
    assert {(r["c"], r["l"]): r["share"] for r in tables.share(d, "c", "l", F.col("v")).collect()} == {("a", "x"): 0.25, ("a", "y"): 0.75}
    assert tables.translate(d, "l").where("l = '-'").count() == 1
    assert tables.histogram(spark.createDataFrame([(0.0,), (1.0,)], "v double"), "v").count() == 2
    assert tables.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first()["n"] == 2


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky")])
def test_stems(word, want):
    assert stemmer.stem(word) == want


def test_fourier_features(spark):
    x = np.array([[0.0, 0.1], [0.3, -0.2], [1.0, 1.0]])
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    f = np.array([r["features"].toArray() for r in learners.fourier_features(d, "x", 2, gamma=0.5, n=600).orderBy("i").collect()])
    assert np.abs(f @ f.T - np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))).max() < 0.15


def test_rbf_grid_metrics_are_plain_floats(spark, monkeypatch):
    from shapeflow.operators import learners

    monkeypatch.setattr(learners, "grid_search", lambda d, name, label, folds, values, seed: (None, [np.float64(0.25), np.float64(0.5)]))
    d = spark.createDataFrame([([0.0, 1.0], 1.0)], "x array<double>, label double")
    rows = learners.rbf_grid_search(d, "x", 2, gammas=[0.5], penalties=[0.1, 1.0])[2]
    assert [tuple(r) for r in spark.createDataFrame(rows, "gamma double, C double, f1 double").collect()] == [(0.5, 0.1, 0.25), (0.5, 1.0, 0.5)]


def test_equal_prefixes_and_references_are_scored_once(spark):
    """Copies of series cost no distances, and the scores count every copy."""
    from shapeflow.functions import kernels

    rng = np.random.default_rng(8)
    own, refs = rng.poisson(1.0, (5, 8)).astype(float).tolist(), rng.poisson(1.0, (6, 8)).astype(float).tolist()
    q = spark.createDataFrame([(i, own[i % 5]) for i in range(20)], "series_id long, x array<double>")
    r = spark.createDataFrame([(i % 2, refs[i % 6]) for i in range(18)], "label int, x array<double>").coalesce(1)
    want = {}
    for i in range(20):
        for n in (2, 5):
            e = np.exp(-kernels.to_references(np.array([own[i % 5][:n]]), np.array([refs[j % 6] for j in range(18)])))[0]
            for k in range(2):
                want[i, n, k] = float(e[[j for j in range(18) if j % 2 == k]].sum())
    s = trend.scores_against(q, r, [2, 5])
    assert {(x["series_id"], x["num_pts"], x["label"]): x["score"] for x in s.collect()} == pytest.approx(want)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "times" in plan  # references are counted before they are compared


def test_to_references_by_rolling():
    from shapeflow.functions import kernels

    rng = np.random.default_rng(9)
    p, r = rng.poisson(0.6, (9, 4)).astype(float), rng.poisson(0.6, (7, 10)).astype(float)
    want = [[min(1.0, min(kernels.rolling(f[None, i : i + 4], x[None])[0][0, 0] for i in range(7))) for f in r] for x in p]
    assert np.array_equal(kernels.to_references(p, r), np.array(want))


def _noisy(spark, n=400, seed=6):
    """Rows of three classes that overlap, so that a fit without penalty has one optimum."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2)) + np.array([[0, 0], [1.2, 0], [0, 1.2]])[y]
    p = np.full((n, 3), 0.2)
    p[np.arange(n), np.where(rng.random(n) < 0.7, y, (y + 1) % 3)] = 0.6
    rows = [(int(i), float(y[i]), x[i].tolist(), p[i].tolist()) for i in range(n)]
    d = spark.createDataFrame(rows, "series_id long, label double, x array<double>, P array<double>").withColumn("features", array_to_vector("x"))
    return d, x, y


def test_softmax_fit_is_the_learners_optimum(spark):
    d, x, y = _noisy(spark)
    got = np.array([r[0].toArray() for r in learners.learner("lr").fit(d).transform(d).orderBy("series_id").select("probability").collect()])
    z = np.exp(np.column_stack([x, np.ones(len(x))]) @ ensemble.softmax_fit(np.column_stack([x, np.ones(len(x))]), y, 3))
    assert np.abs(z / z.sum(1, keepdims=True) - got).max() < 5e-3


def test_cotrain_rounds_are_few_jobs_and_agree_with_those_in_the_tasks(spark, monkeypatch):
    d, *_ = _noisy(spark)
    found = []
    for most in (ensemble.TOGETHER, 0):
        monkeypatch.setattr(ensemble, "TOGETHER", most)
        spark.sparkContext.setJobGroup(f"cotrain-{most}", "")
        model = ensemble.CoTrain(per_round=20).fit(d, 3)
        found.append(({r[0]: r[1] for r in model.predict(d).select("series_id", "p").collect()}, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cotrain-{most}"))))
    (a, few), (b, many) = found
    assert sum(a[i] == b[i] for i in b) > 0.97 * len(b) and len(a) == 400
    assert few < 60 < many


def test_surest_rows_are_those_of_an_ordered_limit(spark):
    d, *_ = _noisy(spark, 90)
    p = d.withColumn("series_id", F.concat(F.lit("s"), F.col("series_id").cast("string"))).repartition(5)
    want = [(r[0], k) for k in range(4) for r in p.orderBy(F.get("P", k).desc(), "series_id").limit(7).collect()]
    assert [(i, k) for i, k in ensemble._surest(p.select("series_id", "P"), 4, ("P",), "series_id", 7)] == [(r, k) for r, k in want]
