import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeflow.functions import kernels
from shapeflow.functions.kernels import rolling
from shapeflow.operators import clustering, quality

FLAT = [[1, 1, 1], [1.1, 1, 1], [1.2, 1, 1]] + [[1.3, 1, 1]] * 5
PEAK = [[90, 2000 + i, 90] for i in range(4)]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(FLAT + PEAK)], "series_id long, x array<double>").cache()


def _separated(result):
    c = {r["series_id"]: r["cluster"] for r in result.assigned.collect()}
    return len({c[i] for i in range(8)}) == 1 and len({c[i] for i in range(8, 12)}) == 1 and c[0] != c[8]


def test_separates(spark, series):
    r = clustering.restarts(series, 2, runs=4)
    assert _separated(r)
    for row in r.assigned.collect():
        d = rolling(r.centroids, np.array([row["x"]]))[0][:, 0]
        assert row["dists"] == pytest.approx(d.tolist(), abs=1e-5) and row["dist"] == pytest.approx(d.min(), abs=1e-5)
    assert np.linalg.norm(r.centroids, axis=1) == pytest.approx(1) and (r.centroids.sum(1) >= 0).all()


def test_multiresolution(spark, series):
    long = series.withColumn("x", F.flatten(F.array_repeat("x", 4)))
    r = clustering.multiresolution(long, 2, levels=1, seed=3)
    assert r.assigned.count() == 12 and 0 <= r.cost <= 1


def test_cost_does_not_rise(spark):
    rng = np.random.default_rng(0)
    s = spark.createDataFrame([(i, [float(v) for v in rng.integers(0, 9, 6)]) for i in range(40)], "series_id long, x array<double>")
    costs = [clustering.cluster(s, 3, max_iter=n).cost for n in (1, 3, 20)]
    assert costs[0] >= costs[1] - 1e-9 >= costs[2] - 2e-9
    with pytest.raises(ValueError):
        clustering.cluster(s, 3, max_iter=0)


def test_zero_series_and_empty_cluster(spark):
    s = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], "series_id long, x array<double>")
    r = clustering.cluster(s, 3, "cast(series_id > 0 as int)")
    assert not r.centroids[2].any()
    d = {x["series_id"]: x["dist"] for x in r.assigned.collect()}
    assert d[1] == pytest.approx(0, abs=1e-7) and d[2] == pytest.approx(0, abs=1e-7)


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (11, 5)).astype(float)
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series_id long, x array<double>")
    got = {(r["id1"], r["id2"]): r["dist"] for r in clustering.pair_distances(s, block=3).collect()}
    want = rolling(x, x)[0]
    assert len(got) == 121
    assert all(got[i, j] == pytest.approx(0 if i == j else want[i, j], abs=1e-9) for i in range(11) for j in range(11))


def test_quality(spark):
    pairs = spark.createDataFrame([(i, j, abs(a - b) / 10) for i, a in enumerate([0, 1, 9]) for j, b in enumerate([0, 1, 9])], "id1 long, id2 long, dist double")
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "series_id long, cluster int")
    q = quality.spread(pairs, c).first()
    assert q["intra_mean"] == pytest.approx(0.2 / 5) and q["inter_mean"] == pytest.approx((0.9 + 0.8) / 2)
    assert quality.silhouette(pairs, c).first()[0] == pytest.approx(np.mean([(0.9 - 0.05) / 0.9, (0.8 - 0.05) / 0.8, 1]))
    assert quality.silhouette(pairs, c.withColumn("cluster", F.lit(0))).first()[0] is None


def test_unequal_lengths(spark):
    s = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "series_id long, x array<double>")
    with pytest.raises(ValueError):
        clustering.cluster(s, 1)


def test_equal_series_count_as_often_as_they_occur(spark, monkeypatch):
    """Iterations in the driver, over different series once, and as jobs give the centroids that all rows give; no job an iteration for a small table."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (30, 6)).astype(float)
    rows = [(30 * c + i, x[i].tolist()) for i in range(30) for c in range(1 + i % 4)]
    d = spark.createDataFrame(rows, "series_id long, x array<double>")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("settle"))
    spark.sparkContext.setJobGroup("settle", "")
    together = clustering.cluster(d, 3)
    n = jobs()
    monkeypatch.setattr(clustering, "TOGETHER", 0)
    apart = clustering.cluster(d, 3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert together.iterations == apart.iterations and np.allclose(together.centroids, apart.centroids) and n < 20
    c = np.array([r[0] % 3 for r in rows])
    every = np.array([r[1] for r in rows])
    every = every / np.linalg.norm(every, axis=1, keepdims=True)
    first = clustering.centroids(d.withColumn("cluster", F.expr("cast(series_id % 3 as int)")), 3)
    for k in range(3):
        v = np.linalg.eigh(every[c == k].T @ every[c == k])[1][:, -1]
        assert np.allclose(first[k], v * np.sign(v.sum()))


def test_rolling_by_one_product(monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 5, (4, 7)).astype(float), rng.integers(0, 5, (50, 7)).astype(float)
    x[1], y[3], y[4] = 0, 0, 2
    one = kernels.rolling(x, y)
    monkeypatch.setattr(kernels, "WHOLE", 0)
    for a, b in zip(one, kernels.rolling(x, y), strict=True):
        assert np.allclose(a, b)


@pytest.mark.parametrize("most", [10_000, 3])
def test_equal_series_meet_once(spark, monkeypatch, most):
    """A value is taken once for every two different series and given to all their rows, also in blocks."""
    monkeypatch.setattr(clustering, "MOST_SENT", most)
    d = spark.createDataFrame([(i, [float(i % 4), 2.0, 0.0]) for i in range(20)], "id long, x array<double>")
    taken = spark.sparkContext.accumulator(0)

    def value(a, b):
        taken.add(1)
        return a[0] * 10 + b[0]

    f = F.udf(value, "double")
    got = clustering.class_pairs(d.where("id < 12").toDF("id1", "a"), d.toDF("id2", "b"), f("a", "b")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, j, i % 4 * 10.0 + j % 4) for i in range(12) for j in range(20)) and taken.value == 16
    s = d.withColumnRenamed("id", "series_id")
    want = sorted((r["id1"], r["id2"], round(r["dist"], 6)) for r in clustering.pair_distances(s).collect())
    assert sorted((r["id1"], r["id2"], round(r["dist"], 6)) for r in clustering.distances_of_all(s).collect()) == want
