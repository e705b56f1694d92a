"""Readers, writers, draws and blocks of the core."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeflow.operators import clustering, ensemble, evaluation, learners, quality, regression, tables, text, trend
from shapeflow.sources import series as src


def lines(path):
    return sorted(x.strip() for p in path.glob("part-*") for x in p.read_text().splitlines())


def test_text_readers(spark, tmp_path):
    for name, body in {
        "assign": "2\n0\n\n1\n", "tags": "7 ann Music a b\n8 bob News\n", "ref": "# id a b c\n1 0.5 x 2\n", "pairs": "0 3\n1 2\n", "series": "1 0 0\n2 1 0\n",
    }.items():
        (tmp_path / name).write_text(body)
    at = lambda n: str(tmp_path / n)
    assert sorted(map(tuple, src.load_lines(spark, at("assign")).collect())) == [(0, 2), (1, 0), (3, 1)]
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in src.load_tokens(spark, at("tags")).collect()) == [(7, "ann", "Music", ("a", "b")), (8, "bob", "News", ())]
    assert [tuple(r) for r in src.load_columns(spark, at("ref"), ["a", "b", "c"]).collect()] == [(1, 0.5, None, 2.0)]
    assert sorted(map(tuple, src.load_pairs(spark, at("pairs")).collect())) == [(0, 3), (1, 2)]
    got = {r["series_id"]: list(r["x"]) for r in src.load_series(spark, at("series"), epsilon=0.5, zero_rows_only=True).collect()}
    assert got == {1: [0.5, 0.5], 2: [1.0, 0.0]}


def test_text_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, [0.25, 0.75])], "series_id long, cluster int, p array<double>")
    src.write_rows(d, str(tmp_path / "probs"), 3)
    assert lines(tmp_path / "probs") == ["1 2 0.250 0.750"]
    s = spark.createDataFrame([(i, [1.0 + 0.1 * i, 1.0, 1.0] if i < 4 else [90.0, 2000.0 + i, 90.0]) for i in range(8)], "series_id long, x array<double>")
    r = clustering.cluster(s, 2, "cast(series_id >= 4 as int)")
    clustering.write(r, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"centroids", "assign", "shifts", "dists"}
    assert lines(tmp_path / "out" / "assign") == [f"{i} {int(i >= 4)}" for i in range(8)]
    assert len(lines(tmp_path / "out" / "centroids")) == 2 and len(lines(tmp_path / "out" / "dists")) == 8


def test_folds_are_equal(spark):
    d = spark.range(103).withColumnRenamed("id", "series_id")
    sizes = [r["n"] for r in evaluation.kfold(d, 5).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]


def test_draws_are_exact(spark):
    d = spark.range(200).select(F.col("id").alias("series_id"), (F.col("id") % 4).cast("double").alias("w"))
    for seed in range(3):
        got = ensemble.sample_weights(d, "w", 1000, seed)
        assert got.count() == 1000 and got.where("w = 0").count() == 0
        assert abs(got.where("w = 3").count() - 500) < 80
    assert ensemble.sample_weights(d.where("w = 0"), "w", 10).count() == 0


def test_references_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trend, "MOST_REFERENCES", 2)
    rng = np.random.default_rng(0)
    refs = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(7)], "ref_id long, x array<double>")
    own = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(3)], "series_id long, x array<double>")
    few = {(r["series_id"], r["ref_id"]): r["dist"] for r in trend.distances(own, refs, 3).collect()}
    monkeypatch.setattr(trend, "MOST_REFERENCES", 100)
    assert few == {(r["series_id"], r["ref_id"]): pytest.approx(r["dist"]) for r in trend.distances(own, refs, 3).collect()} and len(few) == 21


def test_scores_of_several_prefixes(spark):
    rng = np.random.default_rng(1)
    refs = spark.createDataFrame([(i, i % 2, rng.random(6).tolist()) for i in range(9)], "ref_id long, label int, x array<double>")
    own = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(5)], "series_id long, x array<double>")
    got = {(r[0], r[1], r[2]): r[3] for r in trend.scores_against(own, refs, [2, 4], block=2).select("series_id", "num_pts", "label", "score").collect()}
    want = {(r[0], r[1], r[2]): r[3] for r in trend.curves(own, trend.fit(refs), [2, 4]).select("series_id", "num_pts", "label", "score").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(i, rng.random(3).tolist(), i % 3) for i in range(60)], "id long, x array<double>, label int")
    whole = sorted(map(tuple, learners.knn(t, t.where("id % 5 = 0"), 3).collect()))
    monkeypatch.setattr(learners, "QUERY_ROWS", 4)
    assert sorted(map(tuple, learners.knn(t, t.where("id % 5 = 0"), 3).collect())) == whole and len(whole) == 12


def test_quality_from_sums(spark):
    from shapeflow.functions.kernels import rolling

    rng = np.random.default_rng(3)
    x, c = rng.random((23, 5)), np.arange(23) % 3
    s = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(23)], "series_id long, x array<double>, cluster int")
    d, _ = rolling(x, x)
    np.fill_diagonal(d, 0)
    same = c[:, None] == c[None, :]
    for block in (4, 100):
        r = quality.spread(clustering.pair_sums(s, block)).first()
        assert r["intra_mean"] == pytest.approx(d[same].mean()) and r["intra_std"] == pytest.approx(d[same].std())
        assert r["inter_mean"] == pytest.approx(d[~same].mean()) and r["inter_std"] == pytest.approx(d[~same].std())


def test_tail_of_chi_square():
    for x, dof, p in ((3.841459, 1, 0.05), (9.487729, 4, 0.05), (18.307038, 10, 0.05), (2.705543, 1, 0.1), (0.0, 3, 1.0)):
        assert text._upper_gamma(dof / 2, x / 2) == pytest.approx(p, abs=1e-6)


def test_one_hot_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_COLUMNS", 2)
    with pytest.raises(ValueError):
        tables.one_hot(spark.createDataFrame([(i, str(i)) for i in range(3)], "id long, c string"), "c")
    d, names = tables.category_columns(spark.createDataFrame([(1, "Gaming"), (2, None), (3, "?")], "id long, c string"), "c")
    assert names == sorted(names) and {r["id"]: [n for n in names if r[n]] for r in d.collect()} == {1: ["Game"], 2: ["-"], 3: []}


def test_errors_at_reference_days(spark):
    rng = np.random.default_rng(4)
    x = rng.random((30, 4)) + 0.1
    s = spark.createDataFrame([(i, x[i].tolist(), i % 2, i % 4 + 1) for i in range(30)], "series_id long, x array<double>, cls int, best_by int")
    got = {(r["model"], r["class"]): (r["mean"], r["n"]) for r in regression.prefix_report(s, "cls", "best_by").collect()}

    def loo(rows):
        out = {}
        z = x[rows] / x[rows].sum(1, keepdims=True)
        for n in range(1, 5):
            g = np.linalg.pinv(z[:, :n].T @ z[:, :n])
            h = np.einsum("ij,jk,ik->i", z[:, :n], g, z[:, :n])
            rest = 1 - z[:, :n] @ (g @ z[:, :n].sum(0))
            for i, r, a in zip(rows, rest, h, strict=True):
                out[i, n] = (r / (1 - a)) ** 2 if a < 1 - 1e-9 else 0.0
        return out

    whole, by = loo(list(range(30))), loo(list(range(0, 30, 2))) | loo(list(range(1, 30, 2)))
    at = [(i, i % 4 + 1) for i in range(30)]
    assert got["global", None] == (pytest.approx(np.mean([whole[k] for k in at])), 30)
    assert got["class", None] == (pytest.approx(np.mean([by[k] for k in at])), 30)
    assert got["class", 1] == (pytest.approx(np.mean([by[k] for k in at if k[0] % 2])), 15)
