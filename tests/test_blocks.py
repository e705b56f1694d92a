"""Pairs and scores by blocks: whole tables, no join of pairs, equal results to the plain forms."""

import math
from pathlib import Path

import numpy as np
import pytest

from shapeflow.functions import kernels
from shapeflow.operators import clustering, trend
from shapeflow.plans import series_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["dist_roll_struct", "dist_drop_expression"])
def test_all_series_against_all(spark, name):
    n = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert series_queries.QUERIES[name](spark, SF).count() == n * n
    assert "% 20" not in series_queries.SQL[name]


@pytest.mark.parametrize("most", [1024, 3])
@pytest.mark.parametrize("dropped", [False, True])
def test_pairs_of_members(spark, monkeypatch, most, dropped):
    monkeypatch.setattr(clustering, "MEMBERS", most)
    rng = np.random.default_rng(3)
    x = rng.poisson(0.8, (7, 5)).astype(float)
    x[2] = 0
    s = spark.createDataFrame([(i, x[i % 7].tolist()) for i in range(30)], "series_id long, x array<double>")
    rows = clustering.distances_of_all(s, dropped=dropped, digits=6)
    assert "Join" not in _plan(rows)  # no row of a pair is shuffled
    got = {(r["id1"], r["id2"]): r["dist"] for r in rows.collect()}
    one = kernels.dropping(x, x) if dropped else kernels.rolling(x, x)[0]
    assert got == {(i, j): pytest.approx(one[i % 7, j % 7], abs=6e-7) for i in range(30) for j in range(30)}


def test_distances_without_rotations():
    rng = np.random.default_rng(4)
    for x, y in ((rng.poisson(1.0, (6, 7)).astype(float), rng.poisson(1.0, (9, 7)).astype(float)), (rng.normal(size=(6, 7)), rng.normal(size=(9, 7)))):
        x[1], y[2] = 0, 0
        assert np.allclose(kernels.rolling_distances(x, y)[0], kernels.rolling(x, y)[0], atol=1e-7)
        d, back = kernels.dropping_distances(x, y)
        assert np.allclose(d, kernels.dropping(x, y), atol=1e-7) and np.allclose(back, kernels.dropping(y, x), atol=1e-7)


def test_windows_by_kind():
    rng = np.random.default_rng(5)
    r = rng.poisson(0.7, (90, 12)).astype(float)
    r[4] = 0
    p = rng.poisson(0.7, (9, 12)).astype(float)
    assert trend._kinds_of_windows(r, 2) is not None and trend._kinds_of_windows(r, 12) is None and trend._kinds_of_windows(r + 0.5, 2) is None
    for n in (0, 1, 2, 3, 5, 12, 13):
        assert np.array_equal(trend._tiled(p[:, :n], r), kernels.to_references(p[:, :n], r))


def test_prefixes_in_blocks(spark):
    rng = np.random.default_rng(6)
    own, refs = rng.poisson(1.0, (5, 8)).astype(float).tolist(), rng.poisson(1.0, (6, 8)).astype(float).tolist()
    q = spark.createDataFrame([(i, own[i % 5]) for i in range(20)], "series_id long, x array<double>")
    r = spark.createDataFrame([(i, i % 2, refs[i % 6]) for i in range(18)], "ref_id long, label int, x array<double>")
    d = trend.distances(q, r, 3, digits=6, block=2)
    assert "Join" not in _plan(d)
    want = kernels.to_references(np.array(own)[:, :3], np.array(refs))
    assert {(x[0], x[1]): x[2] for x in d.collect()} == {(i, j): pytest.approx(want[i % 5, j % 6], abs=6e-7) for i in range(20) for j in range(18)}


def test_blocks_of_references_are_not_joined(spark):
    """Only ids are joined: a block of series is dealt by name, so that none is broadcast as often as there are blocks of references."""
    rng = np.random.default_rng(7)
    q = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(9)], "series_id long, x array<double>")
    r = spark.createDataFrame([(i % 2, rng.random(6).tolist()) for i in range(70)], "label int, x array<double>")
    few, many = (trend.scores_against(q, r, [2, 5], block=b) for b in (2, 512))
    assert _plan(few).count("Join Inner") == 2
    want = {tuple(x)[:3]: x[3] for x in many.collect()}
    got = {tuple(x)[:3]: x[3] for x in few.collect()}
    assert got.keys() == want.keys() and len(got) == 36 and all(math.isclose(got[k], want[k]) for k in want)
