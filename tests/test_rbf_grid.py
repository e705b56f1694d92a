"""The grid of RBF machines: all of its values, and fits in tasks that agree with the learner's."""

from pathlib import Path

import numpy as np
import pytest

from shapeflow.operators import learners
from shapeflow.plans import table_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_whole_grid(spark):
    got = {(r["gamma"], r["C"]) for r in table_queries.QUERIES["grid_search_rbf"](spark, SF).collect()}
    assert got == {(g, c) for g in learners.GRID_GAMMA for c in learners.GRID_C}


def test_fits_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (np.hypot(*x.T) > 1.1).astype(float) + (x[:, 0] > 1.2)
    d = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label double").coalesce(1).persist()
    args = dict(gammas=[0.5], penalties=[1.0, 100.0])
    few = learners.rbf_grid(d, "x", 2, **args)
    monkeypatch.setattr(learners, "TOGETHER", 0)
    many = learners.rbf_grid(d, "x", 2, **args)
    assert [r[:2] for r in few] == [r[:2] for r in many] == [(0.5, 1.0), (0.5, 100.0)]
    print(few, many)
    assert all(abs(a[2] - b[2]) < 0.06 and a[2] > 0.7 for a, b in zip(few, many, strict=True))
    d.unpersist()
