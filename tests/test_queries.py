"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shapeflow.plans import series_queries, table_queries, trend_queries

SF = "/root/testdata/sf0.001"
QUERIES = series_queries.QUERIES | trend_queries.QUERIES | table_queries.QUERIES
SQL = series_queries.SQL | trend_queries.SQL | table_queries.SQL
SLOW = {"cluster_multires", "cluster_restarts", "trend_pipeline", "trend_pipeline_report", "learner_comparison", "grid_search_lr", "grid_search_trees", "grid_search_rbf", "joint_experiment", "holdout_experiment", "model_comparison"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        d = db.execute(SQL[name])
        want = rows([c[0] for c in d.description], d.fetchall())
        assert sorted(df.columns) == sorted(c[0] for c in d.description)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)
