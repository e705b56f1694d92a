import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapeflow.functions import kernels
from shapeflow.functions import series as S


def value(spark, expression, **arrays):
    row = spark.range(1).select(*[F.lit(v).cast("array<double>").alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in arrays.items()])
    out = row.select(S.col(expression).alias("v")).first()["v"]
    return out.asDict() if hasattr(out, "asDict") else out


ROLL = {0: [1, 2, 3, 4], 1: [4, 1, 2, 3], -1: [2, 3, 4, 1], 2: [3, 4, 1, 2], -2: [3, 4, 1, 2], 3: [2, 3, 4, 1], -3: [4, 1, 2, 3], 4: [1, 2, 3, 4], -4: [1, 2, 3, 4], 5: [4, 1, 2, 3], -5: [2, 3, 4, 1], 8: [1, 2, 3, 4], -8: [1, 2, 3, 4]}
DROP = {0: [1, 2, 3, 4], 1: [0, 1, 2, 3], -1: [2, 3, 4, 0], 2: [0, 0, 1, 2], -2: [3, 4, 0, 0], 3: [0, 0, 0, 1], -3: [4, 0, 0, 0], 4: [0] * 4, -4: [0] * 4, 5: [0] * 4, -5: [0] * 4, 50: [0] * 4, -50: [0] * 4}


def test_shift_tables(spark):
    d = spark.createDataFrame([(q,) for q in sorted({*ROLL, *DROP})], "q int").withColumn("x", F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)]))
    for r in d.select("q", S.col(S.roll("x", "q")).alias("r"), S.col(S.drop("x", "q")).alias("d")).collect():
        if r["q"] in ROLL:
            assert r["r"] == ROLL[r["q"]]
        if r["q"] in DROP:
            assert r["d"] == DROP[r["q"]]


def test_shift_of_empty_and_single(spark):
    for q in (0, 1, -1, 10, -10):
        assert value(spark, S.roll("x", str(q)), x=[]) == [] and value(spark, S.drop("x", str(q)), x=[]) == []
        assert value(spark, S.roll("x", str(q)), x=[1.0]) == [1.0]
    assert value(spark, S.drop("x", "1"), x=[1.0]) == [0.0] and value(spark, S.drop("x", "-2"), x=[1.0]) == [0.0]


def test_products(spark):
    assert value(spark, S.dot("a", "b"), a=[1.0, 2.0, 3.0], b=[2.0, 3.0, 4.0]) == 20
    assert value(spark, S.sqsum("a"), a=[2.0]) == 4 and value(spark, S.sqsum("a"), a=[]) == 0


FAR = 2 / math.sqrt(29)


@pytest.mark.parametrize(
    "a,b,want",
    [([], [], 0), ([0.0, 0.0], [0.0, 0.0], 0), ([1.0, 2.0], [0.0, 0.0], 1), ([0.0, 0.0], [1.0, 2.0], 1), ([2.0, 3.0, 4.0], [2.0, 3.0, 4.0], 0), ([2.0, 3.0, 4.0], [3.0, 4.0, 0.0], FAR), ([3.0, 4.0, 0.0], [2.0, 3.0, 4.0], FAR)],
)
def test_rolling_distance(spark, a, b, want):
    assert value(spark, S.roll_dist("a", "b") + ".dist", a=a, b=b) == pytest.approx(want, abs=1e-7)


def test_fixed_and_drop_distance(spark):
    a, b = [2.0, 3.0, 4.0], [3.0, 4.0, 0.0]
    for rolling in (True, False):
        assert value(spark, S.shift_dist("a", "b", "1", rolling), a=a, b=b) == pytest.approx(FAR)
    assert value(spark, S.drop_dist("a", "b"), a=b, b=a) == pytest.approx(0, abs=1e-7)
    assert value(spark, S.drop_dist("a", "b"), a=a, b=b) == pytest.approx(FAR)


HAAR = [([], [], []), ([1, 1], [1], [0]), ([1, 2, 3, 0], [1.5, 1.5], [-0.5, 1.5]), ([1, 2, 3, 0, 7], [1.5, 1.5, 3.5], [-0.5, 1.5, 3.5]), ([6, 12, 15, 15, 14, 12, 120, 116, 2], [9, 15, 13, 118, 1], [-3, 0, 1, 2, 1])]


@pytest.mark.parametrize("x,w,c", HAAR)
def test_haar(spark, x, w, c):
    x = [float(v) for v in x]
    h = value(spark, S.haar("x"), x=x)
    assert h["wavelet"] == w and h["coefficient"] == c
    assert value(spark, S.haar_inverse("w", "c"), w=h["wavelet"], c=h["coefficient"]) == x


def test_haar_inverse_lengths(spark):
    assert value(spark, S.haar_inverse("w", "c"), w=[1.0, 2.0], c=[1.0]) is None
    assert value(spark, S.haar_inverse("w", "c", "3"), w=[1.5, 1.5], c=[-0.5, 1.5]) == [1.0, 2.0, 3.0]


def test_places(spark):
    x = [1.0, 5.0, 0.0, 5.0]
    assert value(spark, S.argmax("x"), x=x) == 1 and value(spark, S.argmin("x"), x=x) == 2
    assert value(spark, S.min_first("x"), x=x)[0] == 0 and value(spark, S.center_peak("x"), x=x)[2] == 5


@pytest.mark.parametrize("p,want", [(0.25, 2.95), (0.5, 5.5), (0.75, 8.05)])
def test_mquantile(spark, p, want):
    assert value(spark, S.mquantile("x", p), x=[float(i) for i in range(1, 11)]) == pytest.approx(want)
    assert value(spark, S.mquantile("x", p), x=[]) is None and value(spark, S.mquantile("x", p), x=[4.0]) == 4


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=7), st.integers(-9, 9), st.integers(1, 5))
def test_distance_properties(spark, pairs, q, scale):
    import numpy as np

    a, b = np.array([[float(x) for x, _ in pairs]]), np.array([[float(y) for _, y in pairs]])
    d = kernels.rolling(a, b)[0][0, 0]
    assert 0 <= d <= 1
    assert d == pytest.approx(kernels.rolling(b, a)[0][0, 0] if a.any() and b.any() else d, abs=1e-7)
    assert d == pytest.approx(kernels.rolling(a, np.roll(b, q) * scale)[0][0, 0], abs=1e-6)
    assert value(spark, S.roll_dist("a", "b") + ".dist", a=a[0].tolist(), b=b[0].tolist()) == pytest.approx(d, abs=1e-7)


def test_drop_kernel(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (4, 5)).astype(float), rng.integers(0, 4, (6, 5)).astype(float)
    a[0] = b[0] = 0
    got = kernels.dropping(a, b)
    rows = [(i, j, a[i].tolist(), b[j].tolist()) for i in range(4) for j in range(6)]
    d = spark.createDataFrame(rows, "i int, j int, a array<double>, b array<double>").select("i", "j", S.col(S.drop_dist("a", "b")).alias("d"))
    for r in d.collect():
        assert got[r["i"], r["j"]] == pytest.approx(r["d"], abs=1e-9)
