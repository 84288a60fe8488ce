import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions.distance import arrow_distance, distance, kernel, register_metric

OPS = ("<->", "<=>", "<#>")


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("dim", [1, 3, 64, 200])
def test_columns_match_numpy(spark, op, dim):
    r = np.random.default_rng(dim)
    x = r.normal(size=(40, dim)).astype(np.float32)
    x[3] = 0
    q = r.normal(size=dim)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0] * (dim + 1))], "id int, v array<float>")
    want = kernel(op, x.astype(np.float64), q)
    for f in (distance, arrow_distance):
        got = {row["id"]: row["d"] for row in df.select("id", f(F.col("v"), op, q.tolist()).alias("d")).collect()}
        assert np.allclose([got[i] for i in range(40)], want, atol=1e-12)
        assert got[90] is None and got[91] is None
    if op == "<=>":
        assert got[3] == 1.0


def test_zero_query_is_at_one(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert df.select(distance(F.col("v"), "<=>", [0.0, 0.0]).alias("d")).first()["d"] == 1.0


def test_registered_metric(spark):
    register_metric("<m>", lambda x, q: np.abs(x - q).sum(axis=1))
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert df.select(distance(F.col("v"), "<m>", [0.0, 0.0]).alias("d")).first()["d"] == 3.0


_vec = st.lists(st.floats(-100, 100, width=32), min_size=16, max_size=16).map(np.array)


@settings(max_examples=100, deadline=None)
@given(_vec, _vec, _vec)
def test_properties(a, b, c):
    d = lambda op, x, y: float(kernel(op, x[None, :], y)[0])
    assert d("<->", a, a) == 0 and d("<->", a, b) >= 0
    assert np.isclose(d("<->", a, b), d("<->", b, a))
    assert d("<->", a, c) <= d("<->", a, b) + d("<->", b, c) + 1e-6
    assert np.isclose(d("<=>", a, b), d("<=>", b, a), atol=1e-9) and -1e-9 <= d("<=>", a, b) <= 2 + 1e-9
    assert np.isclose(d("<#>", a, b), d("<#>", b, a))
