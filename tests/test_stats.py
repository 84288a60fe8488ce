import random

import pytest
from pyspark.sql import functions as F

from corvane import Collection
from corvane.language.parser import parse_predicate
from corvane.operators import stats


@pytest.mark.parametrize("n", [0, 1, 7, 20, 23, 103])
def test_histogram_chunks(spark, n):
    r = random.Random(n)
    v = sorted(r.choice([1.0, 2.0, 3.5, r.random()]) for _ in range(n))
    got = [(x["low"], x["high"], x["n"]) for x in stats.equi_depth(spark.createDataFrame([(x,) for x in [*v, None]], "v double"), F.col("v")).orderBy("bucket").collect()]
    k = min(20, n)
    size = [n // k + (i < n % k) for i in range(k)] if k else []
    at, want = 0, []
    for s in size:
        want.append((v[at], v[at + s - 1], s))
        at += s
    assert got == want


def test_approximate_histogram_covers_all(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    rows = stats.equi_depth_approx(df, F.col("v")).orderBy("bucket").collect()
    assert len(rows) == 20 and rows[0]["low"] == 0 and rows[-1]["high"] == 9999 and all(abs(r["high"] - r["low"] - 500) < 20 for r in rows)


def test_selectivity(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", dim=1)
    c.insert_many([(i, [1.0], {"n": i, "s": "ab"[i % 2], "b": i % 4 == 0, "t": ["x"] if i % 5 else ["x", "y"], "mixed": i if i % 2 else str(i)} | ({"rare": 1} if i % 10 == 0 else {})) for i in range(200)])
    c.checkpoint()
    share = lambda p: stats.selectivity(parse_predicate(p), c.stats)
    for p, want in (("s = 'a'", 0.5), ("b = TRUE", 0.25), ("n < 50", 0.25), ("n >= 150", 0.25), ("n BETWEEN 50 AND 99", 0.25), ("t @> 'y'", 0.2), ("rare IS NOT NULL", 0.1), ("NOT rare IS NOT NULL", 0.9), ("s = 'a' AND b = TRUE", 0.125), ("s = 'a' OR b = TRUE", 0.625), ("s IN ('a', 'b')", 1.0), ("n = 7", 1 / 200)):
        assert abs(share(p) - want) < 0.03, p
    assert share("mixed = 1") is None and share("nothing = 1 AND n = 1") is None
