"""Numbering and places in orders with ties, hot values, nulls and no rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.ordering import numbered, places_of


def no_single_task(df):
    """No exchange of the plan brings all rows of a table to one task."""
    return "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, hot", [(0, 0.0), (1, 0.0), (3000, 0.0), (3000, 0.6)])
def test_numbers_are_places(spark, n, hot):
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.02 else 7 if rng.random() < hot else rng.randrange(50)) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, x long").repartition(5)
    out = numbered(frame, F.col("x").desc_nulls_last(), "id")
    assert out.columns == ["id", "x", "seq"] and no_single_task(out)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r.seq for r in out.collect()} == {i: k + 1 for k, (i, _) in enumerate(want)}
    ties = numbered(frame, "x").collect()
    assert sorted(r.seq for r in ties) == list(range(1, n + 1))
    by = sorted((r.seq, r.x is not None, r.x or 0) for r in ties)
    assert [b[1:] for b in by] == sorted(b[1:] for b in by)


def test_places_of_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), 0.5 if rng.random() < 0.5 else rng.random()) for _ in range(2000)] + [("c", 1.0)]
    found = {r.g: (r.n, r.low, r.mid, r.high, r.beyond) for r in places_of(spark.createDataFrame(rows, "g string, x double"), "g", "x", {"low": "0L", "mid": "n div 2", "high": "n - 1", "beyond": "n"}).collect()}
    for g in "abc":
        x = sorted(v for k, v in rows if k == g)
        assert found[g] == (len(x), x[0], x[len(x) // 2], x[-1], None)
    assert places_of(spark.createDataFrame([], "g string, x double"), "g", "x", {"a": "0L"}).collect() == []
