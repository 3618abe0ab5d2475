"""Adapters, routes and agreement of embedding spaces on small rows."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import spaces


def _pairs(spark, src, dst):
    return spark.createDataFrame(list(zip(src, dst, strict=True)), "src array<double>, dst array<double>")


def test_fit_turns_and_stretches(spark):
    assert spaces.fit_adapter(_pairs(spark, [[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [-1.0, 0.0]])) == [[0.0, 1.0], [-1.0, 0.0]]
    assert spaces.fit_adapter(_pairs(spark, [[1.0], [2.0]], [[2.0, 0.0], [4.0, 0.0]])) == [[2.0, 0.0]]
    assert spaces.fit_adapter(_pairs(spark, [], [])) == []
    assert spaces.fit_adapter(_pairs(spark, [[1.0], None, [float("nan")], [None], []], [[2.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0]])) == [[2.0, 1.0]]


def test_fit_equals_the_plain_solutions(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(60, 6)), rng.normal(size=(60, 6)), rng.normal(size=(60, 4))
    left, _, right = np.linalg.svd(a.T @ b)
    assert np.allclose(spaces.fit_adapter(_pairs(spark, a.tolist(), b.tolist())), left @ right, atol=2e-6)
    assert np.allclose(spaces.fit_adapter(_pairs(spark, a.tolist(), c.tolist())), np.linalg.lstsq(a, c, rcond=None)[0], atol=2e-6)


def test_carry_guards(spark):
    turn = [[0.0, 1.0], [-1.0, 0.0]]
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None]), (6, [1.0, float("inf")]), (7, [1.0, 2e6]), (8, [float("nan"), 1.0]), (9, [])], "id int, v array<double>")
    got = {r.id: r.carried for r in spaces.carry(rows, turn).collect()}
    assert got == {1: [0.0, 1.0], 2: [0.0, 0.0]} | {i: [] for i in range(3, 10)}
    for bad in ([], [[]], [[1.0], [1.0, 2.0]], [[float("nan"), 1.0], [1.0, 1.0]]):
        assert {tuple(r.carried) for r in spaces.carry(rows, bad).collect()} == {()}
    assert spaces.carry(rows.limit(0), turn).count() == 0


def test_routes(spark):
    def routes(stored, ready, adapters):
        s = spark.createDataFrame(list(enumerate(stored)), "position int, space string")
        r = spark.createDataFrame([(x,) for x in ready], "space string")
        a = spark.createDataFrame([(i, *x) for i, x in enumerate(adapters)], "position int, source string, target string")
        return [tuple(x)[1:] for x in spaces.plan_routes(s, r, a).orderBy("position").collect()]

    assert routes(["a", "b"], ["a", "a"], [("a", "b")]) == [("a", "direct", "a"), ("b", "adapter", "a")]
    assert routes(["b"], [], [("a", "b")]) == []
    assert routes(["b", None], ["a", "c", None], [("x", "b"), ("c", "b"), ("a", "b"), (None, "b")]) == [("b", "adapter", "c")]


def test_overlap(spark):
    near = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, id int")
    got = spaces.neighbour_overlap(near([(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 9)]), near([(1, 1, 6), (1, 2, 8), (1, 3, 7)]), 2).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0.5), (2, 0, 0.0)]
    assert spaces.neighbour_overlap(near([]), near([]), 2).select(F.count("*")).first()[0] == 0
