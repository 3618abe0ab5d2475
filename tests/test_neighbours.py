"""Nearest neighbours: odd vectors against a plain version, and queries at a size where a row for each pair shows."""

import math
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search, tiles
from sparkloom.plans import registry

SIZED = "/root/testdata/check_s"
#: 10256 vectors and 103 queries make 1056368 pairs.
MOST_ROWS = 300_000
QUERIES = [
    "admit",
    "admit_cards",
    "fuse_many",
    "fuse_many_from_zero",
    "in_window",
    "knn_cosine",
    "label_auc",
    "recall_at_k",
    "shortlist_cards",
    "similarity_percentiles",
    "space_overlap",
]


def rows_made(spark, run):
    """The largest number of rows that a step of run's jobs puts out."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda x: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(x)
    before = {e.executionId() for e in listed(store.executionsList())}
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for e in listed(store.executionsList()):
        if e.executionId() in before:
            continue
        values = listed(store.executionMetrics(e.executionId()))
        for node in listed(store.planGraph(e.executionId()).allNodes()):
            for m in listed(node.metrics()):
                if m.name() == "number of output rows" and values.get(m.accumulatorId()):
                    most = max(most, int(values[m.accumulatorId()].replace(",", "")))
    return most


@pytest.mark.skipif(not Path(SIZED).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUERIES)
def test_no_row_for_each_pair(spark, name):
    df = registry.queries()[name]
    assert rows_made(spark, lambda: df(spark, SIZED).write.format("noop").mode("overwrite").save()) < MOST_ROWS


def plain_score(a, b):
    if None in (*a, *b) or len(a) != len(b):
        return None
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
    norms = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    if norms == 0:
        return None
    score = dot(a, b) / norms
    return score if score != score else float(Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("k", [2, 100])
def test_odd_vectors(spark, own, k):
    odd = [[math.nan, 1.0], [math.inf, 2.0], [0.0, 0.0], [1e200, 1e200], [1e-200, 2e-200], [1.0, None], [1.0], [], None, [-3.0, 4.0], [3.0, -4.0]]
    rows = list(enumerate(odd)) + [(i, [float(i * 7 % 5 - 2), float(i * 3 % 4)]) for i in range(11, 40)] + [(3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = []
    for query in range(40):
        pairs = [(plain_score(a, b), j) for i, a in rows if i == query and a for j, b in rows if b and not (own and i == j)]
        first = sorted((-math.inf if s != s else -s, j, s) for s, j in pairs if s is not None)[:k]
        want += [(query, n, j, repr(s + 0.0)) for n, (_, j, s) in enumerate(first, 1)]
    got = search.nearest(df, df.select(F.col("id").alias("query_id"), "v"), k, own=own).collect()
    assert sorted((r.query_id, r["rank"], r.id, repr(r.score + 0.0)) for r in got) == sorted(want)


def test_tile_rounds_halves_by_components():
    rng = np.random.default_rng(2)
    c = rng.integers(-3, 4, (700, 3)).astype(float)
    c[:200] = c[0]
    q = c[[0, 5, 300]]
    at, to, scores = tiles.best(q, c, [(0, 1), (0, 0), (300, 301)], 9)
    for i, (first, last) in enumerate([(0, 1), (0, 0), (300, 301)]):
        known = [(plain_score(q[i].tolist(), b.tolist()), j) for j, b in enumerate(c) if not first <= j < last]
        assert list(zip(scores[at == i].tolist(), to[at == i].tolist(), strict=True)) == sorted(((s, j) for s, j in known if s is not None), key=lambda x: (-x[0], x[1]))[:9]
