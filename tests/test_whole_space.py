"""Figures about a space come from every vector: no id here is divisible by 100."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import proximity
from sparkloom.operators.ordering import places_by_steps, places_of
from sparkloom.plans import registry

N = 60


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    """(folder with embeddings of ids 1..N, their vectors, their labels)."""
    rng = np.random.default_rng(4)
    v, labels = rng.normal(size=(N, 64)).astype(np.float32), [i % 3 for i in range(N)]
    d = str(tmp_path_factory.mktemp("space"))
    rows = [(i + 1, v[i].tolist(), labels[i]) for i in range(N)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, v.astype(float), labels


def near(v, k):
    """For each row its k nearest others as (score, row)."""
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    scores = np.round(u @ u.T, 6)
    return [sorted((-scores[i, j], j) for j in range(len(v)) if j != i)[:k] for i in range(len(v))]


def plain_auc(pairs):
    ahead = [(x > y) + (x == y) / 2 for x, one in pairs if one for y, other in pairs if not other]
    return sum(ahead) / len(ahead)


def test_label_auc_of_every_vector(spark, space):
    d, v, labels = space
    pairs = [(-s, labels[i] == labels[j]) for i, row in enumerate(near(v, 20)) for s, j in row]
    assert [r.auc for r in registry.queries()["label_auc"](spark, d).collect()] == [pytest.approx(plain_auc(pairs), abs=1e-6)]


@pytest.mark.parametrize("tasks", [1, 7])
def test_auc_over_ranges(spark, tasks):
    rng = np.random.default_rng(5)
    pairs = [(float(x), bool(y)) for x, y in zip(rng.integers(0, 40, 300) / 8, rng.integers(0, 2, 300), strict=True)]
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert proximity.auc(spark.createDataFrame(pairs, "score double, same boolean")).first().auc == pytest.approx(plain_auc(pairs), abs=1e-6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert proximity.auc(spark.createDataFrame([(0.5, True)], "score double, same boolean")).first().auc is None


def test_percentiles_of_every_vector(spark, space):
    d, v, labels = space
    scores = {x: sorted(-s for i, row in enumerate(near(v, 20)) if labels[i] == x for s, _ in row) for x in set(labels)}
    want = [(x, len(s), s[0], s[len(s) // 10], s[len(s) // 2], s[-1]) for x, s in sorted(scores.items())]
    got = registry.queries()["similarity_percentiles"](spark, d).select("label", "n", "least", "p10", "median", "most").orderBy("label").collect()
    assert [tuple(r) for r in got] == [pytest.approx(w, abs=2e-6) for w in want]


def test_overlap_of_every_vector(spark, space):
    d, v, _ = space
    want = [(i + 1, n, n / 10) for i, (one, other) in enumerate(zip(near(v, 10), near(v[:, :32], 10), strict=True)) for n in [len({j for _, j in one} & {j for _, j in other})]]
    got = registry.queries()["space_overlap"](spark, d).select("query_id", "shared", "overlap").orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [pytest.approx(w) for w in want]


def test_places_by_steps_as_by_numbers(spark):
    rng = np.random.default_rng(6)
    groups = [None, "a", "b", "c"]
    rows = [(groups[i % 4], float(x)) for i, x in enumerate(rng.integers(-90, 90, 403) / 1000)] + [("c", 0.5)] * 50 + [("d", float("nan")), ("d", 0.1)]
    df = spark.createDataFrame(rows, "g string, x double")
    places = {"low": "0L", "p10": "n div 10", "mid": "n div 2", "high": "n - 1", "beyond": "n"}
    one, other = (sorted(map(str, f.collect())) for f in (places_by_steps(df, "g", "x", places, F.round("x", 2)), places_of(df, "g", "x", places)))
    assert len(one) == 5
    assert one == other
