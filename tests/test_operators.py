"""Operators on small hand-made inputs."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import graph, relations, search, segmentation, sync


def test_fuse_gives_the_published_scores(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 1.0)], "id string, score double")
    got = [tuple(r) for r in search.fuse([("a", a), ("b", b)]).collect()]
    assert got == [("y", 0.032522, "a"), ("x", 0.016393, "a")]


def test_pairs_after_a_leading_assistant_turn(spark):
    turns = [(1, 0, "assistant", "a0"), (1, 1, "user", "u1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a3"), (1, 4, "user", "u4")]
    got = segmentation.question_answers(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("pair").collect()
    assert [(r.question, r.answer) for r in got] == [("u1", "a0"), ("u2", "a3"), ("u4", "")]


def test_plan_sync_counts_equal_paragraphs(spark):
    side = lambda rows: spark.createDataFrame(rows, "file string, digest string, position int, id string")
    stored = side([("f", "p", 0, "s0"), ("f", "p", 1, "s1"), ("f", "q", 2, "s2")])
    fresh = side([("f", "p", 0, "n0"), ("f", "r", 2, "n2")])
    got = {tuple(r) for r in sync.plan_sync(stored, fresh).select("action", "stored_id", "fresh_id").collect()}
    assert got == {("keep", "s0", "n0"), ("retract", "s1", None), ("retract", "s2", None), ("add", None, "n2"), ("revise", "s2", "n2")}


def test_relations_close_and_resolve(spark):
    claims = [("b", "a", "supersedes", 1.0, 1), ("c", "b", "supersedes", 2.0, 2), ("c", "b", "supersedes", 3.0, 3), ("d", "d", "fixes", 1.0, 4), ("x", "y", "supersedes", 1.0, 5), ("y", "x", "supersedes", 1.0, 6)]
    links = relations.record_relations(spark.createDataFrame(claims, "src string, dst string, kind string, at double, seq long"))
    assert links.count() == 4
    assert {tuple(r) for r in relations.current_versions(links).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


def test_pagerank_matches_a_plain_iteration(spark):
    links = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5)]
    edges = spark.createDataFrame(links, "src long, dst long")
    seeds = spark.createDataFrame([(0, 1.0), (9, 1.0)], "node long, weight double")
    nodes = [0, 1, 2, 3, 4, 5, 9]
    near = {n: [b for a, b in links if a == n] + [a for a, b in links if b == n] for n in nodes}
    p = {n: 0.5 if n in (0, 9) else 0.0 for n in nodes}
    rank = dict.fromkeys(nodes, 1 / 7)
    while True:
        loose = sum(r for n, r in rank.items() if not near[n])
        new = {n: 0.85 * (sum(rank[m] / len(near[m]) for m in near[n]) + loose * p[n]) + 0.15 * p[n] for n in nodes}
        moved, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if moved < 7 * 1e-4:
            break
    got = {r.node: r.rank for r in graph.pagerank(edges, seeds, tolerance=1e-4).collect()}
    assert got.keys() == rank.keys() and np.allclose([got[k] for k in nodes], [rank[k] for k in nodes], atol=1e-8)


def test_text_functions(spark):
    row = spark.range(1).select(T.squash(F.lit(" a \n b\t")).alias("s"), T.clip(F.lit("abcd ef"), 5).alias("c"), T.scrubbed(F.lit("k=sk-" + "a" * 20)).alias("k"), T.relative(F.lit("/r/x/y"), "/r").alias("p"), T.degree_budget(F.lit(2)).alias("d")).first()
    assert (row.s, row.c, row.k.text, row.k.found, row.p, row.d) == ("a b", "abcd …", "k=<secret-removed:sk-a>", 1, "x/y", 2)


def test_settled_stream_and_synced_batches(spark, tmp_path):
    from sparkloom.streaming.debounce import settled_stream, sync_batches

    spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:10"), ("k", "2024-01-02 00:00:00")], "key string, t string").select("key", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = settled_stream(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in"), ["key"], "ts", "1 minute", "1 minute")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    run = sync_batches(f"{tmp_path}/sync")
    version = lambda rows: spark.createDataFrame(rows, "file string, digest string, position int, id string")
    run(version([("f", "p", 0, "1")]), 0)
    run(version([("f", "q", 0, "2")]), 1)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/sync/plan").select("batch", "action").collect()}
    assert got == {(0, "add"), (1, "add"), (1, "retract"), (1, "revise")}
    run(version([("f", "q", 0, "2")]), 1)  # a replay changes nothing
    run(version([("g", "p", 0, "3"), ("g", "r", 1, "4")]), 2)
    run(version([("g", "r", 0, "5")]), 3)
    got = sorted((r.batch, r.action) for r in spark.read.parquet(f"{tmp_path}/sync/plan").collect())
    assert got == [(0, "add"), (1, "add"), (1, "retract"), (1, "revise"), (2, "add"), (2, "add"), (3, "keep"), (3, "retract")]
