"""Graph statistics, reachability and ranking over edge tables (src, dst)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage, release


def simple(edges: DataFrame) -> DataFrame:
    """u < v: undirected, parallel edges once, no loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree in the simple graph."""
    return simple(edges).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m, mean degree, isolated nodes, largest and median (upper, of connected nodes) degree."""
    d = degrees(edges)
    per = nodes.join(d, "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    out = per.agg(F.count("*").alias("n"), F.sum("degree").alias("ends"), F.count_if(F.col("degree") == 0).alias("isolated"), F.max("degree").alias("max_degree"))
    hist = per.where("degree > 0").groupBy("degree").count()
    # upper median from the histogram of degrees, which has few rows
    below = F.sum("count").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(Window.partitionBy())
    median = hist.select("degree", below.alias("b"), total.alias("t")).where(F.expr("b > t div 2")).agg(F.min("degree").alias("median_degree"))
    return out.crossJoin(median).select("n", F.expr("ends div 2").alias("m"), F.round(F.col("ends") / F.col("n"), 6).alias("c"), "isolated", "max_degree", "median_degree")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, by alternating star contractions.

    Every round shrinks paths at least by half; minima are aggregated before each shuffle
    and joined back, so a node of very many links is no single task's group. Loops and null
    ends are ignored; without edges there are no rows.
    """
    e = cut_lineage(simple(edges).select(F.col("v").alias("a"), F.col("u").alias("b")))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = cut_lineage(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).distinct(), e)
        now = e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: breadth-first layers along src -> dst, each node at its least hop; seeds are hop 0.

    Each hop ends its lineage, and the walk ends with the first empty layer.
    """
    seen = cut_lineage(seeds.select("node", F.lit(0).alias("hop")).distinct())
    for h in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == h - 1).select(F.col("node").alias("src"))
        step = edges.join(frontier, "src").select(F.col("dst").alias("node")).distinct()
        layer = cut_lineage(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h)))
        if layer.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(layer), seen, layer)
    return seen


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, rank: personalised PageRank of the simple graph; seeds (node, weight) get the restarts.

    Stops when ranks move by less than nodes * tolerance in all, or after `rounds` rounds.
    Links are dealt by their source once and kept on the executors (lost ones are dealt
    anew), so that a round moves ranks and sums only: one join, one aggregation that combines
    before its shuffle, and one job, which also tells how far ranks moved. It ends its
    lineage. Nodes without links hand their rank to the seeds.
    """
    s = simple(edges)
    out = cut_lineage(s.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(s.select(F.col("v").alias("src"), F.col("u").alias("dst"))))
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    counts = out.groupBy("src").agg(F.count("*").alias("d"))
    nodes = counts.select(F.col("src").alias("node"), "d").unionByName(seeds.select("node", F.lit(0).cast("long").alias("d"))).groupBy("node").agg(F.max("d").alias("d"))
    start = cut_lineage(nodes.join(seeds.groupBy("node").agg((F.sum("weight") / F.lit(total)).alias("p")), "node", "left").select("node", "d", F.coalesce("p", F.lit(0.0)).alias("p")))
    n, loose = start.select(F.count("*"), F.coalesce(F.sum(F.when(F.col("d") == 0, 1.0)), F.lit(0.0))).first()
    loose /= max(n, 1)
    links = out.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    rank = cut_lineage(start.withColumn("rank", F.lit(1.0 / max(n, 1))), start)
    for _ in range(rounds):
        given = rank.where("d > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("d")).alias("given"))
        flow = links.join(given, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("given").alias("flow"))
        fresh = alpha * (F.coalesce("flow", F.lit(0.0)) + F.lit(loose) * F.col("p")) + (1 - alpha) * F.col("p")
        moved = F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_before"))), F.lit(0.0))
        seen = Observation()
        now = rank.join(flow, "node", "left").select("node", "d", "p", fresh.alias("rank"), F.col("rank").alias("_before"))
        now = now.observe(seen, moved.alias("moved"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"))
        rank = cut_lineage(now.select("node", "d", "p", "rank"), rank)
        loose = seen.get["loose"]
        if seen.get["moved"] < n * tolerance:
            break
    links.unpersist()
    release(out)
    return rank.select("node", "rank")
