"""Proximity graphs: proposals, fusion of layers, grafting under a degree budget, and how healthy the result is."""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph, search
from sparkloom.operators.lineage import cut_lineage
from sparkloom.operators.ordering import places_of

EDGE = "u string, v string, similarity double"


def propose(vectors: DataFrame, per_node: int = 64) -> DataFrame:
    """u, v, similarity: each vector (id, v) with its per_node nearest, pairs once (u < v), the larger score."""
    near = search.nearest(vectors, vectors.select(F.col("id").alias("query_id"), "v"), per_node)
    pairs = near.select(F.least("query_id", "id").alias("u"), F.greatest("query_id", "id").alias("v"), F.col("score").alias("similarity"))
    return pairs.groupBy("u", "v").agg(F.max("similarity").alias("similarity"))


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """u, v, similarity, sources: pairs of several layers as one, the largest similarity, who has them."""
    every = None
    for name, edges in layers.items():
        one = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "similarity", F.lit(name).alias("source"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("u", "v").agg(F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("source")).alias("sources"))


def fuse_layers(layers: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """u, v, similarity: reciprocal rank fusion of pairs, each layer by falling similarity with places from 0.

    Places over a whole layer come from counts: pairs are dealt by ranges of similarity,
    ranked within a range, and the larger ranges' counts are added.
    """
    every = None
    for edges in layers.values():
        pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "similarity", F.floor(F.col("similarity") * 4096).alias("part"))
        within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("similarity"), "u", "v")) - 1
        above = pairs.groupBy("part").agg(F.count("*").alias("n"))
        above = above.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 8193 parts
        placed = pairs.withColumn("r", within).join(above, "part").select("u", "v", (F.col("r") + F.col("before")).alias("place"))
        every = placed if every is None else every.unionByName(placed)
    return every.groupBy("u", "v").agg(F.sum(1 / (F.lit(k + 1) + F.col("place"))).alias("similarity"))


def threshold(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("similarity") >= least)


# ---------------------------------------------------------------- order-dependent selection


class Grafting:
    """Degrees under a budget d: while both ends have more than half of it left a link is taken,
    then with a falling chance, and never beyond 2 d."""

    def __init__(self, budget: int, cap: int | None, seed: int):
        self.budget, self.cap, self.random = budget, cap if cap is not None else 2 * budget, random.Random(seed)
        self.degree: dict[str, int] = {}
        self.refused: dict[str, tuple[str, str, float]] = {}

    def chance(self, u: str, v: str) -> float | None:
        """How likely the link is; None where an end is at the cap."""
        a, b = self.degree.get(u, 0), self.degree.get(v, 0)
        if max(a, b) >= self.cap:
            return None
        left = max(0, self.budget - a) * max(0, self.budget - b)
        return min(1.0, left / max(1.0, self.budget / 2) ** 2) if left else 1 / self.budget

    def offer(self, u: str, v: str, similarity: float) -> bool:
        p = self.chance(u, v)
        if p is not None and self.random.random() < p:
            self.take(u, v)
            return True
        for node in (u, v):
            if node not in self.refused or similarity > self.refused[node][2]:
                self.refused[node] = (u, v, similarity)
        return False

    def take(self, u: str, v: str) -> None:
        for node in (u, v):
            self.degree[node] = self.degree.get(node, 0) + 1


def grafted(candidates: Iterable[tuple[str, str, float]], budget: int, cap: int | None = None, rescue: bool = True, seed: int = 0) -> list[tuple[str, str, float]]:
    """Links of candidates in the given order; with rescue each node that got none has its best refused one."""
    state, taken, out = Grafting(budget, cap, seed), set(), []
    for u, v, similarity in candidates:
        pair = (min(u, v), max(u, v))
        if u != v and pair not in taken and state.offer(u, v, similarity):
            taken.add(pair)
            out.append((u, v, similarity))
    if rescue:
        for node, (u, v, similarity) in list(state.refused.items()):
            pair = (min(u, v), max(u, v))
            if not state.degree.get(node) and pair not in taken:
                taken.add(pair)
                state.take(u, v)
                out.append((u, v, similarity))
    return out


def matched(candidates: Iterable[tuple[str, str, float]], k: int) -> list[tuple[str, str, float]]:
    """Candidates in order while both ends have fewer than k links."""
    degree: dict[str, int] = {}
    out = []
    for u, v, similarity in candidates:
        if degree.get(u, 0) < k and degree.get(v, 0) < k:
            degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
            out.append((u, v, similarity))
    return out


def graft(edges: DataFrame, group: str, budget: int, cap: int | None = None, rescue: bool = True, seed: int = 0) -> DataFrame:
    """group, u, v, similarity: grafted links of each group's candidates by falling similarity.

    Each decision depends on all before it, so a group (a project) is one task; groups go side by side.
    """
    kind = edges.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["similarity", "u", "v"], ascending=[False, True, True], kind="stable")
        out = pd.DataFrame(grafted(rows[["u", "v", "similarity"]].itertuples(index=False, name=None), budget, cap, rescue, seed), columns=["u", "v", "similarity"])
        out.insert(0, group, rows[group].iloc[0])
        return out

    return edges.select(group, F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "similarity").groupBy(group).applyInPandas(run, f"{group} {kind}, {EDGE}")


def greedy_matching(edges: DataFrame, group: str, k: int) -> DataFrame:
    """group, u, v, similarity: links by falling similarity while both ends have fewer than k; one task a group."""
    kind = edges.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["similarity", "u", "v"], ascending=[False, True, True], kind="stable")
        out = pd.DataFrame(matched(rows[["u", "v", "similarity"]].itertuples(index=False, name=None), k), columns=["u", "v", "similarity"])
        out.insert(0, group, rows[group].iloc[0])
        return out

    return edges.select(group, F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "similarity").groupBy(group).applyInPandas(run, f"{group} {kind}, {EDGE}")


# ---------------------------------------------------------------- health of a graph


def connectivity(nodes: DataFrame, edges: DataFrame, margin: float = 3.0) -> DataFrame:
    """One row: n, m, c, median and largest degree, ln n, the budget that connects it, isolated nodes and how many a
    random graph would have, traversal depth, share of edge ends at the 1 % of nodes of most links.

    The median counts isolated nodes and is the mean of the two middle ones.
    """
    per = nodes.join(graph.degrees(edges), "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    hist = cut_lineage(per.groupBy("degree").agg(F.count("*").alias("k")))  # one row a degree
    below = F.sum("k").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hist.withColumns({"upto": below, "before": above, "n": F.sum("k").over(Window.partitionBy()), "ends": F.sum(F.col("k") * F.col("degree")).over(Window.partitionBy())})
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("degree")))
    top = F.greatest(F.lit(1), F.expr("n div 100"))
    hot = F.sum(F.col("degree") * F.greatest(F.lit(0), F.least(F.col("k"), top - F.col("before"))))
    row = ranked.agg(F.max("n").alias("n"), F.expr("max(ends) div 2").alias("m"), F.max("degree").alias("max_degree"), F.max(F.when(F.col("degree") == 0, F.col("k")).otherwise(0)).alias("isolated"), hot.alias("hot"), ((at(F.expr("(n - 1) div 2")) + at(F.expr("n div 2"))) / 2).cast("int").alias("median"))
    c, ln = 2.0 * F.col("m") / F.col("n"), F.when(F.col("n") > 1, F.ln("n")).otherwise(F.lit(0.0))
    return row.select(
        "n", "m", F.round(c, 2).alias("c"), "median", "max_degree", F.round(ln, 2).alias("ln_n"), F.greatest(F.lit(2), F.ceil(margin * ln).cast("int")).alias("budget"),
        (c >= margin * ln).alias("connected"), "isolated", F.round(100.0 * F.exp(-c), 2).alias("isolated_random_pct"),
        F.when(c <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(ln / F.ln(c)).cast("int"))).alias("depth"),
        F.round(100.0 * F.col("hot") / F.greatest(F.lit(1), 2 * F.col("m")), 1).alias("hot_share_pct"),
    )


def coagulation(nodes: DataFrame, edges: DataFrame, days: float = 21.0) -> DataFrame:
    """One row: edges, share of continuations, pairs between branches and over more than `days`, continuations over them.

    nodes: id, branch, at; edges: src, dst, kind. Edges of unknown ends count in the first two only.
    """
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("branch").alias(f"{x}_branch"), F.col("at").alias(f"{x}_at"))
    joined = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    known = F.col("src_branch").isNotNull() & F.col("dst_branch").isNotNull()
    far = known & (F.col("src_at") != 0) & (F.col("dst_at") != 0) & (F.abs(F.col("src_at") - F.col("dst_at")) / 86400 > days)
    share = lambda cond, of: F.round(100.0 * F.count_if(cond) / F.greatest(F.lit(1), F.count_if(of)), 2)
    cont = F.col("kind") == "continues"
    return joined.agg(F.count("*").alias("edges"), share(cont, F.lit(True)).alias("continues_pct"), share(known & (F.col("src_branch") != F.col("dst_branch")), known).alias("between_pct"), share(far, known).alias("far_pct"), F.count_if(far & cont).alias("far_continues"))


index_percentiles = places_of


def auc(pairs: DataFrame) -> DataFrame:
    """One row, auc: how likely a pair of class 1 (same) scores above one of class 0, ties by half.

    Scores are counted first, so the ranks run over distinct scores, dealt by ranges; no task sees them all.
    """
    counts = pairs.groupBy("score").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("q"))
    dealt = cut_lineage(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.groupBy("part").agg(F.sum("q").alias("q")).select("part", upto(Window.orderBy("part")).alias("before"))  # one row a range
    below = F.col("before") + upto(Window.partitionBy("part").orderBy("score"))
    won = dealt.join(F.broadcast(before), "part").select("p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("won"))
    return won.agg(F.round(F.sum("won") / F.nullif(F.sum("p").cast("double") * F.sum("q"), F.lit(0.0)), 6).alias("auc"))


def cosine_quantiles(vectors: DataFrame, pairs: DataFrame, at: tuple[float, ...] = (0.9, 0.97, 0.99)) -> DataFrame:
    """One row, q: exact quantiles of the cosines of the given pairs (a, b) of vectors (id, v)."""
    from sparkloom.functions.vectors import cosine

    one = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    other = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    scored = pairs.join(one, "a").join(other, "b").select(cosine(F.col("va"), F.col("vb")).alias("c"))
    return scored.agg(F.transform(F.percentile("c", F.array(*map(F.lit, at))), lambda x: F.round(x, 6)).alias("q"))


# ---------------------------------------------------------------- maps between spaces by cluster


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """k unit centres of unit vectors (id, v): each round sums clusters on the executors; only k sums come back.

    Starts at the k rows of least seeded hash; a cluster that gets no row keeps its centre.
    """
    first = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("v").collect()  # k rows
    centres = np.array([r.v for r in first], float)
    for _ in range(rounds):
        sums = assigned(vectors, centres).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("double")).alias("x")).collect()
        new = np.zeros_like(centres)
        for r in sums:
            new[r.cluster, r.i] = r.x
        length = np.linalg.norm(new, axis=1)
        moved = np.where((length > 0)[:, None], new / np.maximum(length, 1e-300)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors plus cluster: the centre of largest product, the first of equal ones."""
    products = F.array(*(F.aggregate(F.zip_with(F.col("v"), F.array(*(F.lit(float(x)) for x in c)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) for c in centres))
    return vectors.withColumn("_p", products).withColumn("cluster", (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).drop("_p")


def seam_maps(pairs: DataFrame, k: int, least: int = 64, seed: int = 0) -> tuple[np.ndarray, list[list[list[float]]]]:
    """(centres, a matrix for each cluster) from pairs (id, src, dst); clusters of fewer than `least` anchors use the map of all."""
    from sparkloom.operators.spaces import fit_adapter

    anchors = cut_lineage(pairs.withColumnRenamed("src", "v"))
    centres = spherical_kmeans(anchors, k, seed=seed)
    clustered = cut_lineage(assigned(anchors, centres), anchors).withColumnRenamed("v", "src")
    sizes = {r.cluster: r["count"] for r in clustered.groupBy("cluster").count().collect()}  # k rows
    whole = fit_adapter(clustered)
    return centres, [fit_adapter(clustered.where(F.col("cluster") == j)) if sizes.get(j, 0) >= least else whole for j in range(len(centres))]


def carry_by_seam(vectors: DataFrame, centres: np.ndarray, maps: list[list[list[float]]]) -> DataFrame:
    """vectors (id, v) plus carried, by the map of their cluster."""
    from sparkloom.operators.spaces import adapt

    clustered = assigned(vectors, centres)
    out = F.lit(None).cast("array<double>")
    for j, m in enumerate(maps):
        out = F.when(F.col("cluster") == j, adapt(F.col("v"), m)).otherwise(out)
    return clustered.withColumn("carried", out)


def ridge(pairs: DataFrame, weight: float) -> list[list[float]]:
    """Matrix W with src @ W near dst under a penalty on its size, from sums of products of coordinates."""
    from sparkloom.operators.spaces import coordinate_sums

    gram, width = coordinate_sums(pairs)
    return np.linalg.solve(gram[:width, :width] + weight * np.eye(width), gram[:width, width:]).round(6).tolist() if width else []


def agreement(mapped: DataFrame, true: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean cosine of mapped to true vectors (id, v), and how many of the k nearest agree, itself excluded."""
    from sparkloom.functions.vectors import cosine
    from sparkloom.operators.spaces import neighbour_overlap

    asked = lambda d: d.select(F.col("id").alias("query_id"), "v")
    overlap = neighbour_overlap(search.nearest(true, asked(mapped), k), search.nearest(true, asked(true), k), k).agg(F.round(F.avg("overlap"), 4).alias("top"))
    both = mapped.select("id", F.col("v").alias("a")).join(true.select("id", F.col("v").alias("b")), "id").agg(F.round(F.avg(cosine(F.col("a"), F.col("b"))), 4).alias("cosine"))
    return both.crossJoin(overlap)  # one row by one row


def aligned(pairs: DataFrame, train: float = 0.7, gate: float = 0.8, seed: int = 0) -> tuple[list[list[float]], float, bool]:
    """(matrix, mean cosine on held-out pairs, whether it reaches the gate) of pairs (id, src, dst), split by a hash of id."""
    from sparkloom.functions.vectors import cosine
    from sparkloom.operators.spaces import adapt, fit_adapter

    held = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)) >= int(train * 1000)
    matrix = fit_adapter(pairs.where(~held))
    if not matrix:
        return matrix, 0.0, False
    mean = pairs.where(held).agg(F.avg(cosine(adapt(F.col("src"), matrix), F.col("dst")))).first()[0] or 0.0
    return matrix, mean, mean >= gate


def recall_at(ranked: DataFrame, evidence: DataFrame, kinds: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """way, kind, k, questions, recall: how often evidence is among the first k, in percent, for each way of ranking.

    ranked: way, question, rank, id; evidence: question, id; kinds: question, kind. A
    question without evidence doesn't count; one that a way finds nothing for is a miss. The
    kind 'all' is over all questions.
    """
    counted = kinds.join(evidence.select("question").distinct(), "question", "left_semi")
    best = ranked.join(evidence.distinct(), ["question", "id"], "left_semi").groupBy("way", "question").agg(F.min("rank").alias("rank"))
    asked = ranked.select("way").distinct().join(F.broadcast(counted.groupBy("kind").agg(F.count("*").alias("n"))), F.lit(True))  # one row a kind
    hits = best.join(counted, "question").withColumn("k", F.explode(F.array(*map(F.lit, at)))).groupBy("way", "kind", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"))
    every = asked.withColumn("k", F.explode(F.array(*map(F.lit, at)))).join(hits, ["way", "kind", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    share = lambda rows, *by: rows.groupBy(*by).agg(F.sum("n").alias("questions"), F.round(100.0 * F.sum("hits") / F.sum("n"), 1).alias("recall"))
    whole = share(every, "way", "k").withColumn("kind", F.lit("all"))
    return share(every, "way", "kind", "k").unionByName(whole)
