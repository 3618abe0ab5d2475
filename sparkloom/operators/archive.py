"""Views of an archive of branches: lists, lineages, loose ends, manifests and layered searches.

A node has id, file, branch, index (its place in the archive), at, text, question, answer,
status, root_similarity, v (unit vector); an edge src, dst, kind, seq; a branch id, root,
head, weight, activation, dormant, variance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import day, temporal_affinity
from sparkloom.functions.vectors import dot, unit
from sparkloom.operators import relations
from sparkloom.operators.context import entropy
from sparkloom.operators.lineage import cut_lineage
from sparkloom.operators.ordering import places_of
from sparkloom.operators.selection import first_per

RELATIONS = ("contradicts", "fixes", "refines", "supersedes", "returns_to")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def loose_heads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, branch: heads (last nodes) of branches that nothing goes on from and nothing returns to.

    nodes: id, branch, index, parent.
    """
    heads = nodes.groupBy("branch").agg(F.max_by("id", "index").alias("id"))
    returns = edges.where("kind = 'returns_to'")
    left = heads.join(nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL"), "id", "left_anti")
    for end in ("src", "dst"):
        left = left.join(returns.select(F.col(end).alias("id")), "id", "left_anti")
    return left.select("id", "branch")


def branch_list(branches: DataFrame, nodes: DataFrame, with_dormant: bool = True, least_similarity: float | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
    """Branches by falling weight, then atoms: their size, state, the root's file and similarity, previews of root and head."""
    sizes = nodes.groupBy(F.col("branch").alias("id")).agg(F.count("*").alias("atoms"))
    side = lambda x: nodes.select(F.col("id").alias(x), F.left("text", F.lit(120)).alias(f"{x}_preview"), *([F.col("file"), F.round("root_similarity", 4).alias("root_similarity")] if x == "root" else []))
    rows = branches.join(sizes, "id", "left").join(side("root"), "root", "left").join(side("head"), "head", "left")
    if not with_dormant:
        rows = rows.where("NOT dormant")
    if file is not None:
        rows = rows.where(F.col("file") == file)
    if least_similarity is not None:
        rows = rows.where(F.coalesce("root_similarity", F.lit(0.0)) >= least_similarity)
    fields = ["id", F.coalesce("atoms", F.lit(0)).alias("atoms"), F.round("variance", 4).alias("variance"), F.round("weight", 4).alias("weight"), F.round("activation", 4).alias("activation"), "dormant", F.coalesce("root_similarity", F.lit(0.0)).alias("root_similarity"), "root_preview", "head_preview", "file"]
    return rows.select(*fields).orderBy(F.desc("weight"), F.desc("atoms"), "id").limit(limit)


def branch_lineage(nodes: DataFrame, edges: DataFrame, most: int = 40, chars: int = 320) -> DataFrame:
    """branch, id, index, status, question, answer, relations of the last `most` atoms of each branch, in order."""
    last = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("index")))
    kept = nodes.withColumn("_n", last).where(F.col("_n") <= most)
    out = edges.where(F.col("kind").isin("supersedes", "fixes", "contradicts", "refines")).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "dst"))).alias("r"))
    joined = kept.join(out, "id", "left")
    relations = F.coalesce(F.transform("r", lambda x: F.concat(x["kind"], F.lit(" "), x["dst"].cast("string"))), F.array().cast("array<string>"))
    return joined.select("branch", "id", "index", "status", F.left("question", F.lit(chars)).alias("question"), F.left("answer", F.lit(chars)).alias("answer"), relations.alias("relations"))


def unresolved(nodes: DataFrame, edges: DataFrame, branches: DataFrame, limit: int = 50, least_similarity: float = 0.0, active_only: bool = True) -> DataFrame:
    """Loose heads of branches by falling similarity to the root."""
    live = branches.where("NOT dormant") if active_only else branches
    facts = nodes.select("id", F.left("text", F.lit(250)).alias("text"), "root_similarity", "file", "index").where(F.col("root_similarity") >= least_similarity)
    rows = loose_heads(nodes, edges).join(live.select(F.col("id").alias("branch")), "branch", "left_semi").join(facts, "id")
    return rows.select("branch", "id", "text", "root_similarity", "file", "index").orderBy(F.desc("root_similarity"), "id").limit(limit)


def open_threads(nodes: DataFrame, edges: DataFrame, now: float, days: int = 14, most: int = 5) -> DataFrame:
    """place, day, file, text of the latest loose heads of the last days, as a brief takes them: the question if there is one."""
    recent = nodes.where((F.col("status") != "retracted") & (F.col("at") >= now - days * 86400.0)).join(loose_heads(nodes, edges).select("id"), "id", "left_semi")
    first = recent.orderBy(F.desc("at"), "index").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("at"), "index"))
    return first.select(place.alias("place"), day(F.col("at")).alias("day"), "file", F.coalesce(F.nullif("question", F.lit("")), "text").alias("text"))


def typed_edges(edges: DataFrame, nodes: DataFrame, kind: str, node: str | None = None, branch: str | None = None, file: str | None = None, limit: int = 100, chars: int = 200) -> DataFrame:
    """The first edges (by seq) of a kind, at a node, or with an end in a branch or a file; with the ends' texts."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.left("text", F.lit(chars)).alias(f"{x}_text"), F.col("branch").alias(f"{x}_branch"), F.col("file").alias(f"{x}_file"))
    rows = edges.where(F.col("kind") == kind).join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    for value, column in ((branch, "branch"), (file, "file")):
        if value is not None:
            rows = rows.where((F.col(f"src_{column}") == value) | (F.col(f"dst_{column}") == value))
    if node is not None:
        rows = rows.where((F.col("src") == node) | (F.col("dst") == node))
    return rows.orderBy("seq").limit(limit).select("src", "dst", "kind", "src_text", "dst_text")


def relations_from(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int = 1, kinds: tuple[str, ...] = RELATIONS, chars: int = 200) -> DataFrame:
    """query, src, dst, kind, hop, text, status: typed relations by which a walk first finds each node, with what it finds.

    start: query, id. Each layer ends its lineage.
    """
    typed = edges.where(F.col("kind").isin(*kinds))
    both = typed.select(F.col("src").alias("a"), F.col("dst").alias("id"), "src", "dst", "kind", (F.col("seq") * 2).alias("seq")).unionByName(typed.select(F.col("dst").alias("a"), F.col("src").alias("id"), "src", "dst", "kind", (F.col("seq") * 2 + 1).alias("seq")))
    seen = cut_lineage(start.select("query", "id", F.lit(0).alias("hop"), F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit("").alias("kind")))
    for hop in range(1, max(1, depth) + 1):
        step = both.join(seen.where(F.col("hop") == hop - 1).select("query", F.col("id").alias("a")), "a").join(seen.select("query", "id"), ["query", "id"], "left_anti")
        layer = cut_lineage(first_per(step, ["query", "id"], [F.col("seq")]).select("query", "id", F.lit(hop).alias("hop"), "src", "dst", "kind"))
        if layer.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(layer), seen, layer)
    facts = nodes.select("id", F.left("text", F.lit(chars)).alias("text"), "status")
    return seen.where("hop > 0").join(facts, "id", "left").select("query", "src", "dst", "kind", "hop", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("status", F.lit("?")).alias("status"))


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """node, rank, other, similarity: each node's k strongest links of u, v, similarity, in both directions."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "similarity").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("node", "rank", "other", "similarity")


def file_manifest(nodes: DataFrame, file_edges: DataFrame) -> DataFrame:
    """file, folder, name, atoms, similarity, connected, isolated of each file.

    isolated: no connected file and a mean similarity to the root below the upper median of
    the files' means. file_edges: u, v.
    """
    per = nodes.groupBy("file").agg(F.count("*").alias("atoms"), F.avg(F.coalesce("root_similarity", F.lit(0.0))).alias("mean"))
    median = places_of(per.select(F.lit(0).alias("g"), "mean"), "g", "mean", {"median": "n div 2"}).select("median")
    ends = file_edges.select(F.col("u").alias("file"), F.col("v").alias("o")).unionByName(file_edges.select(F.col("v").alias("file"), F.col("u").alias("o")))
    connected = ends.groupBy("file").agg(F.count_distinct("o").alias("connected"))
    joined = per.join(connected, "file", "left").crossJoin(F.broadcast(median))  # one row
    n = F.coalesce("connected", F.lit(0))
    return joined.select("file", F.regexp_replace("file", r"/?[^/]*$", "").alias("folder"), F.regexp_extract("file", r"[^/]*$", 0).alias("name"), "atoms", F.round("mean", 4).alias("similarity"), n.alias("connected"), ((n == 0) & (F.col("mean") < F.col("median"))).alias("isolated"))


def centroids(nodes: DataFrame, by: str) -> DataFrame:
    """by, v: the unit mean vector of each group, summed before it is shuffled."""
    mean = nodes.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    return whole.select(by, unit(F.col("m")).alias("v"))


def file_graph(centres: DataFrame, least: float = 0.72) -> DataFrame:
    """u, v, similarity: files whose centroids (file, v) have a cosine of at least `least`, 4 decimals.

    Centroids are compared in a grid of blocks, so no side is broadcast and the join has a key.
    """
    blocks = max(1, -(-centres.count() // 2048))
    own = F.pmod(F.xxhash64("file"), F.lit(blocks)).cast("int")
    dealt = centres.select("file", "v", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = lambda n: dealt.select(F.col("file").alias(n), F.col("v").alias(f"v{n}"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    pairs = keyed("u").join(keyed("v"), ["x", "y"]).where("u < v")
    scored = pairs.select("u", "v", F.round(dot(F.col("vu"), F.col("vv")), 4).alias("similarity"), "vu").where(F.col("similarity") >= least)
    return scored.select("u", "v", "similarity").distinct()


def search_by_file(nodes: DataFrame, centres: DataFrame, links: DataFrame, query: list[float], k: int = 15, first: int = 5, most: int = 12) -> DataFrame:
    """id, score: the k nearest nodes of the files nearest to a query: the first files by centroid, then their
    best linked files (u, v, similarity) up to `most` in all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    top = centres.select("file", dot(F.col("v"), q).alias("s")).orderBy(F.desc("s"), "file").limit(first)
    top = cut_lineage(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "file"))))  # `first` rows
    ends = links.select(F.col("u").alias("file"), F.col("v").alias("other"), "similarity").unionByName(links.select(F.col("v").alias("file"), F.col("u").alias("other"), "similarity"))
    reached = ends.join(top.select("file", "rank"), "file").join(top.select(F.col("file").alias("other")), "other", "left_anti")
    nearest = first_per(reached, ["other"], [F.col("rank"), F.desc("similarity")]).orderBy("rank", F.desc("similarity"), F.desc("other")).limit(max(0, most - first))
    files = top.select("file").unionByName(nearest.select(F.col("other").alias("file")))
    return nodes.join(files, "file", "left_semi").select("id", F.round(dot(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_by_branch(nodes: DataFrame, query: list[float], now: float, top: int = 6, k: int = 15, per_file: int = 4) -> DataFrame:
    """id, score: the k nearest of the first per_file nodes of a file in each of the best branches.

    A branch scores 0.85 of its centroid's cosine and 0.15 of how recent its head is (half
    life 90 days).
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    heads = nodes.groupBy("branch").agg(F.max_by("at", "index").alias("at"))
    score = 0.85 * dot(F.col("v"), q) + 0.15 * temporal_affinity(F.col("at"), F.lit(now), 90.0)
    best = centroids(nodes, "branch").join(heads, "branch").select("branch", score.alias("s")).orderBy(F.desc("s"), "branch").limit(top)
    capped = nodes.join(best, "branch", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("branch", "file").orderBy("index"))).where(F.col("_n") <= per_file)
    return capped.select("id", F.round(dot(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def local_density(nodes: DataFrame, last: int = 8, least: float = 0.85) -> DataFrame:
    """branch, dense: how many of a branch's last atoms lie near its centroid."""
    recent = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("index")))).where(F.col("_n") <= last)
    near = recent.join(centroids(nodes, "branch").withColumnRenamed("v", "c"), "branch")
    return near.groupBy("branch").agg(F.count_if(dot(F.col("v"), F.col("c")) >= least).alias("dense"))


def branch_signature(nodes: DataFrame) -> DataFrame:
    """branch, first_at, last_at, files, folders, sessions: the span of a branch and counts by file, folder and session."""
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    histogram = lambda column, name: nodes.groupBy("branch", column.alias("x")).agg(F.count("*").alias("n")).groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias(name))
    span = nodes.groupBy("branch").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    out = span.join(histogram(F.col("file"), "files"), "branch").join(histogram(folder, "folders"), "branch")
    return out.join(histogram(F.col("session"), "sessions"), "branch")


def path_coherence_summary(nodes: DataFrame) -> DataFrame:
    """One row: mean, deviation and the values at places n div 10, n div 2 and 9n div 10 of path_coherence."""
    known = nodes.where("path_coherence IS NOT NULL").select(F.lit(0).alias("g"), "path_coherence")
    moments = known.groupBy("g").agg(F.round(F.avg("path_coherence"), 4).alias("mean"), F.round(F.stddev_pop("path_coherence"), 4).alias("deviation"))
    places = places_of(known, "g", "path_coherence", {"p10": "n div 10", "p50": "n div 2", "p90": "9 * n div 10"})
    return moments.join(places, "g").drop("g", "n")


def merged_feed(feeds: dict[str, DataFrame], limit: int = 120) -> DataFrame:
    """project, at, event: the newest events of several projects' feeds (at, event)."""
    out = None
    for name, feed in feeds.items():
        one = feed.select(F.lit(name).alias("project"), "at", "event")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("at"), "project", "event").limit(limit)


def decisions_markdown(decisions: DataFrame, title: str = "Decisions") -> DataFrame:
    """One row, text: decisions (kind, day, source, closed, new_text, old_text, at) as a list, newest first."""
    line = F.concat(F.lit("- "), "day", F.lit(" **"), "kind", F.lit("** ("), "source", F.when(F.col("closed"), F.lit(", closed")).otherwise(F.lit("")), F.lit("): "), "new_text", F.lit(" ← "), "old_text")
    rows = decisions.select(F.struct((-F.col("at")).alias("k"), line.alias("line")).alias("r"))
    return rows.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")).alias("text"))


# ---------------------------------------------------------------- an archive as one text


def latest(edges: DataFrame) -> DataFrame:
    """id, current: what each replaced node's chain of 'supersedes' ends in; of several replacements the first by seq counts, a cycle ends nowhere."""
    replaced = edges.where("kind = 'supersedes'").select("src", "dst", "kind", (-F.col("seq")).alias("valid_at"), F.lit(0.0).alias("invalid_at"))
    return relations.current_versions(replaced).where("current IS NOT NULL")


def snapshot(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 6000) -> DataFrame:
    """query, position, id, branch, tag, semantic, temporal, weight, tokens, piece, overflow: what a question's seeds bring along.

    seeds: query, place, id. First the seeds and the current versions of replaced ones, then
    their typed relations, then the last atoms of all their branches; each node once, under
    its first tag, as long as its piece fits the budget. A seed that doesn't fit is passed
    over; after the first piece that doesn't fit no relation or lineage follows (overflow).
    Positions go by index. A weight is 0.6 of semantic (1 for seeds, else the likeness to
    the root) and 0.4 of how near in time the first seed is. Unknown seeds are left out; the
    fold sees one question's candidates.
    """
    known = nodes.select("id", "branch", "index", "at", "text", "status", "root_similarity")
    asked = seeds.join(known.select("id"), "id", "left_semi").join(latest(edges), "id", "left")
    tag = F.when(F.col("current").isNull(), "SEED").otherwise(F.concat(F.lit("SEED_SUPERSEDED_BY_"), F.left(F.col("current").cast("string"), F.lit(8))))
    piece = lambda phase, order, ident, tag, chars: (F.lit(phase).alias("phase"), order.alias("order"), ident.alias("id"), tag.alias("tag"), F.lit(chars).alias("chars"))
    at = lambda a, b: F.struct(F.col(a).cast("long").alias("a"), (b if not isinstance(b, str) else F.col(b)).cast("long").alias("b"))
    first = asked.select("query", *piece(0, at("place", F.lit(0)), F.col("id"), tag, 500))
    newer = asked.where("current IS NOT NULL").select("query", *piece(0, at("place", F.lit(1)), F.col("current"), F.lit("CURRENT_VERSION"), 500))
    core = cut_lineage(first_per(first.unionByName(newer), ["query", "id"], [F.col("order")]))
    typed = edges.where(F.col("kind").isin(*RELATIONS))
    ends = typed.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", "seq").unionByName(typed.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", "seq"))
    related = core.join(ends, "id").select("query", *piece(1, at("order.a", "seq"), F.col("other"), F.upper("kind"), 250))
    near = core.unionByName(first_per(related, ["query", "id"], [F.col("order")]))
    branches = near.join(known.select("id", "branch"), "id").groupBy("query", "branch").agg(F.min(F.struct("phase", "order")).alias("_first"))
    placed = branches.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("_first", "branch")))
    last = known.withColumn("_k", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("index")))).where("_k <= 15")
    lineage = placed.join(last, "branch").select("query", *piece(2, at("_n", "index"), F.col("id"), F.lit("LINEAGE"), 150))
    every = first_per(near.unionByName(lineage), ["query", "id"], [F.col("phase"), F.col("order")]).join(known, "id")
    body = F.left("text", F.col("chars"))
    lines = every.withColumns({"tokens": F.greatest(F.lit(1), F.expr("length(left(text, chars)) div 4").cast("int")), "piece": F.concat(F.lit("["), "tag", F.lit(" | "), F.left(F.col("id").cast("string"), F.lit(8)), F.lit(" | status="), F.coalesce("status", F.lit("active")), F.lit("]\n"), body, F.lit("\n"))})

    def step(acc, row):
        tries = (row["phase"] == 0) | ~acc["over"]
        fits = tries & (F.length(row["piece"]) <= acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - F.length(row["piece"])).otherwise(acc["left"]).alias("left"), (acc["over"] | (tries & ~fits)).alias("over"),
            F.when(fits, F.concat(acc["taken"], F.array(row["index"]))).otherwise(acc["taken"]).alias("taken"),
        )

    empty = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("over"), F.array().cast(f"array<{nodes.schema['index'].dataType.simpleString()}>").alias("taken"))
    held = lines.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("phase", "order", "piece", "index"))).alias("_rows"))
    taken = held.select("query", F.aggregate("_rows", empty, step).alias("_a")).select("query", F.col("_a.over").alias("overflow"), F.explode("_a.taken").alias("index"))
    when = asked.join(known.select("id", "at"), "id").groupBy("query").agg(F.min_by("at", "place").alias("_at"))
    kept = taken.join(lines, ["query", "index"]).join(when, "query")
    semantic, temporal = F.when(F.col("phase") == 0, 1.0).otherwise(F.col("root_similarity")), temporal_affinity(F.col("at"), F.col("_at"), 30.0)
    position = F.row_number().over(Window.partitionBy("query").orderBy("index")) - 1
    return kept.select("query", position.alias("position"), "id", "branch", "tag", F.round(semantic, 4).alias("semantic"), F.round(temporal, 4).alias("temporal"), F.round(0.6 * semantic + 0.4 * temporal, 4).alias("weight"), "tokens", "piece", "overflow")


def snapshot_blocks(taken: DataFrame) -> DataFrame:
    """query, block, tokens, entropy, overflow: the pieces of each snapshot as one text; entropy says how evenly weight is spread."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"])
    return taken.groupBy("query").agg(F.array_join(ordered, "\n---\n").alias("block"), F.sum("tokens").alias("tokens"), F.round(entropy(F.greatest("weight", F.lit(1e-9))), 4).alias("entropy"), F.max("overflow").alias("overflow"))


def full_text(nodes: DataFrame, edges: DataFrame, branches: DataFrame, chars: int = 4000, with_dormant: bool = True) -> DataFrame:
    """section, folder, file, index, line: a whole archive as lines to be ordered by section, folder, file and index.

    Sections: 1 loose ends, 2 contradictions, 3 every text by folder and file, where a
    replaced text is a pointer to its current version. No line is gathered with others, so
    an archive may be of any size.
    """
    file = F.coalesce(F.col("file"), F.lit(""))
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    ends = loose_heads(nodes, edges).join((branches if with_dormant else branches.where("NOT dormant")).select(F.col("id").alias("branch")), "branch", "left_semi").select("id")
    open_ = nodes.join(ends, "id").select(F.lit(1).alias("section"), F.lit("").alias("folder"), file.alias("file"), F.col("index").cast("long").alias("index"), F.concat(F.lit("- ["), file, F.lit("] "), F.left("text", F.lit(200))).alias("line"))
    text = lambda x: nodes.select(F.col("id").alias(x), F.left("text", F.lit(150)).alias(f"{x}_text"))
    against = edges.where("kind = 'contradicts'").join(text("src"), "src").join(text("dst"), "dst")
    clash = against.select(F.lit(2), F.lit(""), F.lit(""), F.col("seq").cast("long"), F.concat(F.lit("- «"), "src_text", F.lit("» contradicts «"), "dst_text", F.lit("»")))
    pointed = nodes.join(latest(edges), "id", "left")
    again = F.when(F.col("reinforced") > 0, F.concat(F.lit("  [repeated "), F.col("reinforced").cast("string"), F.lit(" times]"))).otherwise(F.lit(""))
    line = F.when(F.col("current").isNotNull(), F.concat(F.lit("[outdated, see "), F.left(F.col("current").cast("string"), F.lit(8)), F.lit("] "), F.left("text", F.lit(150)))).otherwise(F.concat(F.left("text", F.lit(chars)), again))
    return open_.union(clash).union(pointed.select(F.lit(3), folder, file, F.col("index").cast("long"), line))


def outline(texts: DataFrame, name: str) -> DataFrame:
    """One row, project, domains, modules, concepts, text: what a project's documents (path from its root, text) say it is about.

    Documents are Markdown files, those called README, ARCHITECTURE or INSTALL, and what
    lies in a folder docs. Modules are the first 50 headings of the first two levels and
    concepts the first 100 names in backticks or inner capitals, both sorted; the project is
    called as the deepest, last README's first heading, else name. Hidden folders don't count.
    """
    parts = F.split("path", "/")
    base = F.upper(F.element_at(parts, -1))
    seen = texts.where(~F.exists(parts, lambda p: F.startswith(p, F.lit("."))))
    domains = seen.where(F.size(parts) > 1).select(F.get(parts, F.lit(0)).alias("x"))
    in_docs = F.lower(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))) == "docs"
    named = F.endswith(base, F.lit(".MD")) | F.startswith(base, F.lit("README")) | F.startswith(base, F.lit("ARCHITECTURE")) | F.startswith(base, F.lit("INSTALL")) | in_docs
    docs = seen.where(named & F.col("text").isNotNull())
    found = lambda pattern, group=1: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    headings = docs.select(F.explode(F.transform(found(r"(?m)^[^\S\n]*#{1,2}[^\S\n]+(.+)$"), lambda x: F.trim(x))).alias("x"))
    concepts = docs.select(F.explode(F.concat(found("`([a-zA-Z0-9_./-]{3,40})`"), found(r"\b([A-Z][a-zA-Z0-9]{2,}(?:[A-Z][a-zA-Z0-9]*)+)\b"))).alias("x"))
    listed = lambda rows, n=None: (rows.distinct() if n is None else rows.distinct().orderBy("x").limit(n)).agg(F.array_sort(F.collect_list("x")).alias("x"))
    title = docs.where(F.startswith(base, F.lit("README"))).withColumn("t", F.regexp_extract("text", r"(?m)^#[^\S\n]+(.+)$", 1)).where("t <> ''")
    called = title.agg(F.max_by(F.trim("t"), F.struct(F.size(parts), "path")).alias("t")).select(F.coalesce("t", F.lit(name)).alias("project"))
    row = called
    for column, rows in (("domains", listed(domains)), ("modules", listed(headings, 50)), ("concepts", listed(concepts, 100))):
        row = row.crossJoin(rows.withColumnRenamed("x", column))  # one row by one row
    line = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, ", ")))
    text = F.concat_ws("\n", F.concat(F.lit("Project: "), "project"), line("Domains: ", F.col("domains")), line("Modules: ", F.slice("modules", 1, 30)), line("Concepts: ", F.slice("concepts", 1, 50)))
    return row.withColumn("text", text)
