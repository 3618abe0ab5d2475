"""Links with validity times: at most one live link per ordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import day, relative, squash
from sparkloom.operators.lineage import cut_lineage

#: Fixed values, in display order.
KINDS = ("supersedes", "contradicts", "fixes", "refines", "continues", "returns_to", "reinforces")


def record_relations(claims: DataFrame, extra: list[str] = (), by: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """src, dst, kind, valid_at, invalid_at and extra columns from claims (src, dst, kind, at, seq).

    Per ordered pair, in order of time and input (or of `by`): a claim of the live kind changes nothing,
    any other closes the live link and opens its own. invalid_at 0 means live. Claims of a
    thing about itself and of unknown kinds are ignored.
    """
    order = Window.partitionBy("src", "dst").orderBy(*by)
    known = claims.where(F.col("kind").isin(*KINDS))
    changed = known.where("src <> dst").withColumn("_last", F.lag("kind").over(order)).where("_last IS NULL OR _last <> kind")
    return changed.select("src", "dst", "kind", F.col("at").alias("valid_at"), F.coalesce(F.lead("at").over(order), F.lit(0.0)).alias("invalid_at"), *extra)


def heads(links: DataFrame) -> DataFrame:
    """dst, src: what replaces each thing; of several, the latest, then the least."""
    live = links.where("kind = 'supersedes' AND invalid_at = 0 AND src <> dst")
    order = Window.partitionBy("dst").orderBy(F.desc("valid_at"), "src")
    return live.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("dst", "src")


def current_versions(links: DataFrame) -> DataFrame:
    """id, current: the end of each thing's chain of replacements, by pointer doubling.

    The rounds are the binary logarithm of the number of replacements. A chain that runs
    into a cycle has no end: its members keep a null current.
    """
    step = cut_lineage(heads(links).select(F.col("dst").alias("id"), F.col("src").alias("to")))
    jumps = step
    for _ in range(step.count().bit_length()):
        nxt = jumps.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jumps = cut_lineage(jumps.join(nxt, "to", "left").select("id", F.coalesce("far", "to").alias("to")), *([jumps] if jumps is not step else []))
    ends = jumps.join(step.select(F.col("id").alias("to"), F.lit(True).alias("_on")), "to", "left")
    return ends.select("id", F.when(F.col("_on").isNull(), F.col("to")).alias("current"))


def statuses(entries: DataFrame, links: DataFrame) -> DataFrame:
    """id, state: retracted before superseded before active."""
    replaced = heads(links).select(F.col("dst").alias("id"), F.lit(True).alias("_r"))
    state = F.when(F.col("status") == "retracted", "retracted").when(F.col("_r").isNotNull(), "superseded").otherwise("active")
    return entries.join(replaced, "id", "left").select("id", state.alias("state"))


def decision_feed(links: DataFrame, limit: int) -> DataFrame:
    """The newest live replacements and contradictions; the limit comes before any later join."""
    live = links.where("kind IN ('supersedes', 'contradicts') AND invalid_at = 0")
    return live.orderBy(F.desc("valid_at"), "src", "dst").limit(limit)


# ---------------------------------------------------------------- views of the relations


def kind_rank() -> Column:
    """Display order of the kinds, from 0."""
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1


def link_rows(links: DataFrame, entries: DataFrame, chars: int = 240) -> DataFrame:
    """id, place, dir, kind, other, source, status, day, text: each thing's live relations to known others.

    In display order of the kinds, then by time; entries: id, text, at, status. Only the
    other end's short facts are joined.
    """
    live = links.where((F.col("invalid_at") == 0) & F.col("kind").isin(*KINDS))
    out = live.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("dir"), "kind", "valid_at", "source")
    into = live.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("dir"), "kind", "valid_at", "source")
    states = statuses(entries, links)
    facts = entries.select("id", F.left("text", F.lit(chars)).alias("text"), day(F.col("at")).alias("day")).join(states.withColumnRenamed("state", "status"), "id").withColumnRenamed("id", "other")
    order = Window.partitionBy("id").orderBy(kind_rank(), "valid_at", "other", "dir")
    joined = out.unionByName(into).join(facts, "other")
    return joined.select("id", (F.row_number().over(order) - 1).alias("place"), "dir", "kind", "other", "source", "status", "day", "text")


def decisions(links: DataFrame, entries: DataFrame, limit: int, root: str = "", chars: int = 280) -> DataFrame:
    """The newest `limit` replacements and contradictions, closed ones too, of which both ends are known.

    kind, day, at, source, closed and for the new and the old side id, text, file, status.
    The limit comes before the joins, so unknown ends leave fewer rows.
    """
    top = links.where(F.col("kind").isin("supersedes", "contradicts")).orderBy(F.desc("valid_at"), "src", "dst").limit(limit)
    facts = entries.join(statuses(entries, links), "id").select("id", F.left("text", F.lit(chars)).alias("text"), relative(F.col("file"), root).alias("file"), "state")
    side = lambda x, name: facts.select(F.col("id").alias(x), *(F.col(c).alias(f"{name}_{c}") for c in ("text", "file", "state")))
    both = top.join(side("src", "new"), "src").join(side("dst", "old"), "dst")
    sides = [F.col("src").alias("new_id"), "new_text", "new_file", "new_state", F.col("dst").alias("old_id"), "old_text", "old_file", "old_state"]
    return both.select("kind", day(F.col("valid_at")).alias("day"), F.col("valid_at").alias("at"), "source", (F.col("invalid_at") != 0).alias("closed"), *sides)


def ends(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, seq: the other ends of relations (seq) that touch ids, or all ends; by first appearance."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("id"), (F.col("seq") * 2 + (0 if ids is not None else 1)).alias("seq"))
    both = both.unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("id"), (F.col("seq") * 2 + (1 if ids is not None else 0)).alias("seq")))
    if ids is not None:
        both = both.join(ids.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    return both.groupBy("id").agg(F.min("seq").alias("seq"))


def touching(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with an end among ids, each once; two equi-joins instead of an OR."""
    wanted = ids.select("id").distinct()
    by = lambda c: links.join(wanted.withColumnRenamed("id", c), c, "left_semi").select(links.columns)
    return by("src").unionByName(by("dst")).dropDuplicates(["seq"])


def chains(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The live replacements that the current versions of ids depend on: those of each thing on their chains.

    The frontier follows the nearest replacement hop by hop and ends where nothing new comes,
    so cycles end too; each hop ends its lineage.
    """
    live = links.where("kind = 'supersedes' AND invalid_at = 0")
    nearest = cut_lineage(heads(links))
    seen = cut_lineage(ids.select("id").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while True:
        step = nearest.join(seen.where(F.col("hop") == hop).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        layer = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop + 1)))
        if layer.isEmpty():
            break
        seen, hop = cut_lineage(seen.unionByName(layer), seen, layer), hop + 1
    return live.join(seen.select(F.col("id").alias("dst")), "dst", "left_semi").select(links.columns)


def scope(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The relations that the cards of ids depend on: those that touch them, and the chains of ids and their neighbours."""
    near = ids.select("id").unionByName(ends(links, ids).select("id"))
    return touching(links, ids).unionByName(chains(links, near)).dropDuplicates(["seq"])


def neighbourhood(links: DataFrame, start: DataFrame, depth: int, limit: int) -> DataFrame:
    """query, id, place, hop: breadth-first layers over relations in any direction, at most `limit` things a query.

    start: query, id. Within a layer things come by the order (seq) of the relations that
    reach them, sources before targets; each layer ends its lineage.
    """
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("id"), (F.col("seq") * 2 + 1).alias("seq")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("id"), (F.col("seq") * 2).alias("seq")))
    seen = cut_lineage(start.select("query", "id", F.lit(1).alias("place"), F.lit(0).alias("hop")))
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select("query", F.col("id").alias("a"))
        new = both.join(front, "a").groupBy("query", "id").agg(F.min("seq").alias("seq")).join(seen.select("query", "id"), ["query", "id"], "left_anti")
        had = seen.groupBy("query").agg(F.count("*").cast("int").alias("had"))
        placed = new.join(had, "query").withColumn("place", F.col("had") + F.row_number().over(Window.partitionBy("query").orderBy("seq")))
        layer = cut_lineage(placed.where(F.col("place") <= limit).select("query", "id", "place", F.lit(hop).alias("hop")))
        if layer.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(layer), seen, layer)
    return seen


def ego(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind: each relation kind once between things of nodes (id), closed ones too."""
    known = nodes.select("id").distinct()
    inner = links.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "kind").distinct()


def graph_nodes(nodes: DataFrame, entries: DataFrame, links: DataFrame, root: str = "") -> DataFrame:
    """query, id, label, status, day, file, center of the reached things (query, id, hop) that are entries."""
    label = F.left(squash(F.coalesce(F.nullif("question", F.lit("")), F.col("text"))), F.lit(60))
    facts = entries.join(statuses(entries, links), "id").select("id", label.alias("label"), F.col("state").alias("status"), day(F.col("at")).alias("day"), relative(F.col("file"), root).alias("file"))
    return nodes.join(facts, "id").select("query", "id", "label", "status", "day", "file", (F.col("hop") == 0).alias("center"))


def version_chain(links: DataFrame, max_hops: int = 20, by: str = "seq") -> DataFrame:
    """id, hop, newer: the chain of first replacements (by seq) from each replaced thing, at most max_hops long."""
    first = cut_lineage(links.where("kind = 'supersedes' AND src <> dst").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", by).alias("newer")))
    out = cut_lineage(first.select("id", F.lit(1).alias("hop"), "newer", F.array("id", "newer").alias("path")))
    for hop in range(2, max_hops + 1):
        step = out.where(F.col("hop") == hop - 1).join(first.select(F.col("id").alias("newer"), F.col("newer").alias("next")), "newer").where(~F.array_contains("path", F.col("next")))
        layer = cut_lineage(step.select("id", F.lit(hop).alias("hop"), F.col("next").alias("newer"), F.array_append("path", F.col("next")).alias("path")))
        if layer.isEmpty():
            break
        out = cut_lineage(out.unionByName(layer), out, layer)
    return out.select("id", "hop", "newer")
