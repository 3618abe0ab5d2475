"""From queries to cards and blocks: ranked lists, evidence, cards, admission, recall, briefs.

Everything takes many queries at once (query_id); a single prompt is a frame of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import marks, render
from sparkloom.functions.text import day, relative
from sparkloom.operators import context, fulltext, ledger, relations, search, selection
from sparkloom.sources.store import Store

HIT = "query_id, place, id, score, via"


def fuse_lists(hits: DataFrame, k: int = 60, limit: int = 60, first_place: int = 1) -> DataFrame:
    """query_id, place, id, score, via: reciprocal rank fusion of lists (query_id, list_no, place, id, via) per query.

    A list's place of an id is its first; scores are round(sum of 1 / (k + place), 6), ties go
    to the smaller id, and via names the first list that has it. With first_place 0 places
    count from 0 in the sum.
    """
    first = hits.groupBy("query_id", "list_no", "id").agg(F.min("place").alias("place"), F.min_by("via", "place").alias("via"))
    parts = F.sum(1 / (F.lit(k + first_place - 1) + F.col("place")))
    fused = first.groupBy("query_id", "id").agg(F.round(parts, 6).alias("score"), F.min_by("via", "list_no").alias("via"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return fused.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "id", "score", "via")


def ranked_lists(store: Store, queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, list_no, place, id, score, via: the full-text list (0) and one list for each space with query vectors.

    queries: query_id, text; vectors: query_id, space, v. Stored vectors have space, id, v.
    """
    vectors = vectors.join(queries.select("query_id"), "query_id", "left_semi")
    out = fulltext.find_words(store, "entries", queries, n).withColumn("list_no", F.lit(0))
    for i, row in enumerate(vectors.select("space").distinct().orderBy("space").collect(), 1):  # a handful of spaces
        stored = store.rows("vectors", empty="space string, id string, v array<double>").where(F.col("space") == row.space).select("id", "v")
        near = search.nearest(stored, vectors.where(F.col("space") == row.space).select("query_id", "v"), n, own=False)
        out = out.unionByName(near.select("query_id", F.lit(i).alias("list_no"), F.col("rank").alias("place"), "id", "score", F.lit(row.space).alias("via")))
    return out


def evidence(lists: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fused hits, best cosine of each query and id, full-text ids in order) of ranked lists."""
    near = lists.where("list_no > 0").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    words = lists.where("list_no = 0").select("query_id", "id", "place")
    return fuse_lists(lists, 60, n), near, words


def shortlist(hits: DataFrame, entries: DataFrame, k: int, excluded: DataFrame | None = None, with_retracted: bool = False) -> DataFrame:
    """Hits of visible known entries in order: the first of each content (digest) per query, k a query."""
    known = ledger.visible(entries, excluded, with_retracted).select("id", "digest")
    joined = hits.join(known, "id")
    first = selection.first_per(joined, ["query_id", "digest"], [F.col("place"), F.col("id")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "id", "score", "via")


def cards(hits: DataFrame, entries: DataFrame, links: DataFrame, root: str = "", chars: int = 1500) -> DataFrame:
    """Hits as cards: score, status, day, file, question and text cut to chars, their length, links, current version."""
    link = F.struct("place", "dir", "kind", "other", "source", "status", "day", "text")
    shown = relations.link_rows(links.join(hits.select("id").distinct().select(F.col("id").alias("src")), "src", "left_semi").unionByName(links.join(hits.select("id").distinct().select(F.col("id").alias("dst")), "dst", "left_semi").select(links.columns)).distinct(), entries)
    gathered = shown.groupBy("id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    current = relations.current_versions(links)
    states = relations.statuses(entries, links)
    whole = hits.join(entries, "id").join(states, "id").join(gathered, "id", "left").join(current, "id", "left")
    fields = ["query_id", "place", "id", F.round("score", 4).alias("score"), F.col("state").alias("status"), day(F.col("at")).alias("day"), "at", relative(F.col("file"), root).alias("file"), F.left("question", F.lit(chars)).alias("question"), F.left("text", F.lit(chars)).alias("text"), F.length("text").alias("chars"), "links", F.coalesce("current", F.lit("")).alias("current"), "session"]
    return whole.select(*fields)


def admit(cards: DataFrame, near: DataFrame, words: DataFrame, min_score: float, window: float, max_items: int) -> DataFrame:
    """Cards that a query may show, in order, at most max_items, with their cosine (or null) as score.

    A query is silent unless its best cosine reaches min_score; then a card passes within
    `window` of the best, or if it is among the query's first max_items full-text hits.
    """
    best = near.groupBy("query_id").agg(F.max("score").alias("_best")).where(F.col("_best") >= min_score)
    top = words.where(F.col("place") <= max_items).select("query_id", "id", F.lit(True).alias("_word"))
    cosine = near.select("query_id", "id", F.col("score").alias("_cosine"))
    judged = cards.join(best, "query_id").join(cosine, ["query_id", "id"], "left").join(top, ["query_id", "id"], "left")
    passed = judged.where((F.col("_cosine") >= F.greatest(F.lit(min_score), F.col("_best") - window)) | F.col("_word"))
    first = selection.first_per(passed, ["query_id", "id"], [F.col("place")])
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))
    return first.withColumn("_n", n).where(F.col("_n") <= max_items).withColumn("score", F.col("_cosine")).drop("_n", "_best", "_cosine", "_word")


def with_notes(cards: DataFrame, entries: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """cards plus notes: what replaced or contradicts them, and their code links (id, place, line)."""
    later = entries.select(F.col("id").alias("current"), day(F.col("at")).alias("_later_day"), F.col("text").alias("_later"))
    first = lambda rule: F.get(F.filter("links", rule), 0)
    earlier = first(lambda x: (x["dir"] == "out") & (x["kind"] == "supersedes"))
    conflict = first(lambda x: x["kind"] == "contradicts")
    out = cards.join(later, "current", "left")
    if code is None:
        lines = F.array().cast("array<string>")
    else:
        gathered = code.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("_code"))
        out, lines = out.join(gathered, "id", "left"), F.coalesce("_code", F.array().cast("array<string>"))
    version = render.version_note(F.col("_later_day"), F.col("_later"), earlier["day"], earlier["text"])
    notes = render.notes_of(version, render.conflict_note(conflict["dir"], conflict["day"], conflict["text"]), lines)
    return out.withColumn("notes", notes).drop("_later_day", "_later", "_code")


def search_cards(store: Store, queries: DataFrame, vectors: DataFrame, k: int, excluded: DataFrame | None = None, with_retracted: bool = False, root: str = "") -> DataFrame:
    """The k best cards of each query: full text and spaces fused over max(8k, 60) candidates."""
    n = max(8 * k, 60)
    entries = store.rows("entries", empty=ledger.ENTRY)
    hits = fuse_lists(ranked_lists(store, queries, vectors, n), 60, n)
    return cards(shortlist(hits, entries, k, excluded, with_retracted), entries, store.rows("relations", empty=ledger.RELATION), root)


def recall(store: Store, queries: DataFrame, vectors: DataFrame, budget: int = 3600, max_items: int = 5, min_score: float = 0.5, window: float = 0.12, root: str = "") -> DataFrame:
    """query_id, block, shown: the block that goes with each prompt; prompts that memory has nothing for have no row.

    queries: query_id, text, session_id, transcript, cut (time of the last compaction, 0 for
    none). Noise and turns that the live session still sees are left out before admission.
    """
    n = max(8 * max_items, 60)
    entries, links = store.rows("entries", empty=ledger.ENTRY), store.rows("relations", empty=ledger.RELATION)
    hits, near, words = evidence(ranked_lists(store, queries.select("query_id", "text"), vectors, n), n)
    said = hits.join(entries.select("id", "question", "text", "file", "at"), "id").join(queries.select("query_id", "session_id", "transcript", "cut"), "query_id")
    ok = marks.eligible(*(F.col(c) for c in ("question", "text", "file", "at", "session_id", "transcript", "cut")))
    allowed = said.where(ok).select("query_id", "place", "id", "score", "via")
    shown = cards(shortlist(allowed, entries, n), entries, links, root)
    return context.render_recall(with_notes(admit(shown, near, words, min_score, window, max_items), entries), "query_id", ["place"], budget)


def brief(store: Store, now: float, max_chars: int = 1600) -> DataFrame:
    """One row, block: how much is remembered, and the notes of the last 14 days."""
    entries = store.rows("entries", empty=ledger.ENTRY)
    notes = ledger.recent_notes(entries, now)
    place = F.row_number().over(Window.orderBy(F.desc("at"), "position", "id"))  # 5 rows at most
    return context.render_brief(entries.where("status = 'active'").count(), notes.select(place.alias("place"), day(F.col("at")).alias("day"), "file", "text"), max_chars)


def choose_search(engines: DataFrame, preferred: str) -> DataFrame:
    """One row, how, engine: vector if the preferred engine is ready, translated by an adapter into it, another ready one, else lexical.

    engines: position, name, ready, adapter (the engine whose vectors can be carried over, or null).
    """
    ready = engines.where("ready").select("position", "name")
    direct = ready.where(F.col("name") == preferred).select(F.lit(0).alias("r"), "position", F.lit("vector").alias("how"), F.col("name").alias("engine"))
    carried = engines.where(F.col("name") == preferred).select(F.col("adapter").alias("name")).join(ready, "name").select(F.lit(1).alias("r"), "position", F.lit("translated").alias("how"), F.col("name").alias("engine"))
    other = ready.select(F.lit(2).alias("r"), "position", F.lit("vector").alias("how"), F.col("name").alias("engine"))
    none = engines.sparkSession.range(1).select(F.lit(3).alias("r"), F.lit(0).alias("position"), F.lit("lexical").alias("how"), F.lit("").alias("engine"))
    every = direct.unionByName(carried).unionByName(other).unionByName(none)
    return every.orderBy("r", "position").limit(1).select("how", "engine")
