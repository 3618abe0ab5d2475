"""The ledger of entries: drafts from texts and chats, identities, batches of changes, notes and marks of files.

An entry has id, file, position, digest, text, question, answer, at, status, retracted_at,
session and source; at and retracted_at are seconds, 0 for unknown and for not retracted.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.functions.scrubbing import note_text, scrub_drafts
from sparkloom.operators import relations, sync
from sparkloom.sources.store import Store

ENTRY = "id string, file string, position int, digest string, text string, question string, answer string, at double, status string, retracted_at double, session string, source string"
DRAFT = "file string, position int, text string, question string, answer string, at double, session string, source string"
MARKS = "path string, mtime double"
NOTES = "memory://notes"
LEAST_NOTE = 8
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


@F.pandas_udf(StringType())
def digest(texts: pd.Series) -> pd.Series:
    """16 hex digits of a text's BLAKE2b, white space collapsed."""
    return texts.map(lambda t: None if t is None else hashlib.blake2b(" ".join(t.split()).encode("utf-8", "replace"), digest_size=8).hexdigest())


@F.pandas_udf(StringType())
def entry_id(files: pd.Series, positions: pd.Series, ats: pd.Series, texts: pd.Series) -> pd.Series:
    """16 hex digits over file, position, time and text."""
    rows = zip(files, positions, ats, texts, strict=True)
    return pd.Series([hashlib.blake2b(f"{f}\n{p}\n{float(a)!r}\n{t}".encode("utf-8", "replace"), digest_size=8).hexdigest() for f, p, a, t in rows], dtype=object)


# ---------------------------------------------------------------- drafts


def _pieces(paragraph: str, limit: int, separators: tuple[str, ...] = ("\n", ". ", " ", "")) -> list[str]:
    """A paragraph in pieces of at most limit characters, cut behind the coarsest separator that serves."""
    if len(paragraph) <= limit:
        return [paragraph]
    sep, finer = separators[0], separators[1:]
    parts = [paragraph[i : i + limit] for i in range(0, len(paragraph), limit)] if not sep else [p for p in re.split(f"(?<={re.escape(sep)})", paragraph) if p]
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) <= limit:
            out[-1] += part
        else:
            out += _pieces(part, limit, finer) if len(part) > limit else [part]
    return out


def split_text(text: str | None, limit: int) -> list[str]:
    """Trimmed paragraphs between blank lines, longer ones in pieces of at most limit characters.

    No character but white space is lost; the library that cut long paragraphs in the first
    place isn't at hand, so where a long one is cut is this function's own rule.
    """
    blocks = re.split(r"\n(?:[^\S\n]*\n)+", re.sub(r"\r\n?", "\n", text or ""))
    return [p for b in blocks if b.strip() for x in _pieces(b.strip(), limit) if (p := x.strip())]


def paragraphs(text: str, limit: int) -> Column:
    """split_text as a column."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit))

    return cut(text)


def atomize(texts: DataFrame, limit: int) -> DataFrame:
    """file, position, digest, text of each paragraph of texts (file, text); positions count from 0."""
    return texts.select("file", F.posexplode(paragraphs("text", limit)).alias("position", "text")).select("file", "position", digest("text").alias("digest"), "text")


def text_drafts(texts: DataFrame, limit: int) -> DataFrame:
    """Drafts of texts (file, text, at): each paragraph is an answer without a question."""
    rows = texts.select("file", "at", F.posexplode(paragraphs("text", limit)).alias("position", "text"))
    return rows.select("file", "position", "text", F.lit("").alias("question"), F.col("text").alias("answer"), "at", F.lit("").alias("session"), F.lit("file").alias("source"))


def chat_drafts(pairs: DataFrame) -> DataFrame:
    """Drafts of chat pairs (file, pair, question, answer, ts, at): a pair without a time has the file's."""
    both = F.trim(F.concat_ws("\n\n", F.nullif("question", F.lit("")), F.nullif("answer", F.lit(""))))
    at = F.when(F.coalesce("ts", F.lit(0.0)) > 0, F.col("ts")).otherwise(F.col("at"))
    return pairs.select("file", F.col("pair").cast("int").alias("position"), both.alias("text"), "question", "answer", at.alias("at"), F.lit("").alias("session"), F.lit("chat").alias("source")).where("text <> ''")


def session_drafts(atoms: DataFrame, source: str) -> DataFrame:
    """Drafts of a session's turns (file, ordinal, question, answer, text, at); the session is the file's bare name."""
    session = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    return atoms.select("file", F.col("ordinal").cast("int").alias("position"), "text", "question", "answer", "at", session.alias("session"), F.lit(source).alias("source"))


def drafts(kinds: dict[str, DataFrame], limit: int) -> DataFrame:
    """Scrubbed drafts, with found, of sources by kind: text (file, text, at), chat (pairs) and agents' turns."""
    parts = [text_drafts(f, limit) if k == "text" else chat_drafts(f) if k == "chat" else session_drafts(f, k) for k, f in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return scrub_drafts(out)


def entries_of(drafts: DataFrame) -> DataFrame:
    """Active entries of drafts, with their identities and digests."""
    shaped = drafts.withColumns({"id": entry_id("file", "position", "at", "text"), "digest": digest("text"), "status": F.lit("active"), "retracted_at": F.lit(0.0)})
    return shaped.select(*FIELDS)


# ---------------------------------------------------------------- batches


def plan_batch(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """action (keep, add, retract, revise), file, digest, stored_id, fresh_id of whole files' fresh entries against the stored.

    Only live stored entries of the files at hand take part; equal paragraphs pair up by
    occurrence, and an added one at a retracted one's place revises it.
    """
    live = stored.where("status = 'active'").join(fresh.select("file").distinct(), "file", "left_semi")
    side = lambda d: d.select("file", "digest", "position", "id")
    return sync.plan_sync(side(live), side(fresh))


def commit(store: Store, fresh: DataFrame, marks: DataFrame, at: float, plan: DataFrame | None = None) -> dict[str, int]:
    """Write a batch: new entries, retractions, revisions as relations, marks of the files; how many of each.

    fresh: entries of whole files; marks: path, mtime. Entries that stay are left as stored.
    """
    stored = store.rows("entries", empty=ENTRY)
    plan = plan_batch(stored, fresh) if plan is None else plan
    added = fresh.join(plan.where("action = 'add'").select(F.col("fresh_id").alias("id")), "id", "left_semi")
    gone = sync.retire(stored, plan.where("action = 'retract'").select(F.col("stored_id").alias("id")), at).where(F.col("retracted_at") == at)
    counts = {r.action: r.n for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    pairs = plan.where("action = 'revise'").select(F.col("fresh_id").alias("src"), F.col("stored_id").alias("dst"))
    record_pairs(store, pairs, "supersedes", at, "edit")
    store.put("entries", ["id"], added.unionByName(gone.select(*FIELDS)))
    store.put("marks", ["path"], marks)
    return {"added": counts.get("add", 0), "retracted": counts.get("retract", 0), "kept": counts.get("keep", 0), "revised": counts.get("revise", 0)}


def record_pairs(store: Store, pairs: DataFrame, kind: str, at: float, source: str) -> int:
    """Claim one relation for each pair (src, dst) at one time; the number of relations there are now."""
    return record_many(store, pairs.select("src", "dst", F.lit(kind).alias("kind"), F.lit(at).alias("at"), F.monotonically_increasing_id().alias("seq"), F.lit(source).alias("source")))


RELATION = "src string, dst string, kind string, valid_at double, invalid_at double, source string"


def record_many(store: Store, claims: DataFrame) -> int:
    """Write claims (src, dst, kind, at, seq, source), by time and order, upon what each pair has so far."""
    before = store.rows("relations", empty=RELATION).join(claims.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    old = before.select("src", "dst", "kind", F.col("valid_at").alias("at"), F.lit(-1).cast("long").alias("seq"), "source", F.lit(0).alias("new"))
    new = claims.select("src", "dst", "kind", F.least("at", F.lit(1.7976931348623157e308)).alias("at"), F.col("seq").cast("long").alias("seq"), "source", F.lit(1).alias("new"))
    links = relations.record_relations(old.unionByName(new), ["source"], ("new", "at", "seq"))
    return store.put("relations", ["src", "dst", "valid_at", "kind"], links)


def retract_file(store: Store, path: str, at: float) -> int:
    """Retract a file's live entries and forget its mark; how many were live."""
    live = store.rows("entries", empty=ENTRY).where((F.col("file") == path) & (F.col("status") == "active"))
    n = live.count()
    if n:
        store.put("entries", ["id"], live.withColumns({"status": F.lit("retracted"), "retracted_at": F.lit(at)}))
    mark(store, path, 0.0)
    return n


def retract(store: Store, ids: DataFrame, at: float) -> int:
    """Retract the live entries among ids; how many they were."""
    live = store.rows("entries", empty=ENTRY).where("status = 'active'").join(ids.select("id").distinct(), "id", "left_semi")
    n = live.count()
    if n:
        store.put("entries", ["id"], live.withColumns({"status": F.lit("retracted"), "retracted_at": F.lit(at)}))
    return n


def remember(store: Store, text: str, session: str, source: str, at: float) -> DataFrame:
    """Append a scrubbed note and return its entry; shorter than 8 characters is an error."""
    spark = store.spark
    clean = spark.range(1).select(note_text(F.lit(text), LEAST_NOTE).alias("t")).first().t
    if not clean:
        raise ValueError("a note needs at least 8 characters")
    position = store.rows("entries", empty=ENTRY).where(F.col("file") == NOTES).count()
    row = spark.createDataFrame([(NOTES, position, clean, f"Note ({source})", clean, at, session, source)], DRAFT)
    entry = entries_of(row)
    store.put("entries", ["id"], entry)
    return entry


def relate(store: Store, src: str, dst: str, kind: str, source: str, at: float) -> DataFrame:
    """Claim a relation between two known entries; all relations of the pair. An unknown one is a KeyError."""
    known = {r.id for r in store.rows("entries", empty=ENTRY).where(F.col("id").isin(src, dst)).select("id").collect()}
    for x in (src, dst):
        if x not in known:
            raise KeyError(x)
    record_many(store, store.spark.createDataFrame([(src, dst, kind, at, 0, source)], "src string, dst string, kind string, at double, seq long, source string"))
    return of_pair(store.rows("relations", empty=RELATION), src, dst)


def of_pair(links: DataFrame, src: str, dst: str) -> DataFrame:
    return links.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("valid_at", "kind")


# ---------------------------------------------------------------- marks, reads, counts


def mark(store: Store, path: str, mtime: float) -> int:
    """Note that a file was read as of mtime; 0 forgets it. The number of marks."""
    if mtime == 0:
        return store.delete("marks", f"path = {_quoted(path)}")
    return store.put("marks", ["path"], store.spark.createDataFrame([(path, mtime)], MARKS))


def mark_all(store: Store, marks: DataFrame, seq: str | None = None) -> int:
    """Upsert marks (path, mtime); of several of one path the last by seq stays."""
    return store.put("marks", ["path"], marks, seq)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stamped(sources: DataFrame) -> DataFrame:
    """path, mtime: the first row (seq) of each path, if its time is known."""
    first = sources.groupBy("path").agg(F.min_by("mtime", "seq").alias("mtime"))
    return first.where("mtime > 0")


def gone(paths: DataFrame, there: DataFrame) -> DataFrame:
    """path: marked paths that are no longer there, notes aside."""
    return paths.select("path").distinct().join(there.select("path"), "path", "left_anti").where(~F.startswith("path", F.lit("memory://")))


def plan(store: Store, current: DataFrame) -> DataFrame:
    """path, action: what to read anew or to retract, given the sources there are (path, mtime)."""
    return sync.outdated(current, store.rows("marks", empty=MARKS))


def in_list_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is listed in ids (pos, id), with pos, to be ordered by it."""
    return rows.join(ids.groupBy("id").agg(F.min("pos").alias("pos")), "id")


def in_place(entries: DataFrame) -> DataFrame:
    return entries.orderBy("position", "at", "id")


def counts(entries: DataFrame) -> DataFrame:
    """One row: atoms, live, retracted."""
    return entries.agg(F.count("*").alias("atoms"), F.count_if(F.col("status") == "active").alias("live"), F.count_if(F.col("status") != "active").alias("retracted"))


def replaced(links: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: replaced, how many distinct ids have a replacement other than themselves."""
    return ids.select("id").distinct().join(relations.heads(links).select(F.col("dst").alias("id")), "id", "left_semi").agg(F.count("*").alias("replaced"))


def stats(store: Store) -> dict[str, int]:
    """Counts of the stored tables: atoms, live, retracted, superseded, relations, files, code, edges, spaces."""
    entries, links = store.rows("entries", empty=ENTRY), store.rows("relations", empty=RELATION)
    row = counts(entries).first()
    return {**row.asDict(), "superseded": replaced(links, entries).first()[0], "relations": links.count(), "files": store.count("marks"), "code": store.count("code_nodes"), "edges": store.count("edges"), "spaces": store.count("spaces")}


def live_ids(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'active'").select("id").distinct().orderBy("id")


def visible(entries: DataFrame, excluded: DataFrame | None = None, with_retracted: bool = False) -> DataFrame:
    """Entries that may be shown: not excluded, and not retracted unless asked for."""
    kept = entries if with_retracted else entries.where("status <> 'retracted'")
    return kept if excluded is None else kept.join(excluded.select("id").distinct(), "id", "left_anti")


def one_of(column: Column, values: list) -> Column:
    """column IN values; an empty list admits everything."""
    return column.isin(values) if values else F.lit(True)


def recent_notes(entries: DataFrame, now: float, days: int = 14, limit: int = 5) -> DataFrame:
    """Live notes of the last days, newest first, in stored order at equal times."""
    recent = entries.where((F.col("file") == NOTES) & (F.col("status") == "active") & (F.col("at") >= now - days * 86400.0))
    return recent.orderBy(F.desc("at"), "position", "id").limit(limit)
