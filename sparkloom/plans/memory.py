"""Queries of the memory's operators over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import marks, render
from sparkloom.functions import text as T
from sparkloom.operators import archive, code, context, facade, fulltext, growth, ledger, proximity, relations, retrieval, search, segmentation, selection
from sparkloom.operators.lineage import cut_lineage, shared_folder
from sparkloom.operators.ordering import numbered
from sparkloom.plans.registry import _CLAIMS, _EDGES, _HEADS, _KNN, _KNN_ALL, _SQUASH, _VEC, _edges, _knn, _knn_all, _lines, _LINE_SQL, _links, _nodes, _t, query
from sparkloom.sources import intake
from sparkloom.sources.store import Store


def _store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- stored tables


@query("""SELECT c_custkey, c_name, c_nationkey, round(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS c_acctbal FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT -1, 'new', 7, 1.0""")
def store_upsert(spark, d):
    """All customers put, every fifth put again with another balance, twice in one batch; a nation deleted; a new one put."""
    store = _store(spark)
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    store.put("customer", ["c_custkey"], rows)
    fifth = rows.where("c_custkey % 5 = 0")
    again = fifth.withColumns({"c_acctbal": F.col("c_acctbal") + 100, "seq": F.lit(1)}).unionByName(fifth.withColumn("seq", F.lit(0)))
    store.put("customer", ["c_custkey"], again, "seq")
    store.delete("customer", "c_nationkey = 3")
    store.put("customer", ["c_custkey"], spark.createDataFrame([(-1, "new", 7, 1.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double"))
    store.compact(0)
    return store.rows("customer").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def store_replace(spark, d):
    """A table replaced by other rows, by none under a guard, and another by none without it."""
    store = _store(spark)
    rows = _t(spark, d, "nation")
    store.replace("nation", rows, ["n_nationkey"])
    store.replace("nation", rows.where("n_nationkey >= 5"), ["n_nationkey"])
    store.replace("nation", rows.limit(0), ["n_nationkey"], guard=True)
    store.replace("gone", rows, ["n_nationkey"])
    store.replace("gone", rows.limit(0), ["n_nationkey"])
    return store.rows("nation", ["n_regionkey"], "n_nationkey >= 0").unionByName(store.rows("gone", empty="n_regionkey int")).groupBy("n_regionkey").agg(F.count("*").alias("n"))


ASKED = {1: "the first ERSTE", 2: "idiot pathetic anon", 3: "où für naïve"}
_ASKED = "q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'))) AS word FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in ASKED.items()) + ") AS v(query_id, t))"
_TERMS = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w WHERE w IS NOT NULL),
tf AS (SELECT id, len, word, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (word) JOIN q USING (word), st GROUP BY ALL),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place, id, score FROM bm QUALIFY place <= 40)"""


def _found(spark, d):
    store = _store(spark)
    fulltext.index_words(store, "documents", _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return fulltext.find_words(store, "documents", spark.createDataFrame(list(ASKED.items()), "query_id long, text string"), 40)


@query(f"WITH {_ASKED}, {_TERMS} SELECT * FROM found")
def stored_words(spark, d):
    """Three queries over the stored full-text index of all documents."""
    return _found(spark, d).drop("via")


@query("SELECT word, count(*) AS texts, sum(tf)::BIGINT AS occurrences FROM (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY ALL) GROUP BY word")
def word_statistics(spark, d):
    return fulltext.postings(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("word").agg(F.count("*").alias("texts"), F.sum("tf").alias("occurrences"))


# ---------------------------------------------------------------- retrieval

_TWO = f"""{_KNN}, l0 AS (SELECT query_id, 0 AS list_no, rank AS place, id, 'space' AS via FROM knn), l1 AS (SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY id DESC), id, 'other' FROM knn WHERE id % 3 > 0),
l2 AS (SELECT a.id AS query_id, 2, row_number() OVER (PARTITION BY a.id ORDER BY b.id), b.id, 'label' FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0 AND b.id < 60), lists AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def _lists(spark, d):
    knn = _knn(spark, d)
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    one = knn.select("query_id", F.lit(0).alias("list_no"), F.col("rank").alias("place"), "id", F.lit("space").alias("via"))
    two = knn.where("id % 3 > 0").select("query_id", F.lit(1).alias("list_no"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id"))).alias("place"), "id", F.lit("other").alias("via"))
    pairs = labels.where("id % 100 = 0").withColumnRenamed("id", "query_id").join(labels.where("id < 60"), "label").where("query_id <> id")
    three = pairs.select("query_id", F.lit(2).alias("list_no"), F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("place"), "id", F.lit("label").alias("via"))
    return one.unionByName(two).unionByName(three)


def _fused_sql(first: int) -> str:
    return f"SELECT query_id, id, round(sum(1.0::DOUBLE / ({59 + first} + place)), 6) AS score, arg_min(via, list_no) AS via FROM lists GROUP BY query_id, id"


@query(f"WITH {_TWO}, f AS ({_fused_sql(1)}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place, id, score, via FROM f QUALIFY place <= 15")
def fuse_many(spark, d):
    return retrieval.fuse_lists(_lists(spark, d), 60, 15)


@query(f"WITH {_TWO}, f AS ({_fused_sql(2)}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place, id, score, via FROM f QUALIFY place <= 15")
def fuse_many_from_zero(spark, d):
    """Places count from 0: the sum is over k + place + 1 with places from 0."""
    return retrieval.fuse_lists(_lists(spark, d).withColumn("place", F.col("place") + 1), 60, 15)


_ENTRIES = f"""entries AS (SELECT doc_id AS id, source AS file, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS position, md5({_SQUASH}) AS digest, text, CASE WHEN doc_id % 4 = 0 THEN left(text, 30) ELSE '' END AS question, doc_id * 3600.0::DOUBLE AS at_s, CASE WHEN doc_id % 10 = 0 THEN 'retracted' ELSE 'active' END AS status FROM documents)"""


def _entries(spark, d):
    position = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("position")
    docs = _t(spark, d, "documents")
    question = F.when(F.col("doc_id") % 4 == 0, F.left("text", F.lit(30))).otherwise(F.lit(""))
    status = F.when(F.col("doc_id") % 10 == 0, "retracted").otherwise("active")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), position, T.digest(F.col("text")).alias("digest"), "text", question.alias("question"), F.col("text").alias("answer"), (F.col("doc_id") * F.lit(3600.0)).alias("at"), status.alias("status"), F.lit(0.0).alias("retracted_at"), F.lit("").alias("session"), F.lit("file").alias("origin"))


@query(f"""WITH {_KNN}, {_ENTRIES}, h AS (SELECT knn.*, digest FROM knn JOIN entries USING (id) WHERE status <> 'retracted' AND id % 7 <> 0),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, digest ORDER BY rank, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id)::INTEGER AS place, id, score FROM f QUALIFY place <= 6""")
def shortlist_cards(spark, d):
    """Neighbours that are known, visible and not excluded (ids divisible by 7), the first of each content."""
    hits = _knn(spark, d).select("query_id", F.col("rank").alias("place"), "id", "score", F.lit("space").alias("via"))
    entries = _entries(spark, d)
    return retrieval.shortlist(hits, entries, 6, entries.where("id % 7 = 0").select("id")).drop("via")


@query(f"""WITH {_KNN}, c AS (SELECT query_id, rank AS place, id FROM knn WHERE id % 4 <> 1), near AS (SELECT query_id, id, score FROM knn WHERE id % 5 <> 0),
words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS place FROM knn WHERE id % 2 = 0), b AS (SELECT query_id, max(score) AS best FROM near GROUP BY 1 HAVING max(score) >= 0.25),
j AS (SELECT c.query_id, c.place, c.id, near.score FROM c JOIN b USING (query_id) LEFT JOIN near USING (query_id, id) LEFT JOIN words w ON w.query_id = c.query_id AND w.id = c.id AND w.place <= 4 WHERE near.score >= greatest(0.25, best - 0.1) OR w.id IS NOT NULL)
SELECT query_id, place, id, score FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, id) <= 4""")
def admit_cards(spark, d):
    knn = _knn(spark, d)
    cards = knn.where("id % 4 <> 1").select("query_id", F.col("rank").alias("place"), "id", F.lit(0.0).alias("score"))
    words = knn.where("id % 2 = 0").select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))).alias("place"))
    return retrieval.admit(cards, knn.where("id % 5 <> 0").select("query_id", "id", "score"), words, 0.25, 0.1, 4).select("query_id", "place", "id", "score")


@query(f"""WITH {_ENTRIES}, e AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM entries WHERE status = 'active')
SELECT count(*) AS atoms, count_if(status = 'active') AS live, count_if(status <> 'active') AS retracted FROM entries""")
def entry_counts(spark, d):
    return ledger.counts(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT id, file, position, at_s AS stamp FROM entries WHERE status = 'active' AND file = (SELECT max(file) FROM entries) AND at_s >= (SELECT max(at_s) FROM entries) - 14 * 86400.0 ORDER BY stamp DESC, position, id LIMIT 7")
def recent_entries(spark, d):
    """The newest live entries of one source within 14 days of the last."""
    entries = _entries(spark, d)
    file, last = entries.agg(F.max("file"), F.max("at")).first()
    notes = entries.where(F.col("file") == file).withColumn("file", F.lit(ledger.NOTES))
    return ledger.recent_notes(notes, last, 14, 7).select("id", F.lit(file).alias("file"), "position", F.col("at").alias("stamp"))


@query(f"""WITH {_ENTRIES}, l AS (SELECT 'doc ' || file AS path, max(at_s) AS mtime FROM entries GROUP BY 1), m AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN mtime ELSE mtime - 1 END AS mtime FROM l WHERE path <> (SELECT min(path) FROM l) UNION ALL SELECT 'old', 1.0 UNION ALL SELECT 'memory://notes', 1.0)
SELECT l.path, 'todo' AS action FROM l LEFT JOIN m USING (path) WHERE m.mtime IS NULL OR m.mtime <> l.mtime UNION ALL SELECT path, 'gone' FROM m WHERE path NOT IN (SELECT path FROM l) AND NOT starts_with(path, 'memory://')""")
def files_to_read(spark, d):
    """Marks of all sources but the first, half of them outdated, one of a source that is gone and the notes."""
    store = _store(spark)
    current = _entries(spark, d).groupBy(F.concat(F.lit("doc "), F.coalesce("file", F.lit(""))).alias("path")).agg(F.max("at").alias("mtime"), F.max(F.col("file").isNull()).alias("none")).where("NOT none").drop("none")
    first = current.agg(F.min("path")).first()[0]
    done = current.where(F.col("path") != first).withColumn("mtime", F.when(F.length("path") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1))
    ledger.mark_all(store, done)
    ledger.mark(store, "old", 1.0)
    ledger.mark(store, "older", 1.0)
    ledger.mark(store, "older", 0.0)
    ledger.mark(store, ledger.NOTES, 1.0)
    return ledger.plan(store, current)


# ---------------------------------------------------------------- rendering

_TURNS = f"t AS (SELECT conv_id, turn, role, text, trim(regexp_replace(text, '[\\s\\x0B\\x{{85}}]+', ' ', 'g')) AS sq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS of_n FROM conversations)"


@query(f"""WITH {_TURNS}, i AS (SELECT *, greatest(300, ((900 - {len("<memory>") + 1 + len(context.RECALL_HEAD)}) / of_n)::BIGINT - 120) AS lim FROM (SELECT * REPLACE (of_n::DOUBLE AS of_n) FROM t)),
j AS (SELECT conv_id, n, n || '. [2024-01-01 · ' || role || ' · ' || format('{{:.2f}}', turn / 8) || '] ' || CASE WHEN length(sq) <= lim THEN sq ELSE rtrim(left(sq, lim::INTEGER), ' ') || ' …' END || CASE WHEN turn % 2 = 1 THEN chr(10) || '   ↳ ' || left(sq, 200) ELSE '' END AS line FROM (SELECT * REPLACE (greatest(300, floor((900 - {len("<memory>") + 1 + len(context.RECALL_HEAD)}) / of_n) - 120) AS lim) FROM i)),
u AS (SELECT *, {len("<memory>") + 1 + len(context.RECALL_HEAD) + 1 + len("</memory>")} + sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY n) AS used FROM j)
SELECT conv_id, md5('<memory>' || chr(10) || '{context.RECALL_HEAD.replace("'", "''")}' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || '</memory>') AS block, count(*)::INTEGER AS shown FROM u WHERE used <= 900 GROUP BY conv_id""")
def recall_blocks(spark, d):
    """Conversations as cards: turns in order, every second with a note."""
    turns = _t(spark, d, "conversations")
    notes = F.when(F.col("turn") % 2 == 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    cards = turns.select("conv_id", "turn", F.lit("2024-01-01").alias("day"), F.col("role").alias("file"), (F.col("turn") / 8).alias("score"), "text", notes.alias("notes"))
    return context.render_recall(cards, "conv_id", ["turn"], 900).select("conv_id", F.md5("block").alias("block"), "shown")


@query("""WITH l AS (SELECT conv_id, turn, '[' || role || ' ' || turn || '] ' || text AS line FROM conversations), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM l)
SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS block FROM u WHERE used <= 800 GROUP BY conv_id""")
def assemble_pieces(spark, d):
    pieces = _t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("turn").cast("string").alias("ref"), "text")
    return context.assemble(pieces, "conv_id", ["turn"], 800).select("conv_id", F.md5("block").alias("block"))


@query(f"""SELECT '<memory>' || chr(10) || '{context.BRIEF_HEAD.format(live='')}'.replace('  ', ' ' || (SELECT count(*) FROM documents) || ' ') || chr(10) || '{context.RECENT_HEAD}' || chr(10) || string_agg('- [2024-01-0' || n || ' · ' || source || '] ' || left({_SQUASH}, 160), chr(10) ORDER BY n) || chr(10) || '</memory>' AS block
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n <= 5""")
def brief_block(spark, d):
    docs = _t(spark, d, "documents")
    top = docs.where("source IS NOT NULL").orderBy("doc_id").limit(5)
    notes = top.withColumn("place", F.row_number().over(Window.orderBy("doc_id"))).select("place", F.concat(F.lit("2024-01-0"), F.col("place").cast("string")).alias("day"), F.col("source").alias("file"), "text")
    return context.render_brief(docs.count(), notes, 5000)


@query("SELECT o_orderstatus, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT o_orderstatus, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS p FROM orders WHERE o_totalprice > 0) GROUP BY 1")
def weight_entropy(spark, d):
    return _t(spark, d, "orders").where("o_totalprice > 0").groupBy("o_orderstatus").agg(F.round(context.entropy(F.col("o_totalprice")), 6).alias("entropy"))


# ---------------------------------------------------------------- text, marks, intake


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_./~\\-]+')) AS w FROM documents), p AS (SELECT doc_id, regexp_replace(w, '\.+$', '') AS w FROM r)
SELECT doc_id, count(*) AS n, min(w) AS least, max(w) AS most FROM p WHERE regexp_matches(w, '\.[\p{L}\p{N}]+$') GROUP BY doc_id""")
def word_paths(spark, d):
    paths = _t(spark, d, "documents").select("doc_id", F.explode(marks.word_paths(F.col("text"))).alias("w"))
    return paths.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"))


@query("""SELECT page_id, 'Done.' || chr(10) || CASE page_id % 4 WHEN 0 THEN 'Tools: [инструмент Edit: ' || url || ']' WHEN 1 THEN '[инструмент Read: ' || url || ']' WHEN 2 THEN '[Bash] ' || url ELSE '[Edit] ' END AS marked, CASE page_id % 4 WHEN 0 THEN url ELSE '' END AS edited, CASE page_id % 4 WHEN 1 THEN url ELSE '' END AS read FROM pages WHERE url IS NOT NULL AND NOT contains(url, ']')""")
def tool_marks(spark, d):
    """Tool lines with page addresses for paths, as marks, and the paths read back from them."""
    kind = F.element_at(F.array(*map(F.lit, ("Tools: [Edit]   ", "[Read] ", "[Bash] "))), (F.col("page_id") % 4 + 1).cast("int"))
    line = F.when(F.col("page_id") % 4 == 3, F.lit("[Edit] ")).otherwise(F.concat(kind, F.col("url")))
    pages = _t(spark, d, "pages").where("url IS NOT NULL AND NOT contains(url, ']')").where("page_id % 4 < 4")
    text = marks.mark_text(F.concat(F.lit("Done.\n"), F.try_element_at(F.array(line), F.lit(1))))
    marked = pages.select("page_id", text.alias("marked"))
    return marked.select("page_id", "marked", F.array_join(marks.tool_paths(F.col("marked"), marks.EDITS), " ").alias("edited"), F.array_join(marks.tool_paths(F.col("marked"), ("Read",)), " ").alias("read"))


_PATHS = "p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), k AS (SELECT DISTINCT regexp_extract(path, '([^/]*/)?[^/]*$', 0) AS file FROM p WHERE page_id % 3 = 0)"


@query(f"WITH {_PATHS} SELECT page_id, arg_max(file, length(file)) AS file FROM p JOIN k ON file <> '' AND ends_with('/' || path, '/' || file) GROUP BY page_id")
def resolve_paths(spark, d):
    """The longest known file, the last two parts of every third address, that an address ends in."""
    pages = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    files = pages.where("page_id % 3 = 0").select(F.regexp_extract("path", "([^/]*/)?[^/]*$", 0).alias("file"))
    return code.resolve(pages, files).select("page_id", "file")


_SYMBOLS = "nodes AS (SELECT r_name || '.' || n_name || '.' || replace(s_name, '#', '_') AS qn, replace(s_name, '#', '_') AS name, 'Function' AS label, lower(r_name) || '/' || lower(n_name) || '.py' AS file, s_suppkey::INTEGER AS first, s_suppkey::INTEGER + 5 AS last FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '.' || n_name || '.run', 'run', 'Function', lower(r_name) || '/' || lower(n_name) || '.py', 1, 2 FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _symbols(spark, d):
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    file = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".py")).alias("file")
    name = F.replace("s_name", F.lit("#"), F.lit("_"))
    one = _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "r_name", "n_name", name).alias("qn"), name.alias("name"), F.lit("Function").alias("label"), file, F.col("s_suppkey").cast("int").alias("start"), (F.col("s_suppkey") + 5).cast("int").alias("end"))
    two = nation.select(F.concat_ws(".", "r_name", "n_name", F.lit("run")).alias("qn"), F.lit("run").alias("name"), F.lit("Function").alias("label"), file, F.lit(1).alias("start"), F.lit(2).alias("end"))
    return one.unionByName(two)


@query(f"""WITH {_SYMBOLS}, names AS (SELECT DISTINCT unnest([qn, name, regexp_extract(qn, '[^.]*[.][^.]*$', 0), 'x.' || name]) AS name FROM nodes),
m AS (SELECT names.name, count(DISTINCT qn) AS n, min(qn) AS qn, bool_or(qn = names.name) AS exact FROM names JOIN nodes ON CASE WHEN contains(names.name, '.') THEN qn = names.name OR ends_with(qn, '.' || names.name) ELSE nodes.name = names.name END GROUP BY 1)
SELECT name, CASE WHEN contains(name, '.') AND exact THEN name ELSE qn END AS qn FROM m WHERE n = 1 OR (exact AND contains(name, '.'))""")
def lookup_symbols(spark, d):
    nodes = _symbols(spark, d)
    names = nodes.select(F.explode(F.array("qn", "name", F.regexp_extract("qn", "[^.]*[.][^.]*$", 0), F.concat(F.lit("x."), "name"))).alias("name")).distinct()
    return code.lookup(names, nodes)


@query(f"""WITH {_SYMBOLS} SELECT DISTINCT src, dst, 'contains' AS kind FROM (SELECT 'dir:' AS src, 'dir:' || split_part(file, '/', 1) AS dst FROM nodes UNION ALL SELECT 'dir:' || split_part(file, '/', 1), 'file:' || file FROM nodes UNION ALL SELECT 'file:' || file, qn FROM nodes)""")
def code_tree(spark, d):
    return code.tree_edges(_symbols(spark, d))


@query("""SELECT 'src:' || role AS src, conv_id || ':' || turn AS dst, 'contains' AS kind FROM conversations
UNION ALL SELECT a, b, 'next' FROM (SELECT conv_id || ':' || turn AS a, lead(conv_id || ':' || turn) OVER (PARTITION BY role ORDER BY turn, conv_id) AS b FROM conversations) WHERE b IS NOT NULL""")
def text_sources(spark, d):
    """Roles as files, turns as atoms, repeated once more."""
    turns = _t(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("file"), F.col("turn").alias("order"), (F.col("turn") * 1000000 + F.col("conv_id")).alias("seq"))
    return code.source_edges(turns.unionByName(turns.select("id", F.lit("again").alias("file"), "order", (F.col("seq") + 10**12).alias("seq"))))


@query(f"""WITH {_SYMBOLS}, atoms AS (SELECT doc_id AS id, first, qn, name, file FROM documents JOIN nodes ON first = doc_id AND name <> 'run'),
e AS (SELECT id AS src, 'file:' || file AS dst, 'edits' AS kind, 0 AS rank FROM atoms WHERE id % 3 = 0 UNION ALL SELECT id, 'file:' || file, 'mentions', 2 FROM atoms WHERE id % 3 <> 0 AND NOT contains(file, ' ') UNION ALL SELECT id, qn, 'mentions', 3 FROM atoms)
SELECT src, dst, kind, rank FROM e""")
def stitch_texts(spark, d):
    """Texts that edit or name a supplier's file and name its symbol, once in full and once in backticks."""
    nodes = _symbols(spark, d)
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("[инструмент Edit: /home/u/"), "file", F.lit("] and ["), F.lit("инструмент Read: "), "file", F.lit("]"))).otherwise(F.concat(F.lit("see /x/"), "file", F.lit(".")))
    atoms = _t(spark, d, "documents").select(F.col("doc_id").alias("id")).join(nodes.where("name <> 'run'"), F.col("id") == F.col("start")).select("id", F.concat(said, F.lit(" calls "), "qn", F.lit(" or `"), "name", F.lit("` or run(x)")).alias("text"))
    return code.stitch(atoms, nodes).drop("place")


@query("""SELECT page_id, CASE WHEN (ends_with(url, '1') OR ends_with(url, '2') OR contains(url, '1/') OR contains(url, '2/')) AND NOT (ends_with(url, '/11') OR contains(url, '/11/')) THEN 'excluded' WHEN length(html) > 1000 THEN 'too big' WHEN NOT contains(url, '.org/') THEN 'not included' ELSE '' END AS reason FROM pages WHERE url IS NOT NULL AND NOT contains(url, '?') AND NOT contains(url, '#')""")
def intake_reasons(spark, d):
    """Ignore patterns over addresses: names that end in 1 or 2, but for 11; a size; what lies below an .org host."""
    pages = _t(spark, d, "pages").where("url IS NOT NULL AND NOT contains(url, '?') AND NOT contains(url, '#')")
    return pages.select("page_id", intake.admission(F.col("url"), F.length("html"), ["*.org/", "broken[z-a]"], ["*[12]", "!11", "# comment", "!"], 1000).alias("reason"))


@query(r"""SELECT doc_id, (regexp_matches(left(text, 4000), '(?i)(licensed under the apache license|mit license|bsd \d-clause|gnu general public license|mozilla public license|spdx-license-identifier)') OR regexp_matches(left(text, 4000), '(?i)copyright\s*(\(c\)|©)?\s*\d{4}[^\n]{0,80}?(inc\.|llc|ltd|gmbh|corporation|foundation|university|institute)')) AND NOT contains(lower(left(text, 4000)), 'lorem') AS is_foreign FROM documents""")
def foreign_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", intake.looks_foreign(F.col("text"), ["lorem"]).alias("is_foreign"))


@query("""SELECT doc_id, sha1(sha1(trim(regexp_replace(text, '[\\s\\x0B\\x{85}]+', ' ', 'g'))) || chr(0) || coalesce(source, '')) AS key, contains(lower(text), 'the ') OR contains(lower(text), 'und ') AS marked, (CASE WHEN source = 'src1' THEN 0.6 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.4 ELSE 0 END)::DOUBLE AS affinity FROM documents""")
def text_keys(spark, d):
    docs = _t(spark, d, "documents")
    affinity = T.metadata_affinity(F.coalesce("source", F.lit("")), F.lit("src1"), F.coalesce("lang", F.lit("")), F.lit("de"))
    return docs.select("doc_id", T.atom_key(F.col("text"), F.coalesce("source", F.lit(""))).alias("key"), T.has_marker(F.col("text"), ["the ", "und "]).alias("marked"), affinity.alias("affinity"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::DOUBLE AS k, CASE WHEN value >= 0 AND isfinite(value) THEN value ELSE 0.0 END AS value, round(epoch_us(ts) / 1e6, 3) AS seconds, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS kind FROM events""")
def loose_values(spark, d):
    """Numbers from text and from doubles, times from ISO text, thousandths or seconds, missing text."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    said = F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise((at * 1000).cast("decimal(20,3)").cast("string"))
    kind = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "None")).otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", T.number(F.get_json_object("props", "$.k")).alias("k"), T.number(F.col("value")).alias("value"), F.round(T.epoch(said), 3).alias("seconds"), T.plain(kind).alias("kind"))


@query(f"""WITH {_LINE_SQL}, p AS (SELECT id, position // 2 AS pair, position % 2 AS side, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) - 1 AS i FROM lines))
SELECT id, pair::BIGINT AS pair, md5(coalesce(max(text) FILTER (side = 0), '')) AS question, md5(coalesce(max(text) FILTER (side = 1), '')) AS answer FROM p GROUP BY id, pair""")
def pairs_in_order(spark, d):
    return segmentation.paired_in_order(_lines(spark, d)).select("id", "pair", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(f"""WITH {_LINE_SQL}, s AS (SELECT id, position, CASE position % 5 WHEN 0 THEN 'q' WHEN 2 THEN 'a' WHEN 3 THEN 'a' END AS label, text FROM lines), t AS (SELECT *, CASE WHEN position % 5 < 2 THEN 'q' ELSE 'a' END AS side, position // 5 AS pair FROM s)
SELECT id, pair::BIGINT AS pair, md5(coalesce(string_agg(CASE label WHEN 'q' THEN 'User: ' || text ELSE text END, chr(10) || chr(10) ORDER BY position) FILTER (side = 'q'), '')) AS question, md5(coalesce(string_agg(CASE label WHEN 'a' THEN '## Assistant : ' || text ELSE text END, chr(10) || chr(10) ORDER BY position) FILTER (side = 'a'), '')) AS answer FROM t GROUP BY id, pair""")
def pairs_by_label(spark, d):
    """Lines labelled in fives: a question, one without a label, two answers, one without a label."""
    five = F.col("position") % 5
    text = F.when(five == 0, F.concat(F.lit("User: "), "text")).when(five.isin(2, 3), F.concat(F.lit("## Assistant : "), "text")).otherwise(F.regexp_replace("text", "^", ""))
    blocks = segmentation.labelled(_lines(spark, d).withColumn("text", text)).withColumn("label", F.when(five.isin(0, 2, 3), F.col("label")))
    return segmentation.grouped_by_labels(blocks).select("id", "pair", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(r"""WITH l AS (SELECT unnest(string_split(html, chr(10))) AS x FROM pages), c AS (SELECT x FROM (SELECT unnest(regexp_extract_all(html, '[\p{L}\p{N}_]+')) AS x FROM pages) WHERE regexp_full_match(x, '[A-Z][a-zA-Z0-9]{2,}([A-Z][a-zA-Z0-9]*)+') UNION ALL SELECT unnest(regexp_extract_all(html, '`([a-zA-Z0-9_./-]{3,40})`', 1)) FROM pages)
SELECT array_to_string((SELECT coalesce(list(x ORDER BY x), []) FROM (SELECT DISTINCT trim(regexp_replace(trim(x), '^#{1,2}\s+', '')) AS x FROM l WHERE regexp_matches(trim(x), '^#{1,2}\s+.+') ORDER BY x LIMIT 50)), '|') AS modules, array_to_string((SELECT coalesce(list(x ORDER BY x), []) FROM (SELECT DISTINCT x FROM c ORDER BY x LIMIT 100)), '|') AS concepts""")
def project_outline(spark, d):
    out = segmentation.project_outline(_t(spark, d, "pages").select(F.col("html").alias("text")))
    return out.select(F.array_join("modules", "|").alias("modules"), F.array_join("concepts", "|").alias("concepts"))


# ---------------------------------------------------------------- relations

_PEOPLE = f"{_CLAIMS}, {_HEADS}, ids AS (SELECT src AS id FROM links UNION SELECT dst FROM links), people AS (SELECT id, 'text ' || id AS text, 'f' || id % 7 AS file, id * 86400.0::DOUBLE AS at_s, CASE WHEN id % 10 = 0 THEN 'retracted' ELSE 'active' END AS status FROM ids WHERE id % 13 <> 0), st AS (SELECT id, CASE WHEN status = 'retracted' THEN 'retracted' WHEN id IN (SELECT dst FROM heads) THEN 'superseded' ELSE 'active' END AS state FROM people)"


def _people(spark, d):
    """Things of the relations, all but ids divisible by 13 known."""
    links = _links(spark, d).withColumn("source", F.lit("log"))
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where("id % 13 <> 0")
    entries = ids.select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("file"), (F.col("id") * F.lit(86400.0)).alias("at"), F.when(F.col("id") % 10 == 0, "retracted").otherwise("active").alias("status"), F.lit("").alias("question"))
    return links, entries


@query(f"""WITH {_PEOPLE}, lk AS (SELECT src AS id, dst AS other, 'out' AS dir, kind, valid_at FROM links WHERE invalid_at = 0 UNION ALL SELECT dst, src, 'in', kind, valid_at FROM links WHERE invalid_at = 0)
SELECT lk.id, (row_number() OVER (PARTITION BY lk.id ORDER BY list_position(['supersedes', 'contradicts', 'fixes', 'refines', 'continues', 'returns_to', 'reinforces'], kind), valid_at, other, dir) - 1)::INTEGER AS place, dir, kind, other, state AS status, strftime(epoch_ms((at_s * 1000)::BIGINT), '%Y-%m-%d') AS day, text FROM lk JOIN people p ON p.id = other JOIN st ON st.id = other""")
def card_links(spark, d):
    links, entries = _people(spark, d)
    return relations.link_rows(links, entries).drop("source")


@query(f"""WITH {_PEOPLE}, top AS (SELECT * FROM links WHERE kind IN ('supersedes', 'contradicts') ORDER BY valid_at DESC, src, dst LIMIT 200)
SELECT kind, valid_at AS at_s, invalid_at <> 0 AS closed, src AS new_id, a.text AS new_text, a.file AS new_file, sa.state AS new_state, dst AS old_id, b.text AS old_text, sb.state AS old_state FROM top JOIN people a ON a.id = src JOIN st sa ON sa.id = src JOIN people b ON b.id = dst JOIN st sb ON sb.id = dst""")
def decisions(spark, d):
    links, entries = _people(spark, d)
    rows = relations.decisions(links, entries, 200)
    return rows.select("kind", F.col("at").alias("at_s"), "closed", "new_id", "new_text", "new_file", "new_state", "old_id", "old_text", "old_state")


_SEQ = f"{_CLAIMS}, {_HEADS}, sq AS (SELECT *, row_number() OVER (ORDER BY valid_at, src, dst, kind) AS seq FROM links)"


def _numbered(spark, d):
    return numbered(_links(spark, d), "valid_at", "src", "dst", "kind")


@query(f"WITH {_SEQ} SELECT id, min(s)::BIGINT AS seq FROM (SELECT dst AS id, seq * 2 AS s FROM sq WHERE src < 6 UNION ALL SELECT src, seq * 2 + 1 FROM sq WHERE dst < 6) GROUP BY id")
def relation_ends(spark, d):
    """What the things below 6 are related to, by first appearance."""
    return relations.ends(_numbered(spark, d), spark.range(6))


@query(f"""WITH RECURSIVE {_SEQ}, near AS (SELECT unnest([2, 3])::BIGINT AS id UNION SELECT dst FROM sq WHERE src IN (2, 3) UNION SELECT src FROM sq WHERE dst IN (2, 3)),
ch AS (SELECT id FROM near UNION SELECT h.src FROM ch JOIN heads h ON h.dst = ch.id)
SELECT src, dst, kind, valid_at, invalid_at, seq::BIGINT AS seq FROM sq WHERE src IN (2, 3) OR dst IN (2, 3) OR (kind = 'supersedes' AND invalid_at = 0 AND dst IN (SELECT id FROM ch))""")
def relation_scope(spark, d):
    return relations.scope(_numbered(spark, d), spark.range(2, 4))


@query(f"""WITH RECURSIVE {_SEQ}, bi AS (SELECT src AS a, dst AS b FROM sq UNION SELECT dst, src FROM sq),
r AS (SELECT 1::BIGINT AS query, 1::BIGINT AS id, 0 AS hop UNION SELECT query, b, hop + 1 FROM r JOIN bi ON a = id WHERE hop < 3) SELECT query, id, min(hop) AS hop FROM r GROUP BY 1, 2""")
def relation_neighbourhood(spark, d):
    start = spark.range(1, 2).select(F.col("id").alias("query"), "id")
    return relations.neighbourhood(_numbered(spark, d), start, 3, 10**6).select("query", "id", "hop")


@query(f"""WITH {_SEQ}, e AS (SELECT 1::BIGINT AS query, id, seq FROM (SELECT id, min(s) AS seq FROM (SELECT dst AS id, seq * 2 AS s FROM sq WHERE src = 1 UNION ALL SELECT src, seq * 2 + 1 FROM sq WHERE dst = 1) GROUP BY id) WHERE id <> 1)
SELECT query, id, (1 + row_number() OVER (ORDER BY seq))::INTEGER AS place FROM e QUALIFY place <= 9 UNION ALL SELECT 1, 1, 1""")
def relation_layer(spark, d):
    """One layer under a limit: neighbours by the order of the relations."""
    links = _numbered(spark, d)
    start = spark.range(1, 2).select(F.col("id").alias("query"), "id")
    return relations.neighbourhood(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seq").unionByName(links.select("src", "dst", "seq").limit(0)), start, 1, 9).select("query", "id", "place")


@query(f"WITH {_SEQ} SELECT DISTINCT src, dst, kind FROM sq WHERE src < 40 AND dst < 40")
def relation_ego(spark, d):
    return relations.ego(_numbered(spark, d), spark.range(40))


@query(f"""WITH RECURSIVE {_SEQ}, first AS (SELECT dst AS id, arg_min(src, seq) AS newer FROM sq WHERE kind = 'supersedes' GROUP BY dst),
w AS (SELECT id, 1 AS hop, newer, [id, newer] AS path FROM first UNION ALL SELECT w.id, hop + 1, f.newer, list_append(path, f.newer) FROM w JOIN first f ON f.id = w.newer WHERE hop < 20 AND NOT list_contains(path, f.newer)) SELECT id, hop, newer FROM w""")
def version_chain(spark, d):
    return relations.version_chain(_numbered(spark, d))


@query(f"WITH {_SEQ} SELECT count(*) AS replaced FROM heads WHERE dst < 100")
def replaced_count(spark, d):
    return ledger.replaced(_numbered(spark, d), spark.range(100))


# ---------------------------------------------------------------- proximity

_PROPOSED = f"""{_VEC}, s0 AS (SELECT a.id AS q, b.id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id < 300 AND b.id < 300),
near AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 6), prop AS (SELECT least(q, id) AS u, greatest(q, id) AS v, max(score) AS similarity FROM near GROUP BY 1, 2)"""


def _proposed(spark, d):
    v = _t(spark, d, "embeddings").where("vec_id < 300").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return proximity.propose(v, 6)


@query(f"WITH {_PROPOSED} SELECT * FROM prop WHERE similarity >= 0.2")
def proposed_pairs(spark, d):
    """Six neighbours of each of the first vectors, as pairs of some similarity."""
    return proximity.threshold(_proposed(spark, d), 0.2)


@query(f"""WITH {_PROPOSED}, other AS (SELECT u, v, similarity / 2 AS similarity FROM prop WHERE u % 2 = 0 UNION ALL SELECT v, u + 1000, 0.5 FROM prop WHERE v % 5 = 0),
e AS (SELECT *, 'a' AS s FROM prop UNION ALL SELECT least(u, v), greatest(u, v), similarity, 'b' FROM other) SELECT u, v, max(similarity) AS similarity, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM e GROUP BY u, v""")
def union_layers(spark, d):
    p = _proposed(spark, d)
    other = p.where("u % 2 = 0").withColumn("similarity", F.col("similarity") / 2).unionByName(p.where("v % 5 = 0").select("v", (F.col("u") + 1000).alias("u"), F.lit(0.5).alias("similarity")).select("u", "v", "similarity"))
    return proximity.union_layers({"a": p, "b": other}).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {_PROPOSED}, r AS (SELECT u, v, row_number() OVER (ORDER BY similarity DESC, u, v) - 1 AS p FROM prop UNION ALL SELECT u, v, row_number() OVER (ORDER BY similarity / 3 DESC, u, v) - 1 FROM prop WHERE u % 3 = 0)
SELECT u, v, round(sum(1.0::DOUBLE / (61 + p)), 8) AS similarity FROM r GROUP BY u, v""")
def fused_layers(spark, d):
    p = _proposed(spark, d)
    fused = proximity.fuse_layers({"a": p, "b": p.where("u % 3 = 0").withColumn("similarity", F.col("similarity") / 3)})
    return fused.withColumn("similarity", F.round("similarity", 8))


@query(f"WITH {_PROPOSED}, b AS (SELECT u AS node, v AS other, similarity FROM prop UNION ALL SELECT v, u, similarity FROM prop) SELECT node, row_number() OVER (PARTITION BY node ORDER BY similarity DESC, other)::INTEGER AS rank, other, similarity FROM b QUALIFY rank <= 4")
def strongest_links(spark, d):
    return archive.neighbours(_proposed(spark, d), 4)


@query()
def grafted_graph(spark, d):
    """Links of each label's vectors under a degree budget; order-dependent, held against a plain version in the tests."""
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("u"), "label")
    return proximity.graft(_proposed(spark, d).join(labels, "u"), "label", 4)


def _grown(spark, d, **relations):
    """An archive for each source's documents of one language, over hashed words; two hours between numbers that follow each other."""
    docs = _t(spark, d, "documents").where("doc_id IS NOT NULL").withColumn("id", F.col("doc_id").cast("string"))
    about = docs.select("id", F.concat_ws("/", "source", "lang").alias("project"), F.col("doc_id").alias("seq"), F.concat(F.lit("f"), F.col("doc_id") % 3).alias("file"), F.lit(None).cast("string").alias("folder"), F.col("source").alias("session"), (F.col("doc_id") * 7200.0).alias("at"), "text")
    return growth.grow(search.with_hashes(about, 256), "project", relations=relations or None)


@query()
def grown_nodes(spark, d):
    """Where each document lands; order-dependent, held against worked cases and a replay of its states in the tests."""
    return _grown(spark, d)[0]


@query()
def grown_links(spark, d):
    """The links of the same archives, with relations under a degree budget."""
    return _grown(spark, d, seed=1)[1]


@query()
def grown_branches(spark, d):
    """The branches of the same archives and the state they end in."""
    return _grown(spark, d)[2].drop("centroid")


@query(f"""WITH {_EDGES}, dg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ends UNION ALL SELECT v FROM ends) GROUP BY node), nodes AS (SELECT p_partkey * 2 AS id FROM part UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
a AS (SELECT coalesce(degree, 0) AS degree FROM nodes LEFT JOIN dg ON node = id), t AS (SELECT count(*) AS n, sum(degree) / 2 AS m, list_sort(list(degree)) AS s FROM a), x AS (SELECT n, m, s, 2.0::DOUBLE * m / n AS c, ln(n) AS l FROM t)
SELECT n, m::BIGINT AS m, round(c, 2) AS c, ((s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2)::INTEGER AS median, s[n] AS max_degree, round(l, 2) AS ln_n, greatest(2, ceil(3 * l))::INTEGER AS budget, c >= 3 * l AS connected, len(list_filter(s, lambda y: y = 0))::BIGINT AS isolated, round(100 * exp(-c), 2) AS isolated_random_pct, greatest(1, ceil(l / ln(c)))::INTEGER AS depth, round(100.0 * list_sum(list_reverse_sort(s)[1:greatest(1, n // 100)]) / (2 * m), 1)::DOUBLE AS hot_share_pct FROM x""")
def graph_connectivity(spark, d):
    return proximity.connectivity(_nodes(spark, d), _edges(spark, d))


@query(f"""WITH {_CLAIMS}, n AS (SELECT id, id % 4 AS branch, id * 86400.0::DOUBLE AS at_s FROM range(1, 100) r(id)), e AS (SELECT l.kind, a.branch AS ab, b.branch AS bb, abs(a.at_s - b.at_s) / 86400 > 21 AND a.at_s <> 0 AND b.at_s <> 0 AS far FROM links l LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst)
SELECT count(*) AS edges, round(100.0 * count_if(kind = 'continues') / count(*), 2)::DOUBLE AS continues_pct, round(100.0 * count_if(ab <> bb) / count_if(ab IS NOT NULL AND bb IS NOT NULL), 2)::DOUBLE AS between_pct, round(100.0 * count_if(far) / count_if(ab IS NOT NULL AND bb IS NOT NULL), 2)::DOUBLE AS far_pct, count_if(far AND kind = 'continues') AS far_continues FROM e""")
def graph_coagulation(spark, d):
    nodes = spark.range(1, 100).select("id", (F.col("id") % 4).alias("branch"), (F.col("id") * F.lit(86400.0)).alias("at"))
    return proximity.coagulation(nodes, _links(spark, d))


@query(f"""WITH {_KNN_ALL}, p AS (SELECT k.score, a.label = b.label AS same FROM knn k JOIN v a ON a.id = k.query_id JOIN v b ON b.id = k.id)
SELECT round(sum(CASE WHEN s.score > t.score THEN 1.0 WHEN s.score = t.score THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auc FROM (SELECT score FROM p WHERE same) s, (SELECT score FROM p WHERE NOT same) t""")
def label_auc(spark, d):
    """How well scores tell neighbours of the same label, over the 20 neighbours of every vector."""
    labels = _t(spark, d, "embeddings").select("vec_id", "label")
    named = _knn_all(spark, d).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    return proximity.auc(named.select("score", (F.col("a") == F.col("b")).alias("same")))


@query(f"""WITH {_VEC}, c AS (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM v a JOIN v b ON b.id = a.id + 1) SELECT round(quantile_cont(c, 0.9), 6) AS q90, round(quantile_cont(c, 0.99), 6) AS q99 FROM c""")
def cosine_quantiles(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = proximity.cosine_quantiles(v, v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), (0.9, 0.99))
    return out.select(F.element_at("q", 1).alias("q90"), F.element_at("q", 2).alias("q99"))


# ---------------------------------------------------------------- archives

_ARCHIVE = """nodes AS (SELECT vec_id AS id, 'f' || vec_id % 9 AS file, label AS branch, vec_id AS idx, vec_id * 86400.0::DOUBLE AS at_s, coalesce(text, '') AS text, embedding::DOUBLE[] AS v, (vec_id % 17) / 17.0::DOUBLE AS rs, CASE WHEN vec_id % 2 = 0 THEN vec_id + 10 END AS parent FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""


def _archive(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    nodes = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("f"), (F.col("vec_id") % 9).cast("string")).alias("file"), F.col("label").alias("branch"), F.col("vec_id").alias("index"), (F.col("vec_id") * F.lit(86400.0)).alias("at"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), ((F.col("vec_id") % 17) / 17.0).alias("root_similarity"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 10).alias("parent"))
    return nodes.join(docs, "id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "question": F.lit(""), "answer": F.coalesce("text", F.lit("")), "status": F.lit("active"), "session": F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))})


@query(f"WITH {_CLAIMS} SELECT kind, count(*) AS n FROM links GROUP BY kind")
def edge_counts(spark, d):
    return archive.edge_counts(_links(spark, d))


@query(f"WITH {_ARCHIVE}, {_CLAIMS}, h AS (SELECT branch, max(id) AS id FROM nodes GROUP BY branch) SELECT id, branch FROM h WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) AND id NOT IN (SELECT src FROM links WHERE kind = 'refines') AND id NOT IN (SELECT dst FROM links WHERE kind = 'refines')")
def loose_heads(spark, d):
    """Refinements stand for returns."""
    edges = _links(spark, d).withColumn("kind", F.when(F.col("kind") == "refines", "returns_to").otherwise(F.col("kind")))
    return archive.loose_heads(_archive(spark, d), edges)


_BRANCHES = "b AS (SELECT branch AS id, min(id) AS root, max(id) AS head, (branch % 4) / 4.0::DOUBLE AS weight, 0.5::DOUBLE AS activation, branch % 3 = 0 AS dormant, 0.25::DOUBLE AS variance FROM nodes GROUP BY branch)"


def _branches(spark, d):
    return _archive(spark, d).groupBy(F.col("branch").alias("id")).agg(F.min("id").alias("root"), F.max("id").alias("head")).withColumns({"weight": (F.col("id") % 4) / 4.0, "activation": F.lit(0.5), "dormant": F.col("id") % 3 == 0, "variance": F.lit(0.25)})


@query(f"WITH {_ARCHIVE}, {_BRANCHES} SELECT b.id, (SELECT count(*) FROM nodes n WHERE n.branch = b.id) AS atoms, variance, weight, activation, dormant, round(r.rs, 4) AS root_similarity, left(r.text, 120) AS root_preview, left(h.text, 120) AS head_preview, r.file FROM b JOIN nodes r ON r.id = root JOIN nodes h ON h.id = head WHERE NOT dormant")
def branch_list(spark, d):
    return archive.branch_list(_branches(spark, d), _archive(spark, d), with_dormant=False)


@query(f"""WITH {_ARCHIVE}, {_SEQ}, k AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY branch ORDER BY idx DESC) <= 12), r AS (SELECT src, string_agg(kind || ' ' || dst, ',' ORDER BY seq, kind, dst) AS r FROM sq WHERE kind IN ('supersedes', 'fixes', 'contradicts', 'refines') GROUP BY src)
SELECT branch, id, idx AS position, left(text, 40) AS answer, coalesce(r, '') AS relations FROM k LEFT JOIN r ON src = id""")
def branch_lineage(spark, d):
    rows = archive.branch_lineage(_archive(spark, d), _numbered(spark, d), 12, 40)
    return rows.select("branch", "id", F.col("index").alias("position"), "answer", F.array_join("relations", ",").alias("relations"))


@query(f"""WITH {_ARCHIVE}, p AS (SELECT file, count(*) AS atoms, avg(rs) AS mean FROM nodes GROUP BY file), m AS (SELECT list(mean ORDER BY mean, file)[count(*) // 2 + 1] AS median FROM p), c AS (SELECT file, count(*) AS connected FROM (SELECT 'f1' AS file UNION ALL SELECT 'f2' UNION ALL SELECT 'f2' UNION ALL SELECT 'f3') GROUP BY 1)
SELECT p.file, '' AS folder, p.file AS name, atoms, round(mean, 4) AS similarity, coalesce(connected, 0) AS connected, coalesce(connected, 0) = 0 AND mean < median AS isolated FROM p LEFT JOIN c USING (file), m""")
def file_manifest(spark, d):
    edges = spark.createDataFrame([("f1", "f2"), ("f2", "f3")], "u string, v string")
    return archive.file_manifest(_archive(spark, d), edges)


_CENTRES = """cm AS (SELECT file, i, avg(x) AS m FROM (SELECT file, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM nodes) GROUP BY file, i), cu AS (SELECT file, i, m / sqrt(sum(m * m) OVER (PARTITION BY file)) AS x FROM cm)"""


@query(f"WITH {_ARCHIVE}, {_CENTRES} SELECT a.file AS u, b.file AS v, round(sum(a.x * b.x), 4) AS similarity FROM cu a JOIN cu b ON a.i = b.i AND a.file < b.file GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 4) >= 0.02")
def file_graph(spark, d):
    return archive.file_graph(archive.centroids(_archive(spark, d), "file"), 0.02)


_QUERY = "qv AS (SELECT v FROM nodes WHERE id = 7)"


def _query_vector(spark, d):
    return list(_archive(spark, d).where("id = 7").select("v").first().v)


@query(f"""WITH {_ARCHIVE}, {_CENTRES}, {_QUERY}, q AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM qv), t AS (SELECT file, sum(cu.x * q.x) AS s FROM cu JOIN q USING (i) GROUP BY file ORDER BY s DESC, file LIMIT 3)
SELECT id, round(list_dot_product(n.v, (SELECT v FROM qv)), 6) AS score FROM nodes n WHERE file IN (SELECT file FROM t) ORDER BY score DESC, id LIMIT 15""")
def search_by_file(spark, d):
    """Without links between files the first three files are searched."""
    nodes = _archive(spark, d)
    none = spark.createDataFrame([], "u string, v string, similarity double")
    return archive.search_by_file(nodes, archive.centroids(nodes, "file"), none, _query_vector(spark, d), 15, 3, 6)


@query(f"""WITH {_ARCHIVE}, {_QUERY}, cm AS (SELECT branch, i, avg(x) AS m FROM (SELECT branch, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM nodes) GROUP BY branch, i), cu AS (SELECT branch, i, m / sqrt(sum(m * m) OVER (PARTITION BY branch)) AS x FROM cm),
q AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM qv), h AS (SELECT branch, max(at_s) AS at_s FROM nodes GROUP BY branch), t AS (SELECT branch, 0.85 * sum(cu.x * q.x) + 0.15 * pow(0.5::DOUBLE, abs(any_value(at_s) - 1e8) / 86400 / 90) AS s FROM cu JOIN q USING (i) JOIN h USING (branch) GROUP BY branch ORDER BY s DESC, branch LIMIT 4),
c AS (SELECT * FROM nodes WHERE branch IN (SELECT branch FROM t) QUALIFY row_number() OVER (PARTITION BY branch, file ORDER BY idx) <= 2) SELECT id, round(list_dot_product(c.v, (SELECT v FROM qv)), 6) AS score FROM c ORDER BY score DESC, id LIMIT 10""")
def search_by_branch(spark, d):
    return archive.search_by_branch(_archive(spark, d), _query_vector(spark, d), 1e8, 4, 10, 2)


@query(f"""WITH {_ARCHIVE}, cm AS (SELECT branch, i, avg(x) AS m FROM (SELECT branch, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM nodes) GROUP BY branch, i), cu AS (SELECT branch, list(x ORDER BY i) AS c FROM (SELECT branch, i, m / sqrt(sum(m * m) OVER (PARTITION BY branch)) AS x FROM cm) GROUP BY branch),
l AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY branch ORDER BY idx DESC) <= 8) SELECT branch, count_if(list_dot_product(v, c) >= 0.3) AS dense FROM l JOIN cu USING (branch) GROUP BY branch""")
def local_density(spark, d):
    return archive.local_density(_archive(spark, d), 8, 0.3)


@query(f"""WITH {_ARCHIVE} SELECT branch, min(at_s) AS first_s, max(at_s) AS last_s, count(DISTINCT file) AS files, (SELECT string_agg(file || ':' || n, ',' ORDER BY file) FROM (SELECT file, count(*) AS n FROM nodes x WHERE x.branch = nodes.branch GROUP BY file)) AS histogram FROM nodes GROUP BY branch""")
def branch_signature(spark, d):
    rows = archive.branch_signature(_archive(spark, d))
    return rows.select("branch", F.col("first_at").alias("first_s"), F.col("last_at").alias("last_s"), F.size("files").cast("long").alias("files"), F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["x"], x["n"].cast("string"))), ",").alias("histogram"))


@query(f"WITH {_ARCHIVE}, s AS (SELECT list_sort(list(rs)) AS s, count(*) AS n, round(avg(rs), 4) AS mean, round(stddev_pop(rs), 4) AS deviation FROM nodes) SELECT mean, deviation, round(s[n // 10 + 1], 4) AS p10, round(s[n // 2 + 1], 4) AS p50, round(s[9 * n // 10 + 1], 4) AS p90 FROM s")
def coherence_summary(spark, d):
    out = archive.path_coherence_summary(_archive(spark, d).withColumnRenamed("root_similarity", "path_coherence"))
    return out.select("mean", "deviation", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")))


@query("SELECT 'a' AS project, event_id AS stamp, event_type AS event FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'b', event_id, event_type FROM events WHERE event_id % 2 = 1 ORDER BY stamp DESC, project, event LIMIT 120")
def merged_feed(spark, d):
    events = _t(spark, d, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("event"))
    return archive.merged_feed({"a": events.where("at % 2 = 0"), "b": events.where("at % 2 = 1")}).withColumnRenamed("at", "stamp")


@query(f"""WITH {_PEOPLE}, top AS (SELECT * FROM links WHERE kind IN ('supersedes', 'contradicts') ORDER BY valid_at DESC, src, dst LIMIT 40)
SELECT '# Decisions' || chr(10) || chr(10) || string_agg('- ' || strftime(epoch_ms((valid_at * 1000)::BIGINT), '%Y-%m-%d') || ' **' || kind || '** (log' || CASE WHEN invalid_at <> 0 THEN ', closed' ELSE '' END || '): ' || a.text || ' ← ' || b.text, chr(10) ORDER BY -valid_at, kind, a.text) AS text FROM top JOIN people a ON a.id = src JOIN people b ON b.id = dst""")
def decisions_markdown(spark, d):
    links, entries = _people(spark, d)
    return archive.decisions_markdown(relations.decisions(links, entries, 40))


@query(f"""WITH {_ARCHIVE}, {_SEQ}, h AS (SELECT branch, max(id) AS id FROM nodes GROUP BY branch), loose AS (SELECT id, branch FROM h WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)),
cur AS (SELECT DISTINCT dst FROM sq WHERE kind = 'supersedes' AND src > dst AND src <> dst)
SELECT 1 AS section, file, id AS place, '- [' || file || '] ' || left(text, 200) AS line FROM nodes WHERE id IN (SELECT id FROM loose WHERE branch % 3 <> 0)
UNION ALL SELECT 2, '', seq, '- «' || left(a.text, 150) || '» contradicts «' || left(b.text, 150) || '»' FROM sq JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE kind = 'contradicts'
UNION ALL SELECT 3, file, id, CASE WHEN id IN (SELECT dst FROM cur) THEN '[outdated]' ELSE left(text, 400) || CASE WHEN id % 7 > 0 THEN '  [repeated ' || id % 7 || ' times]' ELSE '' END END FROM nodes""")
def archive_text(spark, d):
    """The archive as lines; replacements by later things only, so that no chain is a cycle, and pointers without their target."""
    edges = _numbered(spark, d).where("kind <> 'supersedes' OR src > dst")
    rows = archive.full_text(_archive(spark, d).withColumn("reinforced", F.col("id") % 7), edges, _branches(spark, d), 400, with_dormant=False)
    outdated = F.startswith("line", F.lit("[outdated, see ")) & (F.col("section") == 3)
    return rows.select("section", "file", F.col("index").alias("place"), F.when(outdated, "[outdated]").otherwise(F.col("line")).alias("line"))


@query(f"""WITH {_ARCHIVE}, h AS (SELECT branch, max(id) AS id FROM nodes GROUP BY branch), l AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM h) AND id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) AND at_s >= 100 * 86400.0)
SELECT row_number() OVER (ORDER BY at_s DESC, id)::INTEGER AS place, strftime(epoch_ms((at_s * 1000)::BIGINT), '%Y-%m-%d') AS day, file, text FROM l ORDER BY at_s DESC, id LIMIT 5""")
def open_threads(spark, d):
    edges = spark.createDataFrame([], "src long, dst long, kind string")
    return archive.open_threads(_archive(spark, d), edges, 114 * 86400.0)


@query(f"""WITH {_KNN}, ranked AS (SELECT 'near' AS way, query_id AS question, rank, id FROM knn UNION ALL SELECT 'far', query_id, 21 - rank, id FROM knn WHERE rank <= 20), kinds AS (SELECT vec_id AS question, 'k' || label % 3 AS kind, label FROM embeddings WHERE vec_id % 100 = 0),
evidence AS (SELECT k.question, e.vec_id AS id FROM kinds k JOIN embeddings e ON e.label = k.label WHERE e.vec_id <> k.question), asked AS (SELECT DISTINCT question, kind FROM kinds JOIN evidence USING (question)), ways AS (SELECT unnest(['near', 'far']) AS way, unnest([1, 5]) AS k1), ks AS (SELECT unnest([1, 5, 10]) AS k),
h AS (SELECT w.way, a.kind, ks.k, a.question, EXISTS (SELECT 1 FROM ranked r JOIN evidence e ON e.question = r.question AND e.id = r.id WHERE r.way = w.way AND r.question = a.question AND r.rank <= ks.k) AS hit FROM asked a, ways w, ks)
SELECT way, coalesce(kind, 'all') AS kind, k, count(*) AS questions, round(100.0 * count_if(hit) / count(*), 1)::DOUBLE AS recall FROM h GROUP BY GROUPING SETS ((way, kind, k), (way, k))""")
def recall_at_k(spark, d):
    """Vectors of the query's label are evidence; neighbours in order and in reverse are the two ways."""
    found = cut_lineage(_knn(spark, d).select(F.col("query_id").alias("question"), "rank", "id"))
    ranked = found.select(F.lit("near").alias("way"), "question", "rank", "id").unionByName(found.select(F.lit("far").alias("way"), "question", (21 - F.col("rank")).alias("rank"), "id"))
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.where("id % 100 = 0").select(F.col("id").alias("question"), "label")
    # of a label's vectors only those that were found count, and one that shows that there is another
    close = found.join(asked, "question").join(labels, ["id", "label"]).where("id <> question").select("question", "id")
    ends = asked.join(labels.groupBy("label").agg(F.min("id").alias("least"), F.max("id").alias("most")), "label")
    other = ends.select("question", F.when(F.col("least") != F.col("question"), F.col("least")).otherwise(F.col("most")).alias("id")).where("id <> question")
    evidence = close.unionByName(other)
    return proximity.recall_at(ranked, evidence, asked.select("question", F.concat(F.lit("k"), (F.col("label") % 3).cast("string")).alias("kind")), (1, 5, 10))


@query(f"WITH {_ARCHIVE}, {_SEQ} SELECT src, dst, kind, left(a.text, 30) AS src_text, left(b.text, 30) AS dst_text FROM sq LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst WHERE kind = 'contradicts' AND (a.branch = 3 OR b.branch = 3) ORDER BY seq LIMIT 50")
def typed_edges(spark, d):
    return archive.typed_edges(_numbered(spark, d), _archive(spark, d), "contradicts", branch=3, limit=50, chars=30)


@query(f"""WITH {_ARCHIVE}, {_SEQ}, b AS (SELECT src AS a, dst AS id, src, dst, kind, seq * 2 AS s FROM sq WHERE kind IN ('contradicts', 'fixes', 'refines', 'supersedes', 'returns_to') UNION ALL SELECT dst, src, src, dst, kind, seq * 2 + 1 FROM sq WHERE kind IN ('contradicts', 'fixes', 'refines', 'supersedes', 'returns_to')),
f AS (SELECT * FROM b WHERE a = 4 AND id <> 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s) = 1) SELECT 4::BIGINT AS query, src, dst, kind, 1 AS hop, coalesce(left(text, 30), '') AS text FROM f LEFT JOIN nodes USING (id)""")
def relations_from(spark, d):
    start = spark.range(4, 5).select(F.col("id").alias("query"), "id")
    return archive.relations_from(_numbered(spark, d), _archive(spark, d), start, 1, chars=30).drop("status")


# ---------------------------------------------------------------- code cards


@query("""WITH s AS (SELECT p_partkey, p_type AS sg, p_brand AS bd FROM part WHERE p_partkey % 7 <> 0), f AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_type END AS sg, CASE WHEN p_partkey % 3 = 0 THEN 'y' ELSE p_brand END AS bd FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(s.p_partkey, f.p_partkey) AS qn, CASE WHEN s.bd IS NULL THEN 'added' WHEN f.bd IS NULL THEN 'removed' WHEN s.sg <> f.sg THEN 'supersedes' WHEN s.bd <> f.bd THEN 'continues' ELSE 'none' END AS change FROM s FULL JOIN f ON s.p_partkey = f.p_partkey""")
def card_versions(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("qn"), F.col("p_type").alias("signature"), F.col("p_brand").alias("body"))
    fresh = part.where("qn % 11 <> 0").select("qn", F.when(F.col("qn") % 5 == 0, "x").otherwise(F.col("signature")).alias("signature"), F.when(F.col("qn") % 3 == 0, "y").otherwise(F.col("body")).alias("body"))
    return code.card_versions(part.where("qn % 7 <> 0"), fresh)


@query(f"""WITH {_SYMBOLS}, cards AS (SELECT row_number() OVER (ORDER BY qn) AS id, qn, file, name FROM nodes), refs AS (SELECT id AS ref, file AS src_file, CASE id % 3 WHEN 0 THEN 'run' WHEN 1 THEN qn ELSE 'nothing' END AS name FROM cards),
m AS (SELECT ref, c.id, CASE WHEN c.file = src_file THEN 0 WHEN c.qn = r.name THEN 1 WHEN split_part(c.file, '/', 1) = split_part(src_file, '/', 1) THEN 2 ELSE 3 END AS k FROM refs r JOIN cards c ON c.name = split_part(r.name, '.', -1)), best AS (SELECT ref, id FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY k, id) = 1)
SELECT ref, src_file, refs.name, id AS target FROM refs LEFT JOIN best USING (ref)""")
def resolve_references(spark, d):
    cards = _symbols(spark, d).withColumn("id", F.row_number().over(Window.orderBy("qn")).cast("long")).withColumn("lang", F.lit("py"))
    refs = cards.select(F.col("id").alias("ref"), F.col("file").alias("src_file"), "lang", F.when(F.col("id") % 3 == 0, "run").when(F.col("id") % 3 == 1, F.col("qn")).otherwise("nothing").alias("name"))
    return code.resolve_references(refs, cards.select("id", "qn", "file", "lang"), []).select("ref", "src_file", "name", "target")


@query(f"WITH {_SYMBOLS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY first DESC, qn))::INTEGER AS place, 'mentions Function ' || qn || ' — ' || file || ':' || first || '-' || last AS line FROM (SELECT qn, any_value(file) AS file, any_value(first) AS first, any_value(last) AS last, file AS id FROM nodes GROUP BY qn, file)")
def seam_lines(spark, d):
    """Files as atoms that mention their symbols, one unknown symbol and one edge that is none."""
    nodes = _symbols(spark, d)
    seq = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("start"), "dst")).alias("seq")
    edges = nodes.select(F.col("file").alias("src"), F.col("qn").alias("dst"), F.lit("mentions").alias("kind"), "start").select("src", "dst", "kind", seq)
    extra = nodes.select(F.col("file").alias("src")).distinct().select("src", F.lit("no.such").alias("dst"), F.lit("mentions").alias("kind"), F.lit(0).alias("seq")).unionByName(nodes.select(F.col("file").alias("src")).distinct().select("src", F.lit("x").alias("dst"), F.lit("next").alias("kind"), F.lit(0).alias("seq")))
    return code.seam_lines(nodes.select(F.col("file").alias("id")), edges.unionByName(extra), nodes)


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, format('{:.2f}', round(p_retailprice, 3)) AS shown, left(p_name, 9) AS cut, '- [2024-01-01 · ' || p_brand || '] ' || left(p_name, 12) AS line FROM part")
def rendered_lines(spark, d):
    part = _t(spark, d, "part")
    line = render.recent_line(F.lit("2024-01-01"), F.col("p_brand"), F.col("p_name"), 12)
    return part.select("p_partkey", F.round("p_retailprice", 2).alias("price"), render.two_places(F.round(F.col("p_retailprice"), 3)).alias("shown"), render.cut(F.col("p_name"), 9).alias("cut"), line.alias("line"))


@query("SELECT vec_id, (list_position([30, 5, 12, 5, 9999], vec_id::INTEGER) - 1)::INTEGER AS pos, label FROM embeddings WHERE vec_id IN (30, 5, 12, 9999)")
def rows_in_list_order(spark, d):
    ids = spark.createDataFrame(list(enumerate([30, 5, 12, 5, 9999])), "pos int, id long")
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return ledger.in_list_order(rows, ids).select(F.col("id").alias("vec_id"), "pos", "label")


@query("""SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS island FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INTEGER % 14 AS e, CASE WHEN l_linenumber * 10 <= max(l_linenumber * 10 + l_quantity::INTEGER % 14) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10, l_linenumber * 10 + l_quantity::INTEGER % 14 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY l_orderkey, island""")
def merged_spans(spark, d):
    """Spans that start at a line's number times 10 and are up to 13 long, merged where they touch."""
    from sparkloom.functions.scrubbing import merge_spans

    spans = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 14).alias("end"))
    merged = merge_spans(spans, ["l_orderkey"])
    # the last line of an island is the last that starts within it
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    inside = merged.join(lines, "l_orderkey").where((F.col("l_linenumber") * 10 >= F.col("start")) & (F.col("l_linenumber") * 10 <= F.col("end")))
    return inside.groupBy("l_orderkey", "start").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")).drop("start")


@query("SELECT p_partkey, CASE WHEN p_size <= 2 THEN 1 ELSE greatest(2, ceil(3 * ln(p_size)))::INTEGER END AS budget, CASE WHEN p_size <= 2 THEN 2 ELSE greatest(2, ceil(5 * ln(p_size)))::INTEGER END AS wide_budget, CASE WHEN p_size <= 1 THEN 1 ELSE greatest(1, ceil(ln(p_size) / ln(2.6)))::INTEGER END AS depth FROM part")
def degree_budgets(spark, d):
    n = F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", T.degree_budget(n, 3.0, 1).alias("budget"), T.degree_budget(n).alias("wide_budget"), T.traversal_depth(n, F.lit(2.6)).alias("depth"))


@query("""WITH e AS (SELECT event_id, 'logs/' || user_id || '-session.jsonl' AS file, CASE event_id % 3 WHEN 0 THEN '<task-notification> x' WHEN 1 THEN '' ELSE 'plain' END AS question, CASE WHEN event_id % 5 = 0 THEN '[SYSTEM NOTIFICATION] y' ELSE 'text' END AS text, epoch_us(ts) / 1e6 AS at_s FROM events)
SELECT event_id FROM e WHERE NOT starts_with(CASE WHEN question <> '' THEN question ELSE text END, '<task-notification') AND NOT starts_with(CASE WHEN question <> '' THEN question ELSE text END, '[SYSTEM NOTIFICATION]') AND (NOT contains(file, '/11-') OR at_s < 1704500000)""")
def eligible_turns(spark, d):
    """Users as session logs; one of them is live and was compacted at a time."""
    question = F.element_at(F.array(F.lit("<task-notification> x"), F.lit(""), F.lit("plain")), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.when(F.col("event_id") % 5 == 0, "[SYSTEM NOTIFICATION] y").otherwise("text")
    file = F.concat(F.lit("logs/"), F.col("user_id").cast("string"), F.lit("-session.jsonl"))
    rows = _t(spark, d, "events").select("event_id", question.alias("q"), text.alias("t"), file.alias("f"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.where(marks.eligible(F.col("q"), F.col("t"), F.col("f"), F.col("at"), F.lit(""), F.lit("logs/11-session.jsonl"), F.lit(1704500000.0))).select("event_id")
