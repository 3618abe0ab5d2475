"""The engine's queries over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.operators import context, graph, relations, search, segmentation, selection, spaces, sync
from sparkloom.operators.ordering import places_by_steps

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.paragraphs(_texts(spark, d), "\n")


# ---------------------------------------------------------------- ranking

ASKED = ["idiot", "anon", "pathetic", "the", "erste", "queque"]
_WORDS = r"words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)"
_ASKED = "(" + ", ".join(f"'{w}'" for w in ASKED) + ")"
_BM25 = f"""{_WORDS}, st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, len, word, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS word FROM words) WHERE word IN {_ASKED} GROUP BY ALL),
dfs AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN dfs USING (word), st GROUP BY id)"""
_HASH = """hc AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 256) AS place, count(*)::DOUBLE AS c FROM (SELECT id, unnest(w) AS word FROM words) GROUP BY ALL),
hv AS (SELECT id, place, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS value FROM hc)"""


def _query_vector(dim: int = 256) -> dict[int, float]:
    import hashlib

    counts: dict[int, float] = {}
    for w in ASKED:
        p = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
        counts[p] = counts.get(p, 0.0) + 1
    length = sum(c * c for c in counts.values()) ** 0.5
    return {p: c / length for p, c in counts.items()}


_QV = "qv AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {v!r}::DOUBLE)" for p, v in sorted(_query_vector().items())) + ") AS t(place, weight))"
_COS = "cs AS (SELECT id, round(sum(value * weight), 6) AS score FROM hv JOIN qv USING (place) GROUP BY id)"


@query(f"WITH {_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark, d):
    return search.bm25(_texts(spark, d), ASKED, 50)


@query(f"WITH {_WORDS}, {_HASH} SELECT id, place, round(value, 6) AS value FROM hv")
def hash_embed_md5(spark, d):
    return search.hash_vectors(_texts(spark, d)).select("id", "place", F.round("value", 6).alias("value"))


@query(f"""WITH {_BM25}, {_HASH}, {_QV}, {_COS},
l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, 0 AS no, 'lexical' AS via FROM bm),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, 1 AS no, 'hash' AS via FROM cs),
u AS (SELECT * FROM l WHERE place <= 60 UNION ALL SELECT * FROM v WHERE place <= 60)
SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score, arg_min(via, no) AS via FROM u GROUP BY id ORDER BY score DESC, id LIMIT 60""")
def rrf_fuse(spark, d):
    texts = _texts(spark, d)
    lexical = search.bm25(texts, ASKED, 60)
    near = search.hashed_top(texts, _query_vector(), 60)
    return search.fuse([("lexical", lexical), ("hash", near)])


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_SIM = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_KNN = f"""{_VEC}, s AS (SELECT a.id AS query_id, b.id, round({_SIM}, 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
knn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM s QUALIFY rank <= 20)"""
#: The same of every vector, for figures about the whole space.
_KNN_ALL = _KNN.replace(" WHERE a.id % 100 = 0", "")


def _knn(spark, d, k=20):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.nearest(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), k)


def _knn_all(spark, d, k=20):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.nearest(v, v.withColumnRenamed("id", "query_id"), k)


#: An adapter from 64 numbers to 8, by rule.
ADAPTER = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(8)] for i in range(64)]


@query(f"""WITH {_VEC}, y AS (SELECT id, list_transform(range(0, 8), lambda j: list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (((i * 7 + j * 3) % 11 - 5) / 10)))) AS y FROM v WHERE len(v) = 64),
p AS (SELECT id, unnest(y) AS x, unnest(range(1, 9)) AS i, sqrt(list_dot_product(y, y)) AS length FROM y)
SELECT id, i::INTEGER AS i, round(x / length, 6) + 0.0 AS x FROM p""")
def adapt_vectors(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return spaces.carry(v, ADAPTER).select("id", F.posexplode("carried").alias("i", "x")).select("id", (F.col("i") + 1).alias("i"), "x")


@query(f"""WITH {_KNN_ALL}, h AS (SELECT id, v[1:32] AS v FROM v), hs AS (SELECT a.id AS query_id, b.id, round({_SIM}, 6) AS score FROM h a JOIN h b ON a.id <> b.id),
hk AS (SELECT query_id, id FROM hs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)
SELECT query_id, count(hk.id) AS shared, round(count(hk.id) / 10, 6) AS overlap FROM knn LEFT JOIN hk USING (query_id, id) WHERE rank <= 10 GROUP BY query_id""")
def space_overlap(spark, d):
    """The space of all 64 numbers against that of the first 32, by the 10 neighbours of every vector."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("v"))
    half = search.nearest(v, v.withColumnRenamed("id", "query_id"), 10)
    return spaces.neighbour_overlap(_knn_all(spark, d, 10), half, 10)


@query("""WITH ready AS (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0),
usable AS (SELECT t.n_name AS space, s.n_name AS source, s_suppkey FROM supplier JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation t ON t.n_nationkey = s_suppkey % 19 WHERE s.n_name IN (FROM ready)),
first AS (SELECT space, source FROM usable QUALIFY row_number() OVER (PARTITION BY space ORDER BY s_suppkey, source) = 1)
SELECT n_nationkey AS position, n_name AS space, CASE WHEN n_name IN (FROM ready) THEN 'direct' ELSE 'adapter' END AS how,
CASE WHEN n_name IN (FROM ready) THEN n_name ELSE first.source END AS source
FROM nation LEFT JOIN first ON first.space = n_name WHERE n_name IN (FROM ready) OR first.source IS NOT NULL""")
def space_routes(spark, d):
    """Nations stand for spaces, every third one ready; suppliers for adapters."""
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("space"))
    source, target = nation.select(F.col("position").alias("s_nationkey"), F.col("space").alias("source")), nation.select(F.col("position").alias("t"), F.col("space").alias("target"))
    adapters = _t(spark, d, "supplier").withColumn("t", F.col("s_suppkey") % 19).join(source, "s_nationkey").join(target, "t").select(F.col("s_suppkey").alias("position"), "source", "target")
    return spaces.plan_routes(nation, nation.where("position % 3 = 0"), adapters)


@query(f"WITH {_KNN} SELECT * FROM knn")
def knn_cosine(spark, d):
    return _knn(spark, d)


@query(f"WITH {_KNN} SELECT query_id, rank, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS b FROM knn) WHERE score >= greatest(0.1, b - 0.12)")
def in_window(spark, d):
    return selection.in_window(_knn(spark, d), "query_id", "score", 0.1, 0.12)


@query(f"""WITH {_KNN}, w AS (SELECT query_id, id, rank FROM knn WHERE id % 2 = 0),
ww AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS place FROM w),
j AS (SELECT k.*, max(score) OVER (PARTITION BY k.query_id) AS b, ww.id IS NOT NULL AS lex FROM knn k LEFT JOIN ww ON ww.query_id = k.query_id AND ww.id = k.id AND ww.place <= 3)
SELECT query_id, rank, id, score FROM j WHERE b >= 0.3 AND (score >= greatest(0.3, b - 0.12) OR lex)""")
def admit(spark, d):
    """Even ids, farthest first, stand in for the lexical list."""
    knn = _knn(spark, d)
    lexical = knn.where("id % 2 = 0").select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))).alias("place"))
    return selection.admit(knn, lexical, 0.3, 0.12, 3).select("query_id", "rank", "id", "score")


@query(f"""WITH {_VEC}, k AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY label, i)
SELECT label, i::INTEGER AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM k""")
def centroid_by_label(spark, d):
    return _centroids(spark, d).select("label", "i", F.round("x", 6).alias("x"))


def _centroids(spark, d):
    mean = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", (F.col("i") + 1).alias("i")).agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.withColumn("x", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))).drop("m")


@query(f"""WITH {_VEC}, k AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY label, i),
c AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM k)
SELECT a.label AS u, b.label AS v, round(sum(a.x * b.x), 4) AS similarity FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 4) >= 0.02""")
def label_graph(spark, d):
    c = _centroids(spark, d)
    pairs = c.alias("a").join(c.alias("b"), "i").where("a.label < b.label")
    return pairs.groupBy(F.col("a.label").alias("u"), F.col("b.label").alias("v")).agg(F.round(F.sum(F.col("a.x") * F.col("b.x")), 4).alias("similarity")).where("similarity >= 0.02")


@query(f"""WITH {_KNN_ALL}, e AS (SELECT x.label, list_sort(list(score)) AS s FROM knn JOIN embeddings x ON x.vec_id = knn.query_id GROUP BY x.label)
SELECT label, len(s) AS n, s[1] AS least, s[len(s) // 10 + 1] AS p10, s[len(s) // 2 + 1] AS median, s[len(s)] AS most FROM e""")
def similarity_percentiles(spark, d):
    """Scores of the 20 neighbours of every vector, by its label."""
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    ranked = _knn_all(spark, d).join(labels, "query_id")
    return places_by_steps(ranked, "label", "score", {"least": "0L", "p10": "n div 10", "median": "n div 2", "most": "n - 1"}, F.round("score", 3))


@query("""SELECT vec_id, round(list_dot_product(v, v), 4) AS squared, list_contains(list_transform(v, lambda x: isfinite(x)), false) AS broken
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def vector_health(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), (~V.finite(F.col("embedding"))).alias("broken"))


# ---------------------------------------------------------------- text

_SQUASH = r"trim(regexp_replace(text, '[\s\x0B\x{85}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_SQUASH}) AS digest, length({_SQUASH}) AS n FROM documents")
def squash_digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"), F.length(T.squash(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH h AS (SELECT doc_id, md5({_SQUASH}) AS digest, source FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS n FROM h)
SELECT doc_id, digest, source FROM f WHERE n = 1 ORDER BY doc_id LIMIT 200""")
def shortlist(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"), "source")
    return selection.shortlist(docs, "digest", [F.col("doc_id")], 200)


_LINE_SQL = r"""ln AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
lines AS (SELECT id, unnest(range(0, len(p))) AS position, unnest(p) AS text FROM ln)"""


@query(f"WITH {_LINE_SQL} SELECT id, position::INTEGER AS position, md5(text) AS digest, length(text) AS n FROM lines")
def paragraphs(spark, d):
    return _lines(spark, d).select("id", "position", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"""WITH {_LINE_SQL}, t AS (SELECT *, CASE WHEN length(text) >= 40 OR coalesce(lag(length(text) >= 40) OVER (PARTITION BY id ORDER BY position), true) THEN 1 ELSE 0 END AS s FROM lines),
r AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY position) AS run FROM t)
SELECT id, (run - 1)::BIGINT AS position, md5(string_agg(text, chr(10) ORDER BY position)) AS digest FROM r GROUP BY id, run""")
def merge_short_blocks(spark, d):
    return segmentation.merge_short(_lines(spark, d), 40, "\n").select("id", "position", F.md5("text").alias("digest"))


@query("""WITH k AS (SELECT *, row_number() OVER w AS i FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT *, CASE WHEN role = 'user' AND lag(role) OVER w = 'assistant' AND count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM o)
SELECT conv_id, pair::BIGINT AS pair, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user'), '')) AS question, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant'), '')) AS answer FROM p GROUP BY conv_id, pair""")
def question_answers(spark, d):
    return segmentation.question_answers(_t(spark, d, "conversations")).select("conv_id", "pair", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("SELECT conv_id || ':' || turn AS src, conv_id || ':' || nxt AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def chain_next(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("node"))
    return segmentation.chain(turns, "conv_id", "turn", "node")


@query("""SELECT conv_id || ':' || turn AS node, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ',') AS before,
array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), ',') AS after FROM conversations""")
def lineage(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("node"))
    sides = segmentation.lineage(turns, "conv_id", "turn", "node")
    numbers = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.substring_index(x, ":", -1)), ","))
    return sides.select("node", numbers("before").alias("before"), numbers("after").alias("after"))


@query("""WITH u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
SELECT conv_id, turn, used::BIGINT AS used FROM u WHERE used <= 1500""")
def pack_prefix_stop(spark, d):
    return context.pack_prefix(_t(spark, d, "conversations"), "conv_id", ["turn"], "text", 1500).select("conv_id", "turn", "used")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS items, []::VARCHAR[] AS roles FROM r
UNION ALL SELECT f.conv_id, r.i, CASE WHEN ok THEN f.used + r.n ELSE f.used END, CASE WHEN ok THEN list_append(items, turn) ELSE items END, CASE WHEN ok THEN list_append(roles, role) ELSE roles END
FROM f JOIN (SELECT * FROM r) r ON r.conv_id = f.conv_id AND r.i = f.i + 1, LATERAL (SELECT f.used + r.n <= 1200 AND len(f.items) < 4 AND len(list_filter(f.roles, lambda x: x = r.role)) < 2 AS ok) k)
SELECT conv_id, used, array_to_string(items, ',') AS items FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def take_within_budget(spark, d):
    turns = _t(spark, d, "conversations").withColumn("n", F.length("text"))
    return context.take_within(turns, "conv_id", ["turn"], "role", "n", 1200, 2, 4).select("conv_id", "used", F.array_join("items", ",").alias("items"))


_SECRET = r"""\b(uak_[A-Za-z0-9_-]{16,}|ak_[A-Za-z0-9_-]{20,}|ck_[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b"""
_PLANTED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' ghp_' || md5(text) || ' end' WHEN 1 THEN text || ' sk-a_' || md5(text) WHEN 2 THEN text || ' sk-short' WHEN 3 THEN text || ' AKIA' || upper(substr(md5(text), 1, 16)) || '.' ELSE text END AS text FROM documents"""


@query(f"""WITH p AS ({_PLANTED}), f AS (SELECT *, regexp_extract_all(text, '{_SECRET}') AS s FROM p)
SELECT doc_id, md5(regexp_replace(text, '{_SECRET}', '<secret>', 'g')) AS clean, len(s)::INTEGER AS found, CASE WHEN len(s) > 0 THEN CASE WHEN instr(s[1][1:8], '_') > 0 THEN split_part(s[1], '_', 1) ELSE s[1][1:4] END END AS head FROM f""")
def scrub_secrets(spark, d):
    """Documents with planted tokens of some formats, and one that is too short."""
    text, h = F.col("text"), F.md5("text")
    planted = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit(" ghp_"), h, F.lit(" end"))).when(F.col("doc_id") % 5 == 1, F.concat(text, F.lit(" sk-a_"), h)).when(F.col("doc_id") % 5 == 2, F.concat(text, F.lit(" sk-short"))).when(F.col("doc_id") % 5 == 3, F.concat(text, F.lit(" AKIA"), F.upper(F.left(h, F.lit(16))), F.lit("."))).otherwise(text)
    done = _t(spark, d, "documents").select("doc_id", T.scrubbed(planted).alias("s"))
    head = F.regexp_extract("s.text", "<secret-removed:([^>]*)>", 1)
    return done.select("doc_id", F.md5(F.regexp_replace("s.text", "<secret-removed:[^>]*>", "<secret>")).alias("clean"), F.col("s.found").alias("found"), F.when(F.col("s.found") > 0, head).alias("head"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(text[1:80], ' ') || ' …' END AS clipped, left(sha256(text), 16) AS hash FROM documents")
def clip_and_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("clipped"), T.short_hash(F.col("text")).alias("hash"))


_PATH = r"regexp_extract(url, '://([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM pages)
SELECT DISTINCT array_to_string(s[1:i], '/') AS src, array_to_string(s[1:i+1], '/') AS dst FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)""")
def path_tree(spark, d):
    chain = T.path_chain(F.regexp_extract("url", r"://([^?#]*)", 1))
    rows = _t(spark, d, "pages").select(chain.alias("c")).select(F.posexplode(F.slice("c", 1, F.size("c") - 1)).alias("i", "src"), "c")
    return rows.select("src", F.element_at("c", F.col("i") + 2).alias("dst")).distinct()


# ---------------------------------------------------------------- sync


@query("""WITH e AS (SELECT source AS file, md5(text) AS digest, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY file, digest ORDER BY position, id) AS o FROM e WHERE id % 5 <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY file, digest ORDER BY position, id) AS o FROM e WHERE id % 7 <> 0),
p AS (SELECT coalesce(s.file, f.file) AS file, coalesce(s.digest, f.digest) AS digest, s.id AS stored_id, f.id AS fresh_id, s.position AS sp, f.position AS fp FROM s FULL JOIN f ON s.file = f.file AND s.digest = f.digest AND s.o = f.o),
r AS (SELECT *, row_number() OVER (PARTITION BY file, sp ORDER BY stored_id) AS o FROM p WHERE fresh_id IS NULL), a AS (SELECT *, row_number() OVER (PARTITION BY file, fp ORDER BY fresh_id) AS o FROM p WHERE stored_id IS NULL)
SELECT CASE WHEN fresh_id IS NULL THEN 'retract' WHEN stored_id IS NULL THEN 'add' ELSE 'keep' END AS action, file, digest, coalesce(stored_id, -1) AS stored_id, coalesce(fresh_id, -1) AS fresh_id FROM p
UNION ALL SELECT 'revise', r.file, a.digest, r.stored_id, a.fresh_id FROM r JOIN a ON r.file = a.file AND r.sp = a.fp AND r.o = a.o""")
def plan_sync(spark, d):
    """Two versions of each source: all rows but those with id % 5 = 0, and all but those with id % 7 = 0."""
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("source").alias("file"), F.md5("text").alias("digest"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("position"))
    plan = sync.plan_sync(rows.where("id % 5 <> 0"), rows.where("id % 7 <> 0"))
    return plan.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("stored_id", "fresh_id")})


@query("""WITH o AS (SELECT url AS path, length(html) AS size, page_id % 11 AS mtime, md5(html) AS hash FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
n AS (SELECT url AS path, length(html) AS size, page_id % 13 AS mtime, md5(html) AS hash FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT path, change FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN NOT (o.size = n.size AND o.mtime = n.mtime) AND o.hash <> n.hash THEN 'changed' WHEN NOT (o.size = n.size AND o.mtime = n.mtime) THEN 'touched' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""")
def manifest_diff(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("size"), F.md5("html").alias("hash"))
    old = selection.first_per(pages, ["path"], [F.col("page_id")]).withColumn("mtime", F.col("page_id") % 11)
    new = selection.first_per(pages, ["path"], [F.desc("page_id")]).withColumn("mtime", F.col("page_id") % 13)
    return sync.manifest_diff(old, new)


# ---------------------------------------------------------------- relations

_CLAIMS = """c AS (SELECT user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst, CASE event_type WHEN 'view' THEN 'continues' WHEN 'click' THEN 'refines' WHEN 'signup' THEN 'reinforces' WHEN 'error' THEN 'contradicts' ELSE 'supersedes' END AS kind, epoch_us(ts) / 1e6 AS claimed, event_id AS seq FROM events),
l AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY src, dst ORDER BY claimed, seq) AS before FROM c WHERE src <> dst) WHERE before IS NULL OR before <> kind),
links AS (SELECT src, dst, kind, claimed AS valid_at, coalesce(lead(claimed) OVER (PARTITION BY src, dst ORDER BY claimed, seq), 0.0) AS invalid_at FROM l)"""
_HEADS = "heads AS (SELECT dst, src FROM links WHERE kind = 'supersedes' AND invalid_at = 0 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY valid_at DESC, src) = 1)"


def _links(spark, d):
    kind = F.when(F.col("event_type") == "view", "continues").when(F.col("event_type") == "click", "refines").when(F.col("event_type") == "signup", "reinforces").when(F.col("event_type") == "error", "contradicts").otherwise("supersedes")
    claims = _t(spark, d, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"))
    return relations.record_relations(claims)


@query(f"WITH {_CLAIMS} SELECT * FROM links")
def relation_versions(spark, d):
    return _links(spark, d)


@query(f"WITH {_CLAIMS}, {_HEADS} SELECT * FROM heads")
def replacement_heads(spark, d):
    return relations.heads(_links(spark, d))


@query(f"""WITH RECURSIVE {_CLAIMS}, {_HEADS}, walk AS (SELECT dst AS id, src AS at_id, [dst] AS path FROM heads
UNION ALL SELECT w.id, h.src, list_append(w.path, w.at_id) FROM walk w JOIN heads h ON h.dst = w.at_id WHERE NOT list_contains(w.path, w.at_id))
SELECT h.dst AS id, e.at_id AS current FROM heads h LEFT JOIN (SELECT id, at_id FROM walk WHERE at_id NOT IN (SELECT dst FROM heads)) e ON e.id = h.dst""")
def current_version(spark, d):
    return relations.current_versions(_links(spark, d))


@query(f"""WITH {_CLAIMS}, {_HEADS}, n AS (SELECT DISTINCT src AS id FROM links UNION SELECT dst FROM links), e AS (SELECT id, id % 10 = 0 AS retracted FROM n)
SELECT CASE WHEN retracted THEN 'retracted' WHEN id IN (SELECT dst FROM heads) THEN 'superseded' ELSE 'active' END AS state, count(*) AS n FROM e GROUP BY 1""")
def status_histogram(spark, d):
    links = _links(spark, d)
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    entries = ids.withColumn("status", F.when(F.col("id") % 10 == 0, "retracted").otherwise("active"))
    return relations.statuses(entries, links).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIMS} SELECT src, dst, kind, valid_at FROM links WHERE kind IN ('supersedes', 'contradicts') AND invalid_at = 0 ORDER BY valid_at DESC, src, dst LIMIT 100")
def decision_feed(spark, d):
    return relations.decision_feed(_links(spark, d), 100).select("src", "dst", "kind", "valid_at")


@query("""SELECT user_id, event_type, min(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def last_duplicate_wins(spark, d):
    keyed = _t(spark, d, "events").select(F.struct("user_id", "event_type").alias("k"), F.col("event_id").alias("seq"), "value")
    return selection.last_wins(keyed, "k", "seq").select("k.user_id", "k.event_type", "seq", "value")


@query("SELECT user_id, event_type, ts, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 DAY")
def debounce(spark, d):
    from sparkloom.streaming.debounce import settled

    return settled(_t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "INTERVAL 1 DAY")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, d):
    return _t(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query("SELECT event_id, round(pow(0.5::DOUBLE, abs(epoch_us(ts) / 1e6 - 1700000000) / 86400 / 30), 6) AS affinity, strftime(ts, '%Y-%m-%d') AS day FROM events")
def temporal_affinity(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(spark, d, "events").select("event_id", F.round(T.temporal_affinity(at, F.lit(1.7e9), 30), 6).alias("affinity"), T.day(at).alias("day"))


# ---------------------------------------------------------------- graphs

#: Parts (even numbers) and the suppliers (odd) of their line items; customers (even) and their orders (odd).
_EDGES = """edges AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem), ends AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst)"""
_PURCHASES = "edges AS (SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst FROM orders)"


def _edges(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


def _purchases(spark, d):
    return _t(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ends UNION ALL SELECT v FROM ends) GROUP BY node")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"""WITH {_EDGES}, dg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ends UNION ALL SELECT v FROM ends) GROUP BY node),
nodes AS (SELECT p_partkey * 2 AS id FROM part UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
a AS (SELECT coalesce(degree, 0) AS degree FROM nodes LEFT JOIN dg ON node = id), p AS (SELECT list_sort(list(degree)) AS s FROM a WHERE degree > 0)
SELECT count(*) AS n, (sum(degree) // 2)::BIGINT AS m, round(sum(degree) / count(*), 6) AS c, count_if(degree = 0)::BIGINT AS isolated, max(degree) AS max_degree, (SELECT s[len(s) // 2 + 1] FROM p) AS median_degree FROM a""")
def graph_summary(spark, d):
    return graph.summary(_nodes(spark, d), _edges(spark, d))


def _nodes(spark, d):
    return _t(spark, d, "part").select((F.col("p_partkey") * 2).alias("node")).unionByName(_t(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node")))


@query(f"""WITH RECURSIVE {_PURCHASES}, bi AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT DISTINCT a AS node, a AS root FROM bi UNION SELECT r.node, b.b FROM r JOIN bi b ON b.a = r.root) SELECT node, min(root) AS root FROM r GROUP BY node""")
def graph_components(spark, d):
    return graph.components(_purchases(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, bi AS (SELECT u AS a, v AS b FROM ends UNION ALL SELECT v, u FROM ends),
r AS (SELECT 3::BIGINT AS node, 0 AS hop UNION SELECT e.b, r.hop + 1 FROM r JOIN bi e ON e.a = r.node WHERE r.hop < 2)
SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def impact_hops(spark, d):
    """From the first supplier to its parts and their other suppliers."""
    e = _edges(spark, d)
    return graph.reach(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), spark.range(3, 4).select(F.col("id").alias("node")), 2)


def _rank_rounds(rounds: int) -> str:
    """The rounds as a chain of tables."""
    steps = ["r0 AS (SELECT node, d, p, 1.0::DOUBLE / (SELECT count(*) FROM ns) AS rank FROM ns)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT r.node, r.d, r.p, 0.85::DOUBLE * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE d = 0) * r.p) + (1 - 0.85::DOUBLE) * r.p AS rank FROM r{i - 1} r LEFT JOIN (SELECT bi.b AS node, sum(q.rank / q.d) AS flow FROM bi JOIN r{i - 1} q ON q.node = bi.a GROUP BY bi.b) f ON f.node = r.node)")
    return ", ".join(steps)


RANK_ROUNDS = 8


@query(f"""WITH {_EDGES}, bi AS (SELECT u AS a, v AS b FROM ends UNION ALL SELECT v, u FROM ends), dg AS (SELECT a AS node, count(*) AS d FROM bi GROUP BY a),
seeds AS (SELECT * FROM (VALUES (3::BIGINT, 1.0::DOUBLE), (4, 0.5), (-1, 0.5)) AS t(node, w)),
ns AS (SELECT coalesce(dg.node, seeds.node) AS node, coalesce(d, 0) AS d, coalesce(w, 0) / (SELECT sum(w) FROM seeds) AS p FROM dg FULL JOIN seeds ON seeds.node = dg.node), {_rank_rounds(RANK_ROUNDS)}
SELECT node, round(rank, 7) AS rank FROM r{RANK_ROUNDS}""")
def personalised_pagerank(spark, d):
    """A fixed number of rounds from a supplier, a part and a node without links."""
    seeds = spark.createDataFrame([(3, 1.0), (4, 0.5), (-1, 0.5)], "node long, weight double")
    return graph.pagerank(_edges(spark, d), seeds, rounds=RANK_ROUNDS, tolerance=0.0).select("node", F.round("rank", 7).alias("rank"))


# ---------------------------------------------------------------- plain analytics


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    line = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, r_name, count(DISTINCT o_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark, d):
    line, orders, customer, nation, region = (_t(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region"))
    per_order = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT source, lang, count(*) AS atoms, sum(n_chars)::BIGINT AS chars, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY ALL")
def corpus_stats(spark, d):
    return _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("atoms"), F.sum("n_chars").alias("chars"), F.count_distinct(F.md5("text")).alias("texts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sparkloom.plans import memory, sources  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from sparkloom.plans import memory, sources  # noqa: F401

    return dict(_SQL)
