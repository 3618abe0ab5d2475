"""The operators over their whole tables, with the columns that are asked of each query, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, ann, chat_format, exact_topk, html_extract, importance, language_id, mixing, ngram_join, packing, token_counts, toxicity, url_filter
from sparkloom.llm.common import word_count

URL_RULES = [url_filter.parse_rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, spans = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixing.words_taken(items, spans).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.fit_languages(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def packing_input(docs: DataFrame) -> DataFrame:
    """doc_id, size in words, source and the cluster of exact copies."""
    return docs.select("doc_id", word_count(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("cluster"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing_input(_table(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit_toxicity(docs, labels.where(~held_out))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = html_extract.main_texts(pages, html_extract.fit_blocks(pages), into="text")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"))


_SPACED = r"'[^ \t\n\x0B\x0C\r]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED}), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.r) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""

OP6_SQL = """
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, t, len(t) AS n, count(*) AS snapshots FROM c GROUP BY t
), prefixes AS (
  SELECT DISTINCT t[1:k] AS p FROM (SELECT t, unnest(range(1, n)) AS k FROM one)
)
SELECT conv_id, n AS n_turns, snapshots,
  array_to_string(list_transform(t, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM one WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE p = one.t)
"""

OP7_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

OP9_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""

OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), f AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

# CRC32 by its table of 256 values, each from eight steps of the polynomial; words are hashed once each
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(LOWERED, WORDS), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all(LOWERED, WORDS), []) AS w FROM benchmark),
words AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
aims AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM aims), tab
),
raw AS (SELECT bucket, sum(n)::BIGINT AS s FROM words JOIN buckets USING (word) GROUP BY bucket),
aim AS (SELECT bucket, sum(n)::BIGINT AS t FROM aims JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw)::DOUBLE AS all_raw, (SELECT coalesce(sum(t), 0) FROM aim)::DOUBLE AS all_aim),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_raw + 10000)) / ((coalesce(raw.s, 0) + 1)::DOUBLE * (all_aim + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN raw USING (bucket) LEFT JOIN aim USING (bucket), sums
),
weights AS (SELECT r, sum(n * gain)::HUGEINT AS total, sum(n)::BIGINT AS n FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - (((total % n) + n) % n)) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN weights USING (r)
),
able AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 10 * able.n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (r)
""".replace("LOWERED", _LOWER).replace("WORDS", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")


# these pages have their main text in <article>; the labeller isn't told so
OP12_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1), '(?i)</?(?:p|h[1-6]|ul|ol|li|div|blockquote|section|table|tr|td|th|pre)(?:\s[^>]*)?>') AS parts FROM pages
), clean AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '&amp', '&'),
    '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cut
)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10)))::BIGINT AS n_chars FROM clean
"""


def queries() -> dict:
    named = (op1_token_counts, op2_mixing, op3_language_id, op4_ngram_jaccard_join, op5_best_fit_packing, op6_chat_formatting, op7_nearest_neighbours, op8_toxicity, op9_exact_top_k, op10_url_filters, op11_importance_resampling, op12_html_extraction, op13_tokenizer_alignment)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4_SQL, "op6_chat_formatting": OP6_SQL, "op7_nearest_neighbours": OP7_SQL, "op9_exact_top_k": OP9_SQL, "op10_url_filters": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_html_extraction": OP12_SQL}
