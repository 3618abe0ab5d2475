"""Full text over stored postings: BM25 for many queries at once, reading only the words' buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import words
from sparkloom.functions.vectors import runs
from sparkloom.operators.search import B, K1
from sparkloom.sources.store import Store

#: Words of all queries up to which they are looked up by value; more are joined.
FEW = 200
NO_HITS = "query_id bigint, place int, id string, score double, via string"


def postings(texts: DataFrame) -> DataFrame:
    """word, id, tf, len from (id, text): counted within the row, so nothing is shuffled."""
    tokens = texts.select("id", F.sort_array(words(F.col("text"))).alias("w"))
    counted = tokens.select("id", F.size("w").alias("len"), runs(F.col("w")).alias("r"))
    # outer, as the filter that an inner one implies would be pushed below all of this and do it twice
    return counted.select("id", "len", F.inline_outer("r").alias("word", "tf")).where("word IS NOT NULL").select("word", "id", "tf", "len")


def index_words(store: Store, name: str, texts: DataFrame, out: str | None = None) -> int:
    """Rebuild the full-text index of (id, text): the tables <name>_words, dealt by word, and <name>_size; its texts."""
    out = out or name
    size = texts.select(F.lit("all").alias("what"), F.size(words(F.col("text"))).alias("len")).groupBy("what").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    store.replace(f"{out}_words", postings(texts), ["word"])
    store.replace(f"{out}_size", size, ["what"])
    first = store.rows(f"{out}_size", empty="what string, n bigint, mean double").first()
    return first.n if first else 0


def find_words(store: Store, name: str, queries: DataFrame, k: int, via: str = "lexical") -> DataFrame:
    """query_id, place, id, score, via: each query's k best texts by BM25 over its distinct words.

    queries: query_id, text. Only the buckets of the queries' words are read, and for up to
    FEW words only the row groups that have them; a query without a word, and an index that
    isn't there, give no rows. Ties go to the smaller id.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    size = store.rows(f"{name}_size", empty="what string, n bigint, mean double").first()
    if size is None:
        return store.spark.createDataFrame([], NO_HITS)
    few = asked.limit(FEW + 1).collect()
    if len(few) <= FEW:
        by_word: dict[str, list] = {}
        for r in few:
            by_word.setdefault(r.word, []).append(F.lit(r.query_id))
        if not by_word:
            return store.spark.createDataFrame([], NO_HITS)
        askers = F.create_map(*(x for w, ids in by_word.items() for x in (F.lit(w), F.array(*ids))))
        hits = store.rows(f"{name}_words", values=list(by_word)).withColumn("query_id", F.explode(askers[F.col("word")]))
    else:
        hits = store.rows(f"{name}_words", keys=asked.select("word")).join(asked, "word")
    df = hits.groupBy("word").agg(F.count_distinct("id").alias("df"))
    idf = F.ln(1 + (size.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(size.mean or 1.0)))
    scored = hits.join(df, "word").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "id", "score", F.lit(via).alias("via"))
