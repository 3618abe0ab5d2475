"""Ranking: full text by BM25, vectors by cosine, reciprocal rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import words
from sparkloom.functions.vectors import runs
from sparkloom.operators import tiles
from sparkloom.operators.lineage import cut_lineage

K1, B = 1.2, 0.75
#: Pairs of blocks at least, so that small tables spread over the executors too: many blocks of candidates for few queries, else blocks of queries.
LEAST_BLOCKS, LEAST_ASKED = 48, 12


def bm25(texts: DataFrame, query: list[str], k: int) -> DataFrame:
    """id, score of the k best texts for the query's distinct words.

    Only the query's words are counted: their tf comes from one pass over each text, so
    nothing is shuffled but the words that match.
    """
    asked = sorted({w.lower() for w in query})
    tokens = texts.select("id", words(F.col("text")).alias("w"))
    matched = F.filter("w", lambda x: x.isin(asked))
    counted = F.transform(F.array_distinct("m"), lambda x: F.struct(x.alias("word"), F.size(F.filter("m", lambda y: y == x)).alias("tf")))
    hits = cut_lineage(tokens.select("id", F.size("w").alias("len"), matched.alias("m")).select("id", "len", counted.alias("m")))
    n, mean = hits.select(F.count("*"), F.avg("len")).first()
    tf = hits.select("id", "len", F.inline("m"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    scored = tf.join(F.broadcast(df), "word").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))  # at most one row per query word
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _place(word: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dim


def _hash_counts(texts: DataFrame, dim: int) -> DataFrame:
    """id, r (array of place and count), length of each text's hashed words: counted within the row, nothing is shuffled."""
    places = texts.select("id", F.sort_array(F.transform(words(F.col("text")), lambda w: _place(w, dim))).alias("p"))
    counts = places.select("id", runs(F.col("p")).alias("r"))
    return counts.select("id", "r", F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x["n"] * x["n"])).alias("length"))


def hash_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """id, place, value: sparse unit vectors of hashed word counts."""
    unit = F.transform("r", lambda x: F.struct(x["value"].alias("place"), (x["n"] / F.col("length")).alias("value")))
    # outer, as the filter that an inner one implies would be pushed below all of this and do it twice
    return _hash_counts(texts, dim).select("id", F.inline_outer(unit)).where("place IS NOT NULL")


def with_hashes(texts: DataFrame, dim: int = 256, into: str = "v") -> DataFrame:
    """texts plus the same unit vectors as arrays of dim numbers; a text without words, or null, has zeros.

    Spark finds the words; of each batch of rows, each distinct word is hashed once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = t.column("_words")
            coded = found.flatten().dictionary_encode()
            place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(t)), pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False))
            counts = np.bincount(row * dim + place[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(t) * dim).astype(float).reshape(-1, dim)
            length = np.sqrt((counts * counts).sum(axis=1))[:, None]
            unit = np.divide(counts, length, out=counts, where=length > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * dim, pa.int32()), pa.array(unit.ravel()))
            kept = [n for n in t.schema.names if n != "_words"]
            yield pa.RecordBatch.from_arrays([*(t.column(n) for n in kept), vectors], names=[*kept, into])

    schema = texts.withColumn(into, F.lit(None).cast("array<double>")).schema
    return texts.withColumn("_words", words(F.col("text"))).mapInArrow(count, schema)


def hashed_top(texts: DataFrame, query: dict[int, float], k: int, dim: int = 256) -> DataFrame:
    """id, score: the k best cosines of hashed word counts with a sparse unit query, of texts that share a place with it.

    The products are taken within the row, so only a score leaves it.
    """
    weight = F.create_map(*[F.lit(x) for pair in sorted(query.items()) for x in pair])
    hit = F.filter("r", lambda x: x["value"].isin(*query))
    product = F.aggregate(hit, F.lit(0.0), lambda s, x: s + x["n"] / F.col("length") * F.element_at(weight, x["value"].cast("int")))
    scored = _hash_counts(texts, dim).select("id", F.when(F.size(hit) > 0, F.round(product, 6)).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), "id").limit(k).where("score IS NOT NULL")


def _whole(vectors: DataFrame, name: str) -> DataFrame:
    """name, v (floats as they are, others as doubles) and width of the vectors that can have a score."""
    v = F.col("v") if vectors.schema["v"].dataType.simpleString() == "array<float>" else F.col("v").cast("array<double>")
    return vectors.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).select(name, v.alias("v"), F.size("v").alias("width"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096, own: bool = True) -> DataFrame:
    """query_id, rank, id, score: the k largest cosines of each query.

    Queries (query_id, v) go to each block of candidates and candidates (id, v) to each block
    of queries, both of bounded size; a pair of blocks is a product of matrices that leaves k
    rows a query, so no row is made for a pair and no side is held whole. Few queries are sent
    to many blocks; where they are as many as the candidates, blocks are as large as a task may
    hold, so that copies and rows a query stay few. Vectors that are
    null, zero or hold a null have no score, nor have two of unequal length; a score that is
    no number comes first. With own the query is a candidate's id and itself excluded.
    """
    c, q = _whole(vectors, "id"), _whole(queries, "query_id")
    if own:
        c, q = c.where("id IS NOT NULL"), q.where("query_id IS NOT NULL")
    n, width = c.select(F.count("*"), F.max("width")).first()
    asked = q.count()
    q_blocks, c_blocks = max(1, -(-asked // block_rows)), max(1, -(-n // max(1024, tiles.CELLS // (width or 1))))
    if asked * (k + 1) < n:  # what another block of candidates costs in rows, and one of queries
        c_blocks = max(LEAST_BLOCKS, c_blocks)
    else:
        q_blocks = max(-(-LEAST_ASKED // c_blocks), q_blocks)
    block = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    itself = F.col("query_id").try_cast(c.schema["id"].dataType) if own else F.lit(None)
    c = c.select(block("id", c_blocks).alias("cb"), every(q_blocks).alias("qb"), "width", "id", "v")
    q = q.select(every(c_blocks).alias("cb"), block("query_id", q_blocks).alias("qb"), "width", "query_id", itself.alias("itself"), "v")

    def tile(asked: pa.Table, found: pa.Table) -> pa.Table:
        found = found.take(pc.array_sort_indices(found["id"].combine_chunks(), null_placement="at_start"))
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1 if len(t) else 1)
        spans: dict = {}
        for i, x in enumerate(found["id"].to_pylist()) if own else ():
            spans[x] = (spans.get(x, (i,))[0], i + 1)
        both = len(asked) and len(found)
        at, to, scores = tiles.best(matrix(asked), matrix(found), [spans.get(x, (0, 0)) for x in asked["itself"].to_pylist()], k) if both else ([], [], [])
        take = lambda column, rows: column.take(pa.array(rows, pa.int64()))
        return pa.table({"query_id": take(asked["query_id"], at), "id": take(found["id"], to), "score": pa.array(scores, pa.float64())})

    types = {name: frame.schema[name].dataType.simpleString() for frame, name in ((q, "query_id"), (c, "id"))}
    scored = q.groupBy("cb", "qb", "width").cogroup(c.groupBy("cb", "qb", "width")).applyInArrow(tile, f"query_id {types['query_id']}, id {types['id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def fuse(rankings: list[tuple[str, DataFrame]], k: int = 60, limit: int = 60) -> DataFrame:
    """id, score, via: reciprocal rank fusion of lists (id, score), best first.

    A list's place is its rank from 1; the score is round(sum of 1 / (k + place), 6); ties
    go to the smaller id; via names the first list that has the id.
    """
    lists = None
    for i, (via, hits) in enumerate(rankings):
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # lists are top-k already
        one = hits.select("id", place.alias("place"), F.lit(i).alias("list_no"), F.lit(via).alias("via"))
        lists = one if lists is None else lists.unionByName(one)
    fused = lists.groupBy("id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("place"))), 6).alias("score"), F.min_by("via", "list_no").alias("via"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)
