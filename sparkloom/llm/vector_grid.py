"""Query blocks against candidate blocks: one cogrouped task per pair of bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage

#: Rows of one block; with both, what one task holds at a time.
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
#: At least so many candidate blocks, so that small inputs still spread over executors.
LEAST_BLOCKS = 48

#: local(q, c, own): object arrays of vectors, and for each query the position among the
#: candidates that it must leave out (-1: none); returns positions of queries, positions of
#: candidates and scores, at least each query's k best, ties to the earlier candidate.
Local = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def grid(vectors: DataFrame, every: int, local: Local, score_type: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query over the whole grid of blocks.

    vectors has vec_id and v. Its rows are candidates, those of an id divisible by `every`
    queries, and only a query's own row is no candidate of it: rows that repeat an id are
    rows of their own, and equal ones travel once with their number. Blocks are hash buckets
    of bounded size, so their numbers grow with the tables and no task's memory does: a
    candidate is sent to each query block, a query to each candidate block.
    """
    rows = cut_lineage(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64("v")))
    is_query = F.col("vec_id") % every == 0
    n, m = rows.select(F.count("*"), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(LEAST_BLOCKS, 2 * -(-n // CANDIDATE_ROWS)), max(1, -(-m // QUERY_ROWS))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "key"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fields = ["vec_id", "key", "copies", "v"]
    cand = rows.select(block(c_blocks).alias("cb"), every_block(q_blocks).alias("qb"), *fields)
    quer = rows.where(is_query).select(every_block(c_blocks).alias("cb"), block(q_blocks).alias("qb"), *fields)

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        at, to, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if score_type == "long" else np.float64)
        c = c.sort_values(["vec_id", "key"], kind="stable")
        place = {pair: i for i, pair in enumerate(zip(c["vec_id"], c["key"], strict=True))}
        own = np.array([place.get(pair, -1) for pair in zip(q["vec_id"], q["key"], strict=True)], np.int64)
        copies = c["copies"].to_numpy(np.int64)
        if len(q) and len(c):
            alone = np.where((own >= 0) & (copies[own] == 1), own, -1)
            at, to, scores = local(q["v"].to_numpy(), c["v"].to_numpy(), alone)
        left = copies[to] - (own[at] == to)
        side = lambda frame, name, rows: frame[name].to_numpy(np.int64)[rows]
        return pd.DataFrame({"query_id": side(q, "vec_id", at), "query_key": side(q, "key", at), "asked": side(q, "copies", at), "vec_id": side(c, "vec_id", to), "key": side(c, "key", to), "copies": left, "score": scores})

    found = quer.groupBy("cb", "qb").cogroup(cand.groupBy("cb", "qb")).applyInPandas(tile, f"query_id long, query_key long, asked long, vec_id long, key long, copies long, score {score_type}")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key", "copy"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")


def padded(rows: np.ndarray, dtype: type) -> np.ndarray:
    """Rows of unequal length as one matrix; missing components are 0."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_of(scores: np.ndarray, k: int, own: int) -> np.ndarray:
    """Positions of the k best scores but position own, ties to the earlier position."""
    keep = np.delete(np.arange(len(scores)), own) if own >= 0 else np.arange(len(scores))
    if len(keep) > k:
        s = scores[keep]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        over = keep[s > edge]
        keep = np.concatenate((over, keep[s == edge][: k - len(over)]))
    return keep
