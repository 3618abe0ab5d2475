"""Exact top-k search by exhaustive term-at-a-time accumulation over integer postings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.vector_grid import best_of, grid, padded


def quantised(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, x as double; beyond 64 bits the nearest long."""
    with np.errstate(over="ignore"):
        floors = np.floor(scale * padded(rows, np.float64))
    fits = np.abs(floors) < 2.0**63
    return np.where(fits, np.where(fits, floors, 0.0).astype(np.int64), np.where(floors > 0, 2**63 - 1, -(2**63)))


def finite(embedding: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _accumulate(k: int, scale: int):
    def local(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weights, terms = quantised(c, scale), quantised(q, scale)
        width = min(weights.shape[1], terms.shape[1])
        wide = float(np.abs(weights.astype(np.float64)).max(initial=0)) * float(np.abs(terms.astype(np.float64)).max(initial=0)) * max(1, width) >= 2.0**62
        if wide:  # Python integers where 64 bits could overflow
            weights, terms = weights.astype(object), terms.astype(object)
        postings = []  # by term: the candidates' positions and weights; slice(None) when every one has the term
        for t in range(width):
            at = np.flatnonzero(weights[:, t])
            postings.append((slice(None) if len(at) == len(c) else at, weights[at, t]))
        rows, places, best = [], [], []
        scores = np.zeros(len(c), weights.dtype)
        for i, mine in enumerate(own):
            scores[:] = 0
            for t in np.flatnonzero(terms[i, :width]):
                at, w = postings[t]
                scores[at] += terms[i, t] * w
            final = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64) if wide else scores
            top = best_of(final, k, mine)
            rows.append(np.full(len(top), i))
            places.append(top)
            best.append(final[top])
        return np.concatenate(rows), np.concatenate(places), np.concatenate(best)

    return local


def top_inner_products(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the
    query's own. Vectors that are null or hold null or non-finite components, and null
    ids, take no part. Rows that repeat an id, or are equal, are candidates and queries
    each. Vectors of unequal length meet on their common components; an empty vector scores
    0. Components and scores beyond 64 bits count as the nearest long. Ties go to the
    smaller id. With fewer than k candidates all are returned; an empty table gives none.
    Extra columns are ignored.
    """
    clean = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector)))
    return grid(clean.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")), every, _accumulate(k, scale), "long", k)
