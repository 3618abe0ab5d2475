"""Nearest neighbours by a block matrix join over int8 tiles with quantisation error bounds."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.exact_topk import finite
from sparkloom.llm.vector_grid import grid, padded

#: Up to this many components, sums of int8 products are exact in float32.
FLOAT32_WIDTH = 1024


def _quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, their scales, norms of what rounding lost) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component, which loses no bit and no cosine."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in component order, so that equal vectors give equal scores."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        aa += a[:, d] * a[:, d]
        bb += b[:, d] * b[:, d]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _tile(k: int):
    def local(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(len(r) for r in (*q, *c))
        full_q, full_c = (scaled(np.pad(m, ((0, 0), (0, width - m.shape[1])))) for m in (padded(q, np.float64), padded(c, np.float64)))
        (cq, sq, eq), (cc, sc, ec) = (_quantise(m / np.linalg.norm(m, axis=1)[:, None]) for m in (full_q, full_c))
        kind = np.float32 if width <= FLOAT32_WIDTH else np.float64
        tile = (cq.astype(kind) @ cc.astype(kind).T).astype(np.float64) * sq[:, None] * sc[None, :]
        # |q.c - q'.c'| <= |q'| |c - c'| + |q - q'| |c| with |c| = 1, |q'| <= 1 + |q - q'|
        slack = (1 + eq)[:, None] * ec[None, :] + eq[:, None] + 1e-9
        low, high = tile - slack, tile + slack
        mine = np.flatnonzero(own >= 0)
        low[mine, own[mine]] = high[mine, own[mine]] = -np.inf
        kept = min(k, len(c))
        edge = np.partition(low, len(c) - kept, axis=1)[:, len(c) - kept]
        at, to = np.nonzero((high >= edge[:, None]) & (high > -np.inf))
        scores = exact_cosine(full_q[at], full_c[to])
        heaps: list[list[tuple[float, int]]] = [[] for _ in q]
        for i, score, place in zip(at.tolist(), scores.tolist(), (-to).tolist(), strict=True):
            h = heaps[i]
            if len(h) < k:
                heapq.heappush(h, (score, place))
            elif (score, place) > h[0]:
                heapq.heapreplace(h, (score, place))
        rows = [(i, -place, score) for i, h in enumerate(heaps) for score, place in h]
        i, places, best = zip(*rows, strict=True) if rows else ((), (), ())
        return np.array(i, np.int64), np.array(places, np.int64), np.array(best, np.float64)

    return local


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines (double) of each query, exactly.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the
    query's own. A pair is dropped only when the int8 bound proves that k others of its
    block are nearer. Vectors that are null, zero or hold null or non-finite components,
    and null ids, take no part. Rows that repeat an id, or are equal, are candidates and
    queries each. A shorter vector counts as filled up with zeros; components of any finite
    size do. Ties go to the smaller id. With fewer than k candidates all are returned; an
    empty table gives no rows. Extra columns are ignored.
    """
    v = F.col(vector)
    clean = vectors.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    return grid(clean.select(F.col(id_col).alias("vec_id"), v.alias("v")), every, _tile(k), "double", k)
