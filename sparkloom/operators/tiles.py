"""Cosines of a block of queries with a block of candidates by one product of matrices, rounded as Spark rounds them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Scores have 6 decimals.
UNITS = 1_000_000
#: Numbers of one matrix that a tile holds at a time.
CELLS = 1 << 22
#: Candidates whose maximum stands for them in the first look for a query's best.
GROUP = 32
#: Norms whose squares are far from overflow and underflow; other rows are taken component by component.
SMALL, LARGE = 1e-100, 1e100


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, or of all rows of a with all of b, summed in component order as Spark's aggregate does."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def cosines(dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """dot / norms; inf for NaN, which Spark orders above all numbers, and -inf where norms is 0 and there is no score."""
    score = dot / norms
    return np.where(norms == 0, -np.inf, np.where(np.isnan(score), np.inf, score))


def rounded(score: float) -> int:
    """A score in units of the last decimal, halves away from zero by its shortest decimal form."""
    return int(Decimal(repr(float(score))).quantize(Decimal(1) / UNITS, ROUND_HALF_UP) * UNITS)


def maxima(scores: np.ndarray, k: int) -> np.ndarray:
    """The largest score of each group of columns, group i having column i and each width-th after it; of rows too narrow for k the scores."""
    width = scores.shape[1] // GROUP
    if width < 4 * k:
        return scores
    most = scores[:, :width].copy()
    for j in range(1, GROUP):
        np.maximum(most, scores[:, j * width : (j + 1) * width], out=most)
    return most


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row its k-th largest score, or the least if there are fewer."""
    below = scores.shape[1] - min(k, scores.shape[1])
    return np.partition(scores, below, axis=1)[:, below]


def edges(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that k of its scores reach, or all if there are fewer."""
    return kth(maxima(scores, k), k)


def reaching(scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the scores that lie at most slack below their row's edge; only groups whose maximum does are looked into."""
    most = maxima(scores, k)
    low = (kth(most, k) - slack)[:, None]
    high = lambda x, low: np.nonzero((x >= low) & (x > -np.inf))
    if most is scores:
        return high(scores, low)
    width = most.shape[1]
    at, first = high(most, low)
    columns = first[:, None] + width * np.arange(GROUP)
    i, j = high(scores[at[:, None], columns], low[at])
    rest_at, rest = high(scores[:, GROUP * width :], low)
    return np.concatenate([at[i], rest_at]), np.concatenate([columns[i, j], rest + GROUP * width])


def best(q: np.ndarray, c: np.ndarray, own: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, candidate rows, scores): the k best candidates of each query by rounded score, ties to the earlier row.

    own has the span of candidate rows that a query leaves out. The product of matrices, in
    single precision, only chooses: what may round to one of the k best stays and is scored in
    double precision, and a score that lies too close to a half for that is computed again in
    component order.
    """
    with np.errstate(all="ignore"):
        nq, nc = np.sqrt(dots(q, q)), np.sqrt(dots(c, c))
        plain = lambda n: (n > SMALL) & (n < LARGE)
        unit = lambda m, n: np.where(plain(n)[:, None], m / n[:, None], 0.0).astype(np.float32)
        uq, uc, odd_q, odd_c = unit(q, nq), unit(c, nc), ~plain(nq), ~plain(nc)
        coarse, slack = (8 * (q.shape[1] + 8) * float(np.finfo(x).eps) for x in (np.float32, float))
        odd_at = np.flatnonzero(odd_c)
        exact = lambda i, j: cosines(dots(q[i], c[j]), nq[i] * nc[j])

        def units_of(at: np.ndarray, to: np.ndarray) -> np.ndarray:
            value = np.einsum("ij,ij->i", q[at], c[to]) / (nq[at] * nc[to]) * UNITS
            odd = odd_q[at] | odd_c[to]
            value[odd] = exact(at[odd], to[odd]) * UNITS
            units = np.floor(value + 0.5)
            close = np.flatnonzero(np.abs(value - np.floor(value) - 0.5) < UNITS * slack)
            if len(close):
                units[close] = [rounded(x) for x in exact(at[close], to[close])]
            return units

        out = []
        step, pairs = max(1, CELLS // max(1, len(c))), max(1, CELLS // max(1, q.shape[1]))
        for lo in range(0, len(q), step):
            part = slice(lo, lo + step)
            scores = uq[part] @ uc.T
            for rows, columns in ((slice(None), odd_at), (np.flatnonzero(odd_q[part]), slice(None))):
                a, b = q[part][rows], c[columns]
                if len(a) and len(b):
                    scores[rows, columns] = cosines(dots(a[:, None], b[None]), nq[part][rows][:, None] * nc[columns][None])
            for i, (first, last) in enumerate(own[part]):
                scores[i, first:last] = -np.inf
            at, to = reaching(scores, k, 1 / UNITS + 2 * coarse)
            at = at + lo
            units = np.concatenate([units_of(at[x : x + pairs], to[x : x + pairs]) for x in range(0, len(at), pairs)] or [np.zeros(0)])
            order = np.lexsort((to, -units, at))
            at, to, units = at[order], to[order], units[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append((at[kept], to[kept], units[kept]))
        at, to, units = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return at, to, np.where(np.isinf(units), np.nan, units / UNITS)
