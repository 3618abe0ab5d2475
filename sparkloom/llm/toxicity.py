"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ALNUM, batches, hashed_words, least_hashed

#: Labelled examples of each class at most, those of least hash; bounds the model.
EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 64
#: A term of at least one in so many examples is kept dense.
DENSE = 16
#: Texts that are searched at once.
TEXTS = 64
#: Arrays that only the index has; they are made from the examples where they are first asked for.
BUILT = ("terms", "factor", "silent", "toxic", "ids", "weight", "postings", "knots", "values")
#: Weight of the no-evidence rate among the votes, where a nearest possible neighbour weighs 1.
PRIOR = 0.0025


class Postings:
    """A sparse matrix of terms by examples, stored by term; `weights @ postings` scores every example.

    A term of at least one in DENSE examples has its values side by side, a row in each
    block, so that many texts meet a block in one product of matrices.
    """

    __array_ufunc__ = None

    def __init__(self, term: np.ndarray, position: np.ndarray, value: np.ndarray, n_terms: int, n: int):
        self.n, self.blocks = n, -(-n // BLOCK)
        frequent = np.flatnonzero(np.bincount(term, minlength=n_terms) * DENSE >= max(n, 1))
        self.row = np.full(n_terms, -1)
        self.row[frequent] = np.arange(len(frequent))
        full = self.row[term] >= 0
        self.rows = np.zeros((self.blocks, len(frequent), BLOCK))
        self.rows[position[full] // BLOCK, self.row[term[full]], position[full] % BLOCK] = value[full]
        self.rows_most = self.rows.max(axis=2).T.copy()
        order = np.lexsort((position[~full], term[~full]))
        self.position, self.value = position[~full][order], value[~full][order]
        self.starts = np.searchsorted(term[~full][order], np.arange(n_terms + 1))

    def split(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the frequent terms by text, scores from the other terms by text, block and place)."""
        row = self.row[terms]
        full = row >= 0
        heavy = np.zeros((texts, self.rows.shape[1]))
        heavy[owner[full], row[full]] = weights[full]
        at, n = _ranges(self.starts[terms], self.starts[terms + 1])
        width = self.blocks * BLOCK
        light = np.bincount(np.repeat(owner * width, n) + self.position[at], np.repeat(weights, n) * self.value[at], texts * width)
        return heavy, light.astype(np.float64, copy=False).reshape(texts, self.blocks, BLOCK)

    def __rmatmul__(self, weights: np.ndarray) -> np.ndarray:
        heavy, light = self.split(np.zeros(len(weights), np.int64), np.arange(len(weights)), weights, 1)
        return (light[0] + heavy[0] @ self.rows).ravel()[: self.n]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the indexes lo[i] .. hi[i] - 1 of every i in turn, how many each i has)."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n), n


class ExampleIndex:
    """Postings of the examples' unit vectors over every term they have, with block maxima.

    A term weighs (1 + log tf) * idf * phi, where phi = sqrt(chi-square / examples), from 0 to
    1, is how clearly the term goes with one class. phi does not depend on the number of
    examples and leaves no term out that goes with a class at all; with examples of one class
    only, where no term can, it is 1.
    """

    def __init__(self, rows: list[tuple[int | None, int, np.ndarray, np.ndarray]], rates: tuple[float, float]):
        """rows: (doc_id, toxic, term hashes, term counts) of each example; rates: rows that an example of class 0 or 1 stands for.

        The index itself is built by the process that first uses it, so that the driver, which
        only sends the examples on, holds no more than them.
        """
        self.rows, self.rates = rows, rates

    def __getattr__(self, name: str):
        if name not in BUILT or "rows" not in self.__dict__:
            raise AttributeError(name)
        self._build(self.rows, self.rates)
        return self.__dict__[name]

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "rates": self.rates}

    def _build(self, rows: list[tuple[int | None, int, np.ndarray, np.ndarray]], rates: tuple[float, float]) -> None:
        n = len(rows)
        toxic = np.array([t for _, t, *_ in rows], np.int64)
        ids = np.array([d if d is not None else -1 for d, *_ in rows], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(h) for *_, h, _ in rows])
        self.terms, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for *_, h, _ in rows)]), return_inverse=True)
        term = term.astype(np.int32)
        df = np.bincount(term, minlength=len(self.terms)).astype(np.float64)
        a = np.bincount(term, toxic[owner], len(self.terms))
        n1 = float(toxic.sum())
        n0, rest = n - n1, n - df
        phi = np.abs(a * n0 - (df - a) * n1) / np.sqrt(np.maximum(1.0, n1 * n0 * df * rest)) if n1 and n0 else np.ones(len(df))
        self.factor = (np.log((1 + n) / (1 + df)) + 1) * phi
        value = np.concatenate([np.zeros(0), *(1 + np.log(c) for *_, c in rows)]) * self.factor[term]
        norms = np.sqrt(np.bincount(owner, value**2, n))
        weight = np.asarray(rates)[toxic] if n else np.zeros(0)
        some = norms > 0
        self.silent = _rate(toxic[~some], weight[~some], _rate(toxic, weight, 0.0))
        # alike examples side by side, so that blocks differ in their maxima
        first = np.full(n, -1)
        by_weight = np.lexsort((value, owner))
        last = np.flatnonzero(np.diff(owner[by_weight], append=n))
        first[owner[by_weight][last]] = term[by_weight][last]
        del by_weight, last
        index = np.lexsort((ids, first, toxic))
        index = index[some[index]]
        self.toxic, self.ids, self.weight = toxic[index], ids[index], weight[index]
        place = np.full(n, -1, np.int32)
        place[index] = np.arange(len(index))
        kept = some[owner] & (value > 0)
        position, term, value = place[owner[kept]], term[kept], value[kept] / norms[owner[kept]]
        del owner, kept
        self.postings = Postings(term, position, value, len(self.terms), len(index))
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        order = np.lexsort((term, position))
        self._calibrate(position[order], term[order], value[order])

    def search(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of the nearest examples, exactly; ties to the smaller position."""
        return self.search_all(np.zeros(len(terms), np.int64), terms, weights, [skip])[0]

    def search_all(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, skips: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """search for texts 0, 1, ..., one for each of skips; owner is the text of each term, in order.

        A block's bound is its best score from the rarer terms plus what the frequent terms'
        block maxima allow. Each text meets its block of highest bound first; a block is left
        out for the texts that have NEIGHBOURS examples above its bound.
        """
        p, texts = self.postings, len(skips)
        if not p.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * texts
        heavy, scores = p.split(owner, terms, weights, texts)
        bound = scores.max(axis=2) + heavy @ p.rows_most
        best = bound.argmax(axis=1)
        edge = np.zeros(texts)
        for first in (True, False):
            for b in range(p.blocks):
                now = np.flatnonzero(best == b if first else (best != b) & (bound[:, b] > 0) & (bound[:, b] >= edge - 1e-11))
                scores[now, b] += heavy[now] @ p.rows[b]
                if not first:
                    scores[np.setdiff1d(np.flatnonzero(best != b), now, assume_unique=True), b] = 0
            if first:  # one more than needed, as the text's own example may be among them
                edge = np.partition(scores[np.arange(texts), best], BLOCK - NEIGHBOURS - 1, axis=1)[:, BLOCK - NEIGHBOURS - 1]
        out = []
        for s, low, skip in zip(scores.reshape(texts, -1), edge, skips, strict=True):
            near = np.flatnonzero((s > 0) & (s >= low - 1e-11))
            near = near[near != skip]
            value = s[near].round(12)
            order = np.lexsort((near, -value))[:NEIGHBOURS]
            out.append((near[order], value[order]))
        return out

    def _search_batches(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, skip_own: bool = False) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        """(text, its search) of each text that has terms; owner does not fall."""
        own, group = np.unique(owner, return_inverse=True)
        cuts = np.searchsorted(group, np.arange(0, len(own) + TEXTS, TEXTS))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            mine = own[k * TEXTS : (k + 1) * TEXTS].tolist()
            yield from zip(mine, self.search_all(group[a:b] - k * TEXTS, terms[a:b], weights[a:b], mine if skip_own else [-1] * len(mine)), strict=True)

    def vote(self, found: np.ndarray, scores: np.ndarray) -> float:
        w = scores**2 * self.weight[found] / max(self.weight.max(initial=0.0), 1e-300)
        return float((w @ self.toxic[found] + PRIOR * self.silent) / (w.sum() + PRIOR))

    def _calibrate(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Isotonic fit of leave-one-out votes to labels, each example weighed by what it stands for."""
        if not len(self.ids):
            return
        raw = np.array([self.vote(*f) for _, f in self._search_batches(owner, term, value, True)])
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # weight, weighted label, weighted vote
        for x, y, w in zip(raw[order], self.toxic[order], self.weight[order], strict=True):
            pools.append([w, w * y, w * x])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
        self.knots = np.array([p[2] / p[0] for p in pools])
        self.values = np.array([p[1] / p[0] for p in pools])

    def score(self, texts: list[bytes]) -> list[tuple[float, list[tuple[int, int, float]], list[str]]]:
        """(calibrated score, nearest examples (id, toxic, similarity), terms found) of each text."""
        out: list = [(self.silent, [], [])] * len(texts)
        if not len(self.ids):
            return out
        for lo, hi in batches([len(t) for t in texts]):
            words, bounds, starts, ends, joined = hashed_words(texts[lo:hi], ALNUM)
            at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
            hit = np.flatnonzero((self.terms[at] == words) & (self.factor[at] > 0))
            if not len(hit):
                continue
            owner = np.searchsorted(bounds, hit, "right") - 1
            keys, seen, counts = np.unique(owner * len(self.terms) + at[hit], return_index=True, return_counts=True)
            owner, term, seen = keys // len(self.terms), keys % len(self.terms), hit[seen]
            weights = (1 + np.log(counts)) * self.factor[term]
            weights /= np.sqrt(np.bincount(owner, weights**2))[owner]
            cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
            for i, (found, scores) in self._search_batches(owner, term, weights):
                if not len(found):
                    continue
                calibrated = float(np.interp(self.vote(found, scores), self.knots, self.values))
                a, b = cuts[i], cuts[i + 1]
                heavy = seen[a:b][np.argsort(-weights[a:b], kind="stable")[:5]]
                near = [(int(self.ids[f]), int(self.toxic[f]), float(s)) for f, s in zip(found[:3], scores[:3], strict=True)]
                out[lo + i] = calibrated, near, [joined[starts[t] : ends[t]].tobytes().lower().decode(errors="replace") for t in heavy]
        return out


def _rate(toxic: np.ndarray, weight: np.ndarray, default: float) -> float:
    return float(toxic @ weight / weight.sum()) if len(toxic) and weight.sum() > 0 else default


def term_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of each text's lower-cased (A-Z) words of ASCII letters, digits and non-ASCII characters."""
    return [np.unique(hashed_words([t], ALNUM)[0], return_counts=True) for t in texts]


def fit_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> ExampleIndex:
    """The index of at most `examples` labelled documents of each class.

    The examples are those of least hash of their id, whole texts with all their terms; a
    document of several labels is toxic if one says so. Null ids, labels and texts teach
    nothing; an empty table leaves no example. The chosen ids, at most twice `examples`, are broadcast to find the texts; terms
    are counted on the executors and travel through the driver as 16 bytes a term of an example.
    Each Python worker builds the index once, when it first scores.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = least_hashed(known, "toxic", "doc_id", examples).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            counts = term_counts(t.column("text").cast(pa.binary()).to_pylist())
            columns = [pa.array([c[k].tobytes() for c in counts], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("toxic"), *columns], names=["doc_id", "toxic", "hashes", "counts"])

    counted = rows.mapInArrow(count, "doc_id long, toxic int, hashes binary, counts binary").collect()
    population = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows_ = sorted(((r.doc_id, r.toxic, np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.counts, np.int64)) for r in counted), key=lambda r: r[:2])
    rates = tuple(population.get(y, 0) / max(1, sum(r[1] == y for r in rows_)) for y in (0, 1))
    return ExampleIndex(rows_, rates)


def score_toxicity(docs: DataFrame, model: ExampleIndex) -> DataFrame:
    """docs plus score, predicted, evidence and terms; columns named so are replaced.

    score is the calibrated vote of the nearest examples, weighted by squared similarity;
    a text that shares no term with any example, null and empty texts included, gets the
    rate of toxic labels among examples without terms. predicted is 1 from 0.5 on.
    evidence holds up to three nearest examples, nearest first. Whole texts are read,
    however long; repeated rows stay; an empty table stays empty. Without any example every
    score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score", "predicted", "evidence", "terms")
    evidence = "array<struct<doc_id:bigint,toxic:int,similarity:double>>"
    schema = plain.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(evidence).alias("evidence"), F.lit(None).cast("array<string>").alias("terms")).schema
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def predict(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for t in tables:
            found = index.score([x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()])
            near = [[{"doc_id": d, "toxic": y, "similarity": s} for d, y, s in e] for _, e, _ in found]
            columns = [pa.array([s for s, _, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _, _ in found], pa.int32()), pa.array(near, kind), pa.array([w for *_, w in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*t.columns, *columns], names=[*t.schema.names, "score", "predicted", "evidence", "terms"])

    return plain.mapInArrow(predict, schema)
