"""Language identification by prediction by partial matching over bytes under frozen statistics.

Each language has counts of bytes after contexts of 0 to 3 bytes. A byte seen after a
context costs -log2(c / (N + u)), with N bytes of u kinds seen there; any other costs an
escape, -log2(u / (N + u)), and goes on with the context shortened by a byte, down to the
uniform code of 8 bits. A text's language is the one with the shortest code for all of its
bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import batches, least_hashed

#: Whole training texts of one language, those of least hash, and of all languages; both bound the model.
TEXTS_PER_LANGUAGE = 400
TEXTS = 16_000
ORDER = 3
#: Languages whose costs of a batch are held at a time.
SLICE = 16
UNDETERMINED = "und"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def _grams(padded: np.ndarray) -> np.ndarray:
    """(three bytes before, byte) of each position of a text behind ORDER line feeds, as integers."""
    b = padded.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (three bytes before, byte) of a text as integers, with counts; line feeds stand before its start."""
    return np.unique(_grams(np.frombuffer(b"\n" * ORDER + text, np.uint8)), return_counts=True)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of wanted in the sorted keys, whether they are there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTree:
    """One language's frozen code lengths: at each order sorted strings (context and byte) with
    their bits, and sorted contexts with the bits of their escape. Only what was seen is stored."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            keys, of = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(of, n, len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            kinds = np.bincount(of, minlength=len(contexts))
            whole = np.bincount(of, counts, len(contexts)) + kinds
            self.orders.append((keys.astype(np.uint32), np.log2(whole[of] / counts), contexts.astype(np.uint32), np.log2(whole / kinds)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each (three bytes before, byte)."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for order, (keys, cost, contexts, escape) in zip(range(ORDER, -1, -1), self.orders, strict=True):
            key = grams[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, seen = _at(keys, key)
            out[todo[seen]] += cost[at[seen]]
            todo, key = todo[~seen], key[~seen]
            at, known = _at(contexts, key >> np.uint32(8))
            out[todo[known]] += escape[at[known]]
        out[todo] += 8.0
        return out


class ContextTrees:
    """The context trees of every learned language."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram, n."""
        self.langs = sorted(counts["lang"].unique())
        lang = np.searchsorted(self.langs, counts["lang"].to_numpy(object)) if len(counts) else np.zeros(0, int)
        grams, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        self.trees = [ContextTree(grams[lang == i], n[lang == i]) for i in range(len(self.langs))]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language; a batch's distinct strings are looked up once."""
        out = np.zeros((len(texts), len(self.trees)))
        for lo, hi in batches([len(t) for t in texts], 1 << 19):
            pad = b"\n" * ORDER
            joined = np.frombuffer(pad + pad.join(texts[lo:hi]) + pad, np.uint8)
            grams, at = np.unique(_grams(joined), return_inverse=True)
            begins = np.cumsum([0, *(len(t) + ORDER for t in texts[lo:hi])])
            edges = np.stack((begins[:-1], begins[1:] - ORDER), 1).ravel()
            some = (edges[0::2] < edges[1::2])[:, None]
            for a in range(0, len(self.trees), SLICE):
                bits = np.stack([tree.bits(grams) for tree in self.trees[a : a + SLICE]], axis=1)[at]
                out[lo:hi, a : a + SLICE] = np.where(some, np.add.reduceat(bits, edges, axis=0)[0::2], 0.0)
        return out


def fit_languages(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, most: int = TEXTS) -> ContextTrees:
    """Context trees from at most per_language whole texts of each value of lang, and `most` in all.

    The texts are chosen by id alone and only then fetched; strings are counted by the
    executors, and only the counts of that bounded sample come to the driver. Rows of null
    text, lang or doc_id teach nothing; of rows that repeat an id the least text does. An
    empty table teaches no language. A very long text is counted whole.
    """
    known = docs.select("lang", "doc_id", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = least_hashed(known, "lang", "doc_id", per_language).orderBy("r", F.xxhash64("lang", "doc_id"), "lang").limit(most).select("lang", "doc_id")
    texts = known.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # `most` ids at most

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for t in tables:
            for lang, text in zip(t.column("lang").to_pylist(), t.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in gram_counts(text)), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    counts = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return ContextTrees(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())


def identify(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """docs plus lang_pred, score and bits (of the shortest code); columns named so are replaced.

    Null texts and texts without a letter are `und` with score 0, and so are all texts if
    no language was learned. The score is the language's posterior probability with equal
    priors. Ties go to the smaller name. Repeated rows stay repeated; whole texts are read,
    however long; an empty table stays empty; other columns keep their values whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score", "bits")
    text, width = plain.columns.index("text"), len(plain.columns)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = plain.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits")).schema
    names = schema.names

    def predict(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for t in tables:
            letters = np.array(t.column(width).to_pylist(), bool) & bool(trees.langs)
            texts = t.column(text).cast(pa.binary()).filter(pa.array(letters)).to_pylist()
            lang = np.full(len(letters), UNDETERMINED, object)
            score, bits = np.zeros(len(letters)), np.zeros(len(letters))
            if texts:
                lengths = trees.code_lengths(texts)
                best = lengths.argmin(1)
                bits[letters] = shortest = lengths.min(1)
                lang[letters] = np.array(trees.langs, object)[best]
                score[letters] = 1 / np.exp2(np.maximum(shortest[:, None] - lengths, -1000.0)).sum(1)
            yield pa.RecordBatch.from_arrays([*t.columns[:width], pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=names)

    return plain.select(*plain.columns, letters.alias("_letters")).toDF(*(f"_{i}" for i in range(width + 1))).mapInArrow(predict, schema)
