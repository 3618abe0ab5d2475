"""Importance resampling towards a target text collection: hashed word features counted and scored on tries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from re import compile as pattern

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.lineage import cut_lineage

#: A word, after A-Z are lower-cased: a maximal run of ASCII digits, small letters and non-ASCII bytes.
WORDS = pattern(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
#: Nodes that a trie holds before its counts move to the bucket totals and it starts anew; memory only.
NODES = 200_000


class WordTrie:
    """Runs of at most n words as paths; a node is [value, CRC of the path's bytes, children].

    CRC32 goes on from a prefix, so a path of n words costs each of its words once, and a
    word that is met again costs no hash at all. With gains, a node's value is the gain of
    its bucket; without, it is how often the path occurred.
    """

    def __init__(self, n: int, buckets: int, gains: np.ndarray | None = None) -> None:
        self.n, self.buckets, self.gains = n, buckets, None if gains is None else gains.tolist()
        self.totals = np.zeros(buckets, np.int64)
        self.root: dict[bytes, list] = {}
        self.size = 0

    def _node(self, level: dict[bytes, list], word: bytes, before: int | None) -> list:
        crc = zlib.crc32(word) if before is None else zlib.crc32(b" " + word, before)
        node = level[word] = [0 if self.gains is None else self.gains[crc % self.buckets], crc, {}]
        self.size += 1
        return node

    def count(self, words: list[bytes]) -> int:
        """Count every run of 1 to n words; returns how many there are."""
        features = 0
        for i in range(len(words)):
            level, crc = self.root, None
            for word in words[i : i + self.n]:
                node = level.get(word) or self._node(level, word, crc)
                node[0] += 1
                crc, level = node[1], node[2]
                features += 1
            if self.size >= NODES:
                self.flush()
        return features

    def score(self, words: list[bytes]) -> tuple[int, int]:
        """(runs of 1 to n words, sum of the gains on their paths)."""
        features = total = 0
        for i in range(len(words)):
            level, crc = self.root, None
            for word in words[i : i + self.n]:
                node = level.get(word) or self._node(level, word, crc)
                total += node[0]
                crc, level = node[1], node[2]
                features += 1
            if self.size >= NODES:
                self.root, self.size = {}, 0
        return features, total

    def flush(self) -> None:
        """Move the counts of all nodes to the bucket totals and forget the nodes."""
        stack = [self.root]
        while stack:
            for times, crc, children in stack.pop().values():
                self.totals[crc % self.buckets] += times
                if children:
                    stack.append(children)
        self.root, self.size = {}, 0


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text's bytes; none of null. Bytes that are no UTF-8 are word bytes."""
    return WORDS.findall(text.lower()) if text else []


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    """A binary column's values, one at a time."""
    return (x.as_py() for x in batch.column(column))


def bucket_totals(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, times: how many features of all texts fall in each bucket that has any.

    A partition counts on its own trie and gives at most one row a bucket. Null, empty and
    wordless texts have no features; repeated rows count each; an empty table gives no rows.
    Very long texts are read whole: the trie is emptied into the totals at NODES nodes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(n, buckets)
        for batch in batches:
            for value in _texts(batch, 0):
                trie.count(words_of(value))
        trie.flush()
        used = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(trie.totals[used], pa.int64())], names=["bucket", "times"])

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, times long")
    return parts.groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln((t+1)(T'+B) / ((s+1)(T+B)))), s and t its raw and target totals, T' and T their sums, B the buckets.

    Collects two sums a bucket, so `buckets` numbers twice whatever the size of the collections.
    """
    s, t = (np.zeros(buckets) for _ in range(2))
    for into, totals in ((s, raw), (t, target)):
        for r in totals.collect():
            into[r.bucket] = r.times
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, text: str = "text", n: int = 1, into: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """docs' columns but the text, then words, features and floored mean gain of each text (0 without features).

    Every text is walked whole over a trie whose nodes carry the gain of their bucket.
    """
    kept = [c for c in docs.columns if c != text]
    places = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, places)), F.col(f"`{text}`").cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(n, len(gains), gains)
        for batch in batches:
            at = batch.num_columns - 1
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(_texts(batch, at)):
                words = words_of(value)
                features, total = trie.score(words)
                out[:, i] = len(words), features, total // features if features else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, out)], names=[*places, *into])

    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in into)])
    return rows.mapInArrow(score, schema).select(*(F.col(p).alias(c) for p, c in zip(places, kept)), *into)


def gumbel(ident: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel draw g that depends on the seed and the id's text alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank`, their place from 1 in the order, without one task that sees them all.

    Rows are dealt by ranges of the order and written; a row's rank is its place within its
    range behind the rows of the ranges before. Only one count a range goes through a window.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number a task
    before = pd.Series({p: counts[p] for p in sorted(counts)}, dtype="int64").cumsum().shift(fill_value=0)
    starts = dealt.sparkSession.createDataFrame([(int(p), int(b)) for p, b in before.items()], "_p long, _before long")
    return dealt.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("rank", F.col("_before") + place + 1).drop("_p", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null if the row isn't drawn.

    Draws floor(percent N / 100) of the N documents with least_words words or more, without
    replacement and in proportion to exp(weight / 1000): the highest of weight plus seeded
    Gumbel noise (a null id counts as an empty one there), ties to the smaller id, null ids
    first, equal ids in no fixed order. Null,
    empty and wordless texts have no features, weight 0, and aren't drawn; repeated rows are
    rows of their own with equal scores; an empty target or empty docs give gains of their
    own and no error. Texts of any length are read whole. Other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gains = bucket_gains(bucket_totals(rows, "text", n, buckets), bucket_totals(target, target_text, n, buckets), buckets)
    scored = cut_lineage(weighted(rows, gains, "text", n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    place = ranked(able, F.col("score").desc(), F.col("doc_id").asc())
    place = place.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return place.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
