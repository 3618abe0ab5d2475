"""Pieces shared by the corpus operators: samples by hash, sizes, hashed words and shingles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage

#: A word is a maximal run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Parts of the hash range in which least_hashed counts before it ranks.
RANGES = 1024


def least_hashed(rows: DataFrame, by: str, ident: str, n: int) -> DataFrame:
    """by, ident, r: the n distinct idents of least hash of each value of by, ranked from 1.

    Idents are counted by ranges of their hash, and only the ranges that the first n lie in
    are ranked, so that no task sorts a whole class, however many rows it has. Rows of null
    by or ident are left out; an empty table gives none.
    """
    hashed = rows.where(F.col(by).isNotNull() & F.col(ident).isNotNull()).select(by, ident).distinct()
    hashed = cut_lineage(hashed.withColumn("h", F.xxhash64(ident)).withColumn("part", F.shiftrightunsigned("h", 54)))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(by, "part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    some = hashed.join(counts.where(F.col("before") < n).select(by, "part"), [by, "part"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy("part", "h", ident))
    return some.select(by, ident, rank.alias("r")).where(F.col("r") <= n)


def word_count(text: Column) -> Column:
    """Number of words as long; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, from file sizes; no job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def parts_for(df: DataFrame, bytes_each: int, least: int) -> int:
    """How many parts keep each near bytes_each; only a task size, results do not depend on it."""
    return int(max(least, min(plan_bytes(df) // bytes_each, 200_000)))


# ---------------------------------------------------------------- hashed words


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_arrays(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers


def byte_table(separators: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, hash value) for each byte; fold maps A-Z to a-z."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    values = _BYTE.copy()
    if fold:
        values[65:91] = values[97:123]
    return is_word, values


#: White space only separates.
SPACED = byte_table(SPACE_BYTES)
#: ASCII letters, digits and every non-ASCII byte make words; all other ASCII separates.
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def batches(sizes: Sequence[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to at most limit (one larger element stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def hashed_words(texts: Sequence[bytes], table: tuple[np.ndarray, np.ndarray] = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bounds, starts, ends, bytes): words bounds[i]:bounds[i+1] are text i's.

    starts and ends index the returned buffer, in which the texts are joined by line feeds.
    """
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    is_word, values = table
    edge = is_word[joined]
    turns = np.flatnonzero(edge[1:] != edge[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    power, inverse = _power_arrays(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(values[joined] * power[: len(joined)], out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * inverse[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)]) + 1
    bounds = np.searchsorted(starts, begins)
    return words, bounds, starts, ends, joined


_PLACE = mix64(np.arange(101, 133, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingle_sets(texts: Sequence[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text.

    A text of 1 to k-1 words has its whole word sequence as its one shingle; null,
    empty and blank texts have the empty set.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    full = [t or b"" for t in texts]
    for a, b in batches([len(t) for t in full]):
        words, bounds, *_ = hashed_words(full[a:b])
        n = len(words)
        grams = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            grams += words[j : j + len(grams)] * _PLACE[j]
        grams = mix64(grams)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= k:
                g = np.sort(grams[lo : hi - k + 1])
                out[a + i] = g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif hi > lo:
                w = words[lo:hi]
                out[a + i] = mix64(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    return out


def set_id(hashes: np.ndarray) -> int:
    """64-bit fingerprint of a sorted hash array, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))
