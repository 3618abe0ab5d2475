"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and how often in the corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import batches
from sparkloom.operators.lineage import cut_lineage, written

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Both tokenizers end a token in front of a single blank between two other characters, so
#: texts are cut there and each distinct part is encoded once: "ab  cd ef" is "ab  cd", "ef".
PART = re.compile(r"(?<=\S) (?=\S)")
#: Distinct parts, and their characters, that a Python worker remembers; memory only.
PARTS, CHARACTERS = 400_000, 24_000_000
#: Characters of parts that are encoded in one call.
CALL = 1 << 16
#: Pairs of ids whose corpus counts are broadcast (about 50 bytes each): the most frequent
#: ones. The rest is joined by shuffle; each of them has at most 1/PAIRS of all links.
PAIRS = 1_000_000


def byte_characters() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the parts that this process met last."""

    def __init__(self, folder: str, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(os.path.join(folder, byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, pieces))
        bytes_of, names = byte_characters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(bytes_of[c] for c in name) if all(c in bytes_of for c in name) else name.encode()
        listed = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # a piece that goes on behind a blank would not end in front of every blank
        self.cut = not any("▁" in p.lstrip("▁") for p in listed)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(listed)]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # an id behind each of the separators of written groups
        self.then, self.over, self.next = (np.array([sign + n for n in names], object) for sign in ",|;")
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # a, b, groups of each part, 1 if its bytes differ
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.characters = 0

    def parts(self, text: str) -> list[str]:
        return PART.split(text) if self.cut else [text]

    def _ids(self, parts: list[str], ends: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of blank + part for all parts in a row, how many each has), for parts of which `ends` are the ends in bytes."""
        length = self.a_length if side == "a" else self.b_length
        encode = (lambda t: self.a.encode(t, add_special_tokens=False).ids) if side == "a" else (lambda t: self.b.encode(t[1:]))
        ids, counts, at = [], [], 0
        for lo, hi in batches(np.diff(ends, prepend=0).tolist(), CALL):
            some = np.array(encode("".join(" " + p for p in parts[lo:hi])), np.int64)
            token_ends, wanted = np.cumsum(length[some]), ends[lo:hi] - at
            last = np.searchsorted(token_ends, wanted)
            if len(some) and last[-1] == len(some) - 1 and (token_ends[last] == wanted).all():
                counts.append(np.diff(last, prepend=-1))
                ids.append(some)
            else:  # a part in it that its tokens don't give back
                each = [encode(" " + p) for p in parts[lo:hi]]
                counts.append(np.array([len(x) for x in each], np.int64))
                ids.append(np.array([i for x in each for i in x], np.int64))
            at = int(ends[hi - 1])
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, walk both lists of token ends at once and remember groups and links.

        Parts between visible characters are encoded many at once; those that begin or end
        with white space, and all if parts are whole texts, alone.
        """
        plain = [p for p in parts if len(p.strip()) == len(p)] if self.cut else []
        kept = set(plain)
        for lot in (plain, *([p] for p in parts if p not in kept)):
            if lot:
                self._learn(lot)

    def _learn(self, parts: list[str]) -> None:
        written = [(" " + p).encode() for p in parts]
        ends = np.cumsum([len(w) for w in written])
        (a_ids, n_a), (b_ids, n_b) = self._ids(parts, ends, "a"), self._ids(parts, ends, "b")
        a_joined, b_joined = (b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids)))
        bad = np.zeros(len(parts), np.int64)
        if not a_joined == b_joined == b"".join(written):
            for table, ids, n in ((self.a_bytes, a_ids, n_a), (self.b_bytes, b_ids, n_b)):
                at = 0
                for k, upto in enumerate(np.cumsum(n).tolist()):
                    bad[k] |= b"".join(map(table.__getitem__, ids[at:upto].tolist())) != written[k]
                    at = upto
            a_ids, b_ids = a_ids[np.repeat(bad == 0, n_a)], b_ids[np.repeat(bad == 0, n_b)]
            n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        # the merge of both sorted lists of ends: i and j are the pointers' places at each step,
        # which links token i to token j; a step at which both tokens end closes a group
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        at = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        i, j = np.searchsorted(a_ends, at), np.searchsorted(b_ends, at)
        closes = np.flatnonzero((a_ends[i] == at) & (b_ends[j] == at))
        a_to, b_to = i[closes] + 1, j[closes] + 1  # tokens up to the end of each group
        a_from, b_from = np.append(0, a_to)[:-1], np.append(0, b_to)[:-1]
        # a group's text is its a ids, then its b ids, each behind its separator
        text = np.empty(len(a_ids) + len(b_ids), object)
        signs = self.then[a_ids]
        signs[a_from] = self.next[a_ids[a_from]]
        text[np.arange(len(a_ids)) + np.repeat(b_from, a_to - a_from)] = signs
        signs = self.then[b_ids]
        signs[b_from] = self.over[b_ids[b_from]]
        text[np.arange(len(b_ids)) + np.repeat(a_to, b_to - b_from)] = signs
        upto = np.cumsum(n_a)  # groups, links and pieces of text up to the end of each part
        groups = np.searchsorted(a_to, upto) + (upto > 0)
        steps = np.append(0, closes + 1)[groups]
        pieces, begin = text.tolist(), 0
        for p, end in zip(parts, (upto + np.cumsum(n_b)).tolist()):
            self.codes[p] = len(self.groups)
            self.groups.append("".join(pieces[begin:end]))
            begin = end
        self.characters += int(ends[-1]) + sum(map(len, self.groups[-len(parts) :]))
        self.sizes = np.concatenate((self.sizes, np.stack((n_a, n_b, np.diff(groups, prepend=0), bad), 1)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + steps))
        self.pairs = np.concatenate((self.pairs, a_ids[i] * len(self.b_bytes) + b_ids[j]))

    def align(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links of each text; its groups; text, pair and times of its links, once for each pair)."""
        if len(self.codes) > PARTS or self.characters > CHARACTERS:
            self.forget()
        cut: list[list[str]] = []
        for t in texts:
            try:
                s = t.decode() if t else ""
            except UnicodeDecodeError:
                s = ""
            cut.append(self.parts(s) if s else [])
        flat = list(chain.from_iterable(cut))
        self.learn(list(set(flat).difference(self.codes)))
        lengths = np.array([len(x) for x in cut], np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), lengths)
        counts = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            counts[:, k] = np.bincount(of, self.sizes[codes, k], len(texts))
        bad = counts[:, 3] > 0
        counts[:, 3] = counts[:, 0] + counts[:, 1] - counts[:, 2]  # each step ends one token, and both where a group closes
        counts[bad] = 0
        groups, begin, known = [], 0, self.groups.__getitem__
        for n, no in zip(lengths.tolist(), bad.tolist()):
            groups.append("" if no else "".join(map(known, codes[begin : begin + n].tolist()))[1:])
            begin += n
        # a part that repeats in a text counts its links so many times
        span = np.int64(len(self.groups))
        keys, often = np.unique((of * span + codes)[~bad[of]], return_counts=True)
        of, codes = keys // span, keys % span
        n = self.starts[codes + 1] - self.starts[codes]
        places = np.arange(n.sum()) + np.repeat(self.starts[codes] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        room = np.int64(len(self.a_bytes) * len(self.b_bytes))
        keys, back = np.unique(np.repeat(of, n) * room + self.pairs[places], return_inverse=True)
        times = np.bincount(back, np.repeat(often, n), len(keys)).astype(np.int64)
        return counts, groups, (keys // room, keys % room, times)


@lru_cache(maxsize=2)
def _aligner(folder: str, byte_level: str, pieces: str) -> Aligner:
    return Aligner(folder, byte_level, pieces)


ROWS = "row long, ident string, groups string, n_a long, n_b long, n_groups long, n_links long, a_id int, b_id int, times long"


def aligned(docs: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Groups and links of every text: a row with `groups` for each document, and one with a_id, b_id, times for each pair of ids that it links.

    A group is the least run of tokens of both sides that cover the same bytes; groups are
    written as a1,a2|b1;a3|b2,b3 in order. Two tokens are linked when their bytes overlap;
    times is how often the document links that pair. Texts are encoded behind one blank and
    without special tokens. Null and empty texts, bytes that are no UTF-8, and texts that
    one of the tokenizers does not give back byte for byte have no tokens: groups is '' and
    all numbers are 0. Texts of any length are taken whole; `row` tells repeated rows and
    ids apart; ident is the id as a string; an empty table gives no rows; other columns are
    not looked at. The tokenizer files stay where they are, on every machine.
    """

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(folder, byte_level, pieces)
        for f in frames:
            texts = f["text"].tolist()
            for lo, hi in batches([len(t or b"") for t in texts], 1 << 21):
                some = f.iloc[lo:hi]
                counts, groups, (of, pairs, times) = aligner.align(texts[lo:hi])
                yield pd.DataFrame({"row": some["row"], "ident": some["ident"], "groups": groups, "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3], "a_id": np.int32(-1), "b_id": np.int32(-1), "times": 0})
                rows, width = some["row"].to_numpy(), len(aligner.b_bytes)
                for at in range(0, len(of), 200_000):
                    cut = slice(at, at + 200_000)
                    yield pd.DataFrame({"row": rows[of[cut]], "ident": None, "groups": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "a_id": (pairs[cut] // width).astype(np.int32), "b_id": (pairs[cut] % width).astype(np.int32), "times": times[cut]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{ident}`").cast("string").alias("ident"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInPandas(align, ROWS)


def pair_counts(links: DataFrame) -> DataFrame:
    """a_id, b_id, count, a_most, b_most: links of each pair of ids in the corpus and the highest count of its a_id and of its b_id."""
    counts = cut_lineage(links.groupBy("a_id", "b_id").agg(F.sum("times").alias("count")))
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(f"{side}_id").agg(F.max("count").alias(f"{side}_most")), f"{side}_id")
    return counts.select("a_id", "b_id", "count", "a_most", "b_most")


def frequent(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` pairs reach, to a power of two; 0 if all pairs are that few."""
    levels = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    if sum(levels.values()) <= most:
        return 0
    level = 63
    while level and sum(n for k, n in levels.items() if k >= level - 1) <= most:
        level -= 1
    return 1 << level


def count_links(links: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """links with the columns of their pair's corpus counts: frequent pairs by a broadcast of at most `most` rows, the others by a shuffle.

    No pair of the shuffled side has more than the frequent ones' least count, so no key of
    it holds more than about 1/most of all links.
    """
    least = frequent(counts, most)
    if not least:
        return links.join(F.broadcast(counts), ["a_id", "b_id"])
    hot, rare = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
    often = links.join(F.broadcast(hot), ["a_id", "b_id"])
    seldom = links.join(F.broadcast(hot.select("a_id", "b_id")), ["a_id", "b_id"], "left_anti").join(rare.hint("shuffle_merge"), ["a_id", "b_id"])
    return often.unionByName(seldom)


def alignment_digest(docs: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, most: int = PAIRS) -> DataFrame:
    """ident, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    n_best counts the links whose pair has the highest corpus count of its b_id, ties
    included; count_sum adds the corpus counts of all links; groups_sha256 is '' where a
    document has no tokens. Cases are those of `aligned`, which runs once: its rows are
    written to the shared folder and read for the counts, then for the join with them.
    """
    kind = docs.select(F.col(f"`{ident}`")).schema[0].dataType
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows, _ = written(aligned(docs, ident, text, folder, byte_level, pieces).withColumn("groups", hashed))
    links = rows.where(F.col("a_id") >= 0).select("row", "a_id", "b_id", "times")
    counts = cut_lineage(pair_counts(links))
    best = F.when(F.col("count") == F.col("b_most"), F.col("times")).otherwise(0)
    sums = count_links(links, counts, most).groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.where(F.col("a_id") < 0).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(F.col("ident").cast(kind).alias(ident), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
