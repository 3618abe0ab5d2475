"""Token counts by offset-mapped attribution: whole documents are encoded once, token spans meet sections."""

from __future__ import annotations

import base64
import importlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: How a token that crosses a boundary counts: for the section of its first byte, for the
#: section that has most of its bytes (ties to the earlier), or for each by its share.
RULES = ("first", "most", "share")
#: What the tokenizer's pattern can't take in one go: long white space, on which it would
#: backtrack without end, and bytes that are no UTF-8 (as lone surrogates).
_APART = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}|[\udc80-\udcff]+")


@lru_cache(maxsize=4)
def _encoder(folder: str, ranks_file: str):
    """(encoder, byte length of each token id) of a public rank file; the files stay where they are."""
    import tiktoken

    pattern = getattr(importlib.import_module("public_tokenizers"), "PATTERN")
    with open(os.path.join(folder, ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding(ranks_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(encoder, text: bytes) -> np.ndarray:
    """Token ids of a text of any content.

    The pattern makes one piece of white space but its last character, which goes with what
    follows, so long white space is encoded as that piece. Bytes that are no UTF-8 are pieces
    of their own; the vocabulary has all 256.
    """
    s, ids, at = text.decode("utf-8", "surrogateescape"), [], 0
    for m in _APART.finditer(s):
        white = not "\udc80" <= m[0][0] <= "\udcff"
        end = m.end() - 1 if white and m.end() < len(s) else m.end()
        if m.start() > at:
            ids.append(encoder.encode_ordinary(s[at : m.start()]))
        ids.append(encoder._encode_single_piece(s[m.start() : end].encode("utf-8", "surrogateescape")))
        at = end
    if at < len(s):
        ids.append(encoder.encode_ordinary(s[at:]))
    return np.array([i for part in ids for i in part], np.int64)


def line_sections(text: bytes) -> np.ndarray:
    """Section ends of a text cut behind each line feed; an empty text has none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] != len(text)) else ends


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section, from sorted token ends and section ends that tile the same bytes."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    counts = np.zeros(len(section_ends))
    inside = first == last if rule != "first" else np.ones(len(first), bool)
    counts += np.bincount(first[inside], minlength=len(section_ends))
    for i in np.flatnonzero(~inside):
        bounds = np.concatenate(([starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]))
        parts = np.diff(bounds)
        if rule == "most":
            counts[first[i] + int(parts.argmax())] += 1
        else:
            counts[first[i] : last[i] + 1] += parts / parts.sum()
    return counts


def count_tokens(docs: DataFrame, rule: str = "most", folder: str = TOKENIZERS, ranks_file: str = RANKS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section, start, end (bytes of the UTF-8 text), tokens of each line of each text.

    A section is a line with its line feed. Texts are encoded whole, so counts of a
    document's sections sum to its token count whatever the rule; under 'share' they are
    fractions. Null and empty texts give no rows; null ids are kept; repeated rows are
    counted each; an empty table gives no rows; extra columns are ignored. Texts of any length are
    taken whole, long white space and bytes that are no UTF-8 included: starts and ends tile
    the text's bytes. Ids must be whole numbers.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(folder, ranks_file)
        for t in tables:
            ids, texts = t.column(0), t.column(1)
            rows, ends, counts, n_sections = [], [], [], []
            for i in range(len(texts)):
                s = texts[i].as_py()
                if not s:
                    continue
                tokens = encode(encoder, s)
                section_ends = line_sections(s)
                rows.append(i)
                ends.append(section_ends)
                counts.append(attribute(np.cumsum(lengths[tokens]), section_ends, rule))
                n_sections.append(len(section_ends))
            if not rows:
                continue
            repeat = np.repeat(rows, n_sections)
            section = np.concatenate([np.arange(n) for n in n_sections])
            starts = np.concatenate([np.concatenate(([0], e[:-1])) for e in ends])
            arrays = [ids.take(pa.array(repeat)), pa.array(section, pa.int32()), pa.array(starts, pa.int64()), pa.array(np.concatenate(ends), pa.int64()), pa.array(np.concatenate(counts), pa.float64())]
            for a in range(0, len(repeat), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(a, 50_000) for x in arrays], names=["doc_id", "section", "start", "end", "tokens"])

    return docs.select(id_col, F.col(text).cast("binary")).mapInArrow(count, "doc_id long, section int, start long, end long, tokens double")
