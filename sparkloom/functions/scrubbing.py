"""Secrets cut out of texts: values by format, all their occurrences, widened, merged and replaced."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

MARK = "<secret>"
# vendors' key formats, and private keys as whole blocks.
VENDOR = re.compile(
    r"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|uak_[A-Za-z0-9_-]{16,}|ak_[A-Za-z0-9_-]{20,}|ck_[A-Za-z0-9_-]{16,})"
    r"|(?s:-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)"
)
#: Own definition, in place of a third-party library: public token formats and quoted or bare values of telling names.
PROVIDERS = tuple(
    re.compile(p)
    for p in (
        r"\b(gh[pousr])_[A-Za-z0-9]{20,}",
        r"\b(glpat-[A-Za-z0-9_-]{20,})",
        r"\b(xox[abprs]-[A-Za-z0-9-]{10,})",
        r"\b(A(?:KIA|SIA)[0-9A-Z]{16})\b",
        r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)",
        r"\b((?:sk|rk)_live_[0-9A-Za-z]{24,})",
        r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})",
        r"\b(npm_[A-Za-z0-9]{36})",
        r"://[^\s:/@]+:([^\s:/@]{3,})@",
        r"(?i)(?:password|passwd|pwd|secret|api_?key|private_?key|access_?token|auth_?token)[\w-]*[\"']?\s*(?::=|=>|[:=])\s*[\"']([^\"'\s]{6,})[\"']",
    )
)


def vendor_values(text: str) -> list[str]:
    return VENDOR.findall(text)


def provider_values(text: str) -> list[str]:
    """What the providers' patterns find line by line, without repeats, sorted."""
    return sorted({m.group(1) for line in text.splitlines() for p in PROVIDERS for m in p.finditer(line)})


def starts(text: str, value: str) -> Iterator[int]:
    """Where value occurs, overlapping occurrences too."""
    at = text.find(value)
    while value and at >= 0:
        yield at
        at = text.find(value, at + 1)


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """The span grown over ASCII letters, digits, _ and - on both sides."""
    left = re.search(r"[A-Za-z0-9_-]*\Z", text[:start])
    right = re.match(r"[A-Za-z0-9_-]*", text[end:])
    return start - len(left.group()), end + len(right.group())


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    pieces, at = [], 0
    for a, b in spans:
        pieces += [text[at:a], MARK]
        at = b
    return "".join([*pieces, text[at:]])


def scrub_text(text: str) -> tuple[str, int]:
    """The text without secrets, and how many merged spans were replaced."""
    values = {v for v in (*provider_values(text), *vendor_values(text)) if v and v != MARK}
    spans = merged(widened(text, i, i + len(v)) for v in values for i in starts(text, v))
    return redacted(text, spans), len(spans)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("found", IntegerType())]))
def _scrub(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, 0) if t is None else scrub_text(t) for t in texts], columns=["text", "found"])


def scrub(text: Column) -> Column:
    """struct<text, found>; null text stays null with nothing found."""
    return _scrub(text)


def note_text(text: Column, least: int = 8) -> Column:
    """A scrubbed, trimmed note; empty if shorter than `least`."""
    clean = scrub(F.regexp_replace(text, r"^\s+|\s+$", ""))["text"]
    return F.when(F.length(clean) >= least, clean).otherwise(F.lit(""))


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: per key, spans (start, end) that overlap or touch become one; by gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def scrub_drafts(drafts: DataFrame, columns: tuple[str, ...] = ("text", "question", "answer")) -> DataFrame:
    """drafts with these columns scrubbed, plus found, the sum over them."""
    done = drafts.withColumns({f"_s_{c}": scrub(F.col(c)) for c in columns})
    found = sum((F.col(f"_s_{c}.found") for c in columns), F.lit(0))
    return done.withColumns({"found": found, **{c: F.col(f"_s_{c}.text") for c in columns}}).drop(*(f"_s_{c}" for c in columns))
