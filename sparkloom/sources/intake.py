"""Which files the intake takes: ignore patterns, sizes, foreign licences, equal contents; with a reason for the rest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.files import looks_binary

# Texts of licences and of other holders' rights, and reasons.
LICENSE = r"(?i)(licensed under the apache license|mit license|bsd \d-clause|gnu general public license|mozilla public license|spdx-license-identifier)"
COPYRIGHT = r"(?i)copyright\s*(\(c\)|©)?\s*\d{4}[^\n]{0,80}?(inc\.|llc|ltd|gmbh|corporation|foundation|university|institute)"
EXCLUDED, TOO_BIG, NOT_INCLUDED = "excluded", "too big", "not included"


def _glob(text: str) -> str:
    """A regular expression of one pattern without its leading and trailing slash; an unclosed or empty range is an error."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text[i:] == "**" and (i == 0 or text[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            i = re.compile(r"\*+").match(text, i).end()
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = text.index("]", i + 2 if text[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
            body = text[i + 1 : end]
            body = "^" + body[1:] if body[:1] in ("!", "^") else body
            out, i = out + f"[{body.replace(chr(92), chr(92) * 2)}]", end + 1
        elif c == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def compiled(pattern: str) -> tuple[bool, str] | None:
    """(takes back, regular expression of matching paths); None for a blank, a comment or a broken pattern."""
    text = re.sub(r"(?<!\\) +$", "", pattern)
    negated = text.startswith("!")
    text = text[negated:]
    if not text.strip("/") or text.startswith("#"):
        return None
    folder, body = text.endswith("/"), text.rstrip("/")
    anchored = "/" in body
    try:
        regex = ("^" if anchored else "^(?:.*/)?") + _glob(body.removeprefix("/")) + ("/.+$" if folder else "(?:/.*)?$")
        re.compile(regex)
    except (ValueError, re.error):
        return None
    return negated, regex


def matches(path: Column, patterns: list[str]) -> Column:
    """Does a path fall under ignore patterns: the last that fits decides, '!' takes back; broken ones don't count."""
    plain = F.translate(path, "\\", "/")
    out = F.lit(False)
    for negated, regex in filter(None, map(compiled, patterns)):
        out = F.when(plain.rlike(regex), F.lit(not negated)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def admission(path: Column, size: Column, include: list[str], exclude: list[str], most: int) -> Column:
    """Empty for a file that is taken, else why not, the first reason of: excluded, too big, not included."""
    why = F.when(matches(path, exclude), F.lit(EXCLUDED)).when(size > most, F.lit(TOO_BIG))
    return (why.when(~matches(path, include), F.lit(NOT_INCLUDED)) if include else why).otherwise(F.lit(""))


def looks_foreign(text: Column, marks: list[str]) -> Column:
    """A licence or another holder's right in the first 4000 characters, and none of the project's marks."""
    head = F.left(text, F.lit(4000))
    own = F.lit(False)
    for m in marks:
        own = own | (F.instr(F.lower(head), m) > 0)
    return (head.rlike(LICENSE) | head.rlike(COPYRIGHT)) & ~own


def scanned(files: DataFrame, reason: Column, marks: list[str], dedup: bool = True) -> DataFrame:
    """path, reason ('' for taken files) of files (path, content): a reason by name first, then binary, foreign, duplicate.

    A duplicate is any file but the first by path of equal content that is otherwise taken;
    only digests are shuffled.
    """
    why = F.when(reason != "", reason).when(looks_binary(F.col("content")), F.lit("binary")).when(looks_foreign(F.try_validate_utf8(F.col("content").cast("string")), marks), F.lit("foreign")).otherwise(F.lit(""))
    judged = files.select("path", why.alias("reason"), F.sha2("content", 256).alias("_digest"))
    if not dedup:
        return judged.select("path", "reason")
    first = judged.where("reason = ''").groupBy("_digest").agg(F.min("path").alias("_first"))
    return judged.join(first, "_digest", "left").select("path", F.when((F.col("reason") == "") & (F.col("path") != F.col("_first")), F.lit("duplicate")).otherwise(F.col("reason")).alias("reason"))


def reasons(scan: DataFrame) -> DataFrame:
    return scan.groupBy("reason").agg(F.count("*").alias("n"))
