"""Column functions over text, paths, times and budgets; all stay on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public token formats that count as secrets, and private keys as whole blocks.
SECRET_FORMATS = (
    r"uak_[A-Za-z0-9_\-]{16,}",
    r"ak_[A-Za-z0-9_\-]{20,}",
    r"ck_[A-Za-z0-9_\-]{16,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    r"AIza[A-Za-z0-9_\-]{30,}",
    r"hf_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
)
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
#: A word character: a letter, a digit or the underscore, in any script.
WORD_CHARS = r"[\p{L}\p{N}_]+"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words in order, in any script; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD_CHARS), F.lit(0)), F.array().cast("array<string>"))


def has_words(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}_]")


def squash(text: Column) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\u000B\u0085]+", " "))


def digest(text: Column) -> Column:
    """Identity of a text up to white space."""
    return F.md5(squash(text))


def clip(text: Column, limit: int) -> Column:
    """At most limit characters, else cut, right-trimmed and marked by an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit(" …")))


def normalized(text: Column) -> Column:
    """LF line ends, no blanks at line ends, no empty lines at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", ""), r"\n+$", "")


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def scrubbed(text: Column) -> Column:
    """struct<text, found>: each secret becomes <secret-removed:head>; found counts them.

    The head is what stands before an underscore among the first eight characters, else the
    first four; a private key's head is private-key.
    """
    secret = "(?:" + "|".join(SECRET_FORMATS) + ")"
    headed = rf"\b(?=([^_]{{1,7}}(?=_)|.{{4}})){secret}\b"
    once = F.regexp_replace(text, headed, "<secret-removed:$1>")
    found = F.regexp_count(text, F.lit(rf"\b{secret}\b")) + F.regexp_count(once, F.lit(PRIVATE_KEY))
    return F.struct(F.regexp_replace(once, PRIVATE_KEY, "<secret-removed:private-key>").alias("text"), found.alias("found"))


def path_chain(path: Column) -> Column:
    """Every prefix of a slash-separated path, shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def relative(path: Column, root: str) -> Column:
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(inside)), F.substring(path, len(inside) + 1, 1 << 30)).otherwise(path)


def day(epoch: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"), F.lit("?"))


def temporal_affinity(a: Column, b: Column, half_life_days: float) -> Column:
    """Halves with every half life between two epoch times."""
    return F.pow(F.lit(0.5), F.abs(a - b) / 86400 / half_life_days)


def item_limit(budget: Column, head: Column, count: Column) -> Column:
    """Characters of one item: an even share less 120, at least 300."""
    return F.greatest(F.lit(300), F.floor((budget - head) / count).cast("int") - 120)


def degree_budget(n: Column, margin: float = 5.0, least: int = 2) -> Column:
    """Links that a node of a graph of n may have; `least` for two nodes or fewer."""
    return F.when(n <= 2, F.lit(least)).otherwise(F.greatest(F.lit(2), F.ceil(F.lit(margin) * F.ln(n)).cast("int")))


def next_budget_in(n: Column, margin: float = 3.0) -> Column:
    """Nodes that a graph of n must gain before its degree budget (least 1) grows."""
    n = F.greatest(n, F.lit(2)).cast("long")
    budget = lambda x: degree_budget(x, margin, 1)
    guess = F.floor(F.exp(budget(n) / F.lit(margin)))  # rounding may be off by one: the first step near it that rises
    near = F.transform(F.sequence(F.lit(-2), F.lit(3)), lambda i: F.greatest(guess + i, n + 1))
    return F.array_min(F.filter(near, lambda x: budget(x) > budget(n))) - n


def traversal_depth(n: Column, mean_degree: Column) -> Column:
    """Steps after which a random graph of that mean degree is reached."""
    return F.when((n <= 1) | (mean_degree <= 1), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.ln(n) / F.ln(mean_degree)).cast("int")))


def isolated_expected(n: int, mean_degree: float) -> float:
    return n * math.exp(-mean_degree)


# ---------------------------------------------------------------- loose values


def number(x: Column) -> Column:
    """A non-negative finite number, from text too, else 0."""
    v = x.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")), v).otherwise(F.lit(0.0))


def plain(x: Column) -> Column:
    """Text; missing or 'None' is empty."""
    return F.coalesce(F.nullif(x, F.lit("None")), F.lit(""))


def epoch(x: Column, millis: Column | None = None) -> Column:
    """Seconds of a number (thousandths beyond 1e12, or where millis), of its text, or of an ISO time; else null."""
    text = F.trim(x.cast("string"))
    v = text.try_cast("double")
    big = v > 1e12 if millis is None else millis | (v > 1e12)
    return F.coalesce(F.when(big, v / 1000).otherwise(v), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def mojibake_fixed(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read right; any other text as it is."""
    latin = ~x.rlike(r"[^\x00-\xFF]")
    raw = F.unhex(F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == "", F.lit("")).otherwise(F.lpad(F.hex(F.ascii(c)), 2, "0"))), ""))
    return F.when(latin & F.is_valid_utf8(raw.cast("string")) & (x != ""), raw.cast("string")).otherwise(x)


def atom_key(text: Column, source: Column) -> Column:
    """Identity of a text up to white space within a source."""
    return F.sha1(F.concat(F.sha1(squash(text)), F.lit("\0"), source))


def has_marker(text: Column, markers: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.instr(low, m) > 0) if markers else F.lit(False)


def metadata_affinity(folder_a: Column, folder_b: Column, session_a: Column, session_b: Column) -> Column:
    """0.6 for one folder and 0.4 for one session, empty ones aside."""
    same = lambda a, b, w: F.when((a == b) & (a != ""), F.lit(w)).otherwise(F.lit(0.0))
    return same(folder_a, folder_b, 0.6) + same(session_a, session_b, 0.4)


def space_parts(spec: Column) -> Column:
    """struct<name, provider, model, dim> of name=provider:model@dim; null if it is none."""
    pattern = r"^([a-z0-9_]+)=([a-z0-9-]+):(.+)@([1-9][0-9]*)$"
    part = lambda i: F.regexp_extract(spec, pattern, i)
    return F.when(spec.rlike(pattern), F.struct(part(1).alias("name"), part(2).alias("provider"), part(3).alias("model"), part(4).cast("int").alias("dim")))
