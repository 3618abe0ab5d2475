"""URL filters: a trie over reversed host labels and path segments with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many rules the trie is not broadcast; an equi-join on host suffixes decides instead.
TRIE_RULES = 200_000


class Rule(NamedTuple):
    """verdict is 'allow' or 'block'; path starts with '/'."""

    verdict: str
    host: str
    path: str


def parse_rule(verdict: str, text: str) -> Rule:
    """'example.org/es/' -> host example.org, path /es/; a rule without '/' covers the whole host."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, ascii_lower(host), slash + rest)


def ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Trie:
    """Host labels from the right, then path segments; a rule's last, open segment is a prefix.

    Each node is [children, rules that end here as {open segment: (verdict, rule)}, lengths
    of the open segments, longest first]. Path segments hang off the host node under keys
    that start with '/', which no label does.
    Of the rules that fit, the one with the longest host wins, then the longest path;
    of two verdicts for the same host and path, block wins.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, {}, []]
        for verdict, host, path in rules:
            node = self.root
            segments = path.split("/")[1:] if path else None
            for key in [*reversed(host.split(".")), *("/" + s for s in (segments or [""])[:-1])]:
                node = node[0].setdefault(key, [{}, {}, []])
            last = "/" + segments[-1] if segments is not None else ""
            if node[1].get(last, ("",))[0] != "block":
                node[1][last] = (verdict, host + path)
            if last and len(last) not in node[2]:
                node[2].append(len(last))
                node[2].sort(reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")[1:] if path.startswith("/") else []
        for node in reversed(nodes):
            best = node[1].get("")
            for i, segment in enumerate(segments):
                fit = next((f for n in node[2] if n <= len(segment) + 1 and (f := node[1].get(("/" + segment)[:n]))), None)
                best = fit or best
                node = node[0].get("/" + segment) if i < len(segments) - 1 else None
                if node is None:
                    break
            if best:
                return best
        return None


def url_host(url: Column) -> Column:
    """Between the first '://' and '/', '?', '#' or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """urls plus host, path, rule and verdict; extra columns named so are replaced.

    Null urls and urls without '://' have empty host and path, no rule and the default
    verdict. Rows are judged one by one, so repeated rows stay repeated and an empty
    table stays empty. Rules beyond TRIE_RULES are matched by an equi-join on the host's
    suffixes instead of the broadcast trie, with the same precedence.
    """
    bare = urls.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else urls
    parsed = bare.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if len(rules) > TRIE_RULES:
        return _judge_by_join(parsed, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))
    schema = parsed.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for name in ("rule", "verdict"):
        schema[name].nullable = True

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[str, str] | None] = {}
        for t in tables:
            found = []
            for key in zip(t.column("host").to_pylist(), t.column("path").to_pylist(), strict=True):
                if key not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[key] = trie.value.find(*key)
                found.append(known[key])
            rule = pa.array([f and f[1] for f in found], pa.string())
            verdict = pa.array([f[0] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*t.columns, rule, verdict], names=[*t.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(judge, schema)


def _judge_by_join(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same decision without a trie: suffix keys joined to the rules, longest fit by max_by."""
    spark = parsed.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "r_host string, r_path string, r_verdict string")
    table = table.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = parsed.select("host", "path").distinct()
    fits = pairs.select("host", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host").where(F.expr("startswith(path, r_path)"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), F.struct(F.length("r_host"), F.length("r_path"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(*parsed.columns, F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
