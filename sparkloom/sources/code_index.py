"""A folder of code as versioned cards: which files are read, what they hold, which can't be parsed, and what changed."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.cards import merge_cards, merge_references
from sparkloom.operators.lineage import cut_lineage
from sparkloom.sources import cpp, files
from sparkloom.sources.store import Store

# Folders that hold no code of a project's own.
SKIPPED = """.git .hg .svn __pycache__ .mypy_cache .pytest_cache .tox .venv venv env site-packages node_modules
dist build .eggs .idea .vscode CMakeFiles""".split()

PARSED = "path string, what string, qn string, name string, label string, start long, end long, signature string, body string, target string, error string"


def code_files(spark: SparkSession, root: str, skipped: list[str] = ()) -> DataFrame:
    """path, content of the Python, C and C++ files below root, without those below skipped folders or CMake's build folders.

    A build folder is known by the CMakeCache.txt in it, whatever its name; a file is matched
    to one by equi-joins on the folders above it. Only files with the endings of code are
    opened; Spark's reader passes over files of no bytes.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    built = names.where(F.endswith("path", F.lit("/CMakeCache.txt"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    parts = F.split("path", "/")
    above = names.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    of_builds = above.join(built, "folder", "left_semi").select("path").distinct()
    base_name = "/" + root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    inner = F.split(F.substr("path", F.instr("path", base_name) + len(base_name)), "/")
    own = F.forall(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda d: ~d.isin([*SKIPPED, *skipped]))
    low = F.lower("path")
    ending = low.endswith(".py")
    for e in cpp.EXTENSIONS:
        ending = ending | low.endswith(e)
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    endings = "*{" + ",".join(map(either, (".py", *cpp.EXTENSIONS))) + "}"
    return base.option("pathGlobFilter", endings).load(root).where(ending & own).join(of_builds, "path", "left_anti").select("path", "content")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:32]


def _python(path: str, source: str) -> list[tuple]:
    """Rows of PARSED of a Python source; raises what the parser raises."""
    tree = ast.parse(source)
    lines = source.split("\n")
    heads = {}
    todo: list[tuple[ast.AST, str]] = [(tree, path)]
    for node, owner in todo:  # grows while it is read
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{owner}::{child.name}"
                heads[inner] = f"class({','.join(map(ast.unparse, child.bases))})" if isinstance(child, ast.ClassDef) else f"({ast.unparse(child.args)})->{ast.unparse(child.returns) if child.returns else ''}"
            todo.append((child, inner))
    return _rows(path, source, lines, files.module_symbols(path, source), lambda qn, name, start: f"{name}{heads.get(qn, '')}")


def _cpp(path: str, source: str) -> list[tuple]:
    lines = source.split("\n")

    def head(qn: str, name: str, start: int) -> str:
        text = "\n".join(lines[start - 1 : start + 20])
        return " ".join(re.split(r"[{;]", text, maxsplit=1)[0].split())

    return _rows(path, source, lines, cpp.module_symbols(path, source), head)


def _rows(path: str, source: str, lines: list[str], symbols: list[tuple], head) -> list[tuple]:
    out = []
    for kind, src, dst, label, start, end in symbols:
        if kind == "card":
            body = source if label == "module" else "\n".join(lines[start - 1 : end])
            out.append((path, "card", src, dst, label, start, end, _hash(label if label == "module" else head(src, dst, start)), _hash(body), None, None))
        else:
            out.append((path, kind, src, None, None, None, None, None, None, dst, None))
    return out


def parsed(sources: DataFrame) -> DataFrame:
    """Rows of PARSED of (path, content): cards, what they contain, call, extend and import, and files that can't be parsed, with the reason.

    A file is one row of input and is parsed by one task. Null contents and contents that
    are no UTF-8 are failures; an empty file is a module.
    """
    names = [c.split()[0] for c in PARSED.split(", ")]

    def one(path: str, content: bytes | None) -> list[tuple]:
        try:
            if content is None:
                raise ValueError("no content")
            source = content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
            return _python(path, source) if path.lower().endswith(".py") else _cpp(path, source)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [(path, "failure", *[None] * 8, f"{type(e).__name__}: {str(e)[:200]}")]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for lo in range(0, len(t), 64):
                some = t.iloc[lo : lo + 64]
                rows = [r for p, c in zip(some["path"], some["content"], strict=True) for r in one(p or "", c)]
                yield pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64"})

    return sources.select("path", "content").mapInPandas(run, PARSED)


def index_files(store: Store, sources: DataFrame, at: float) -> DataFrame:
    """Merge the cards and references of a batch of files (path, content); what, name, detail of all that happened.

    what is new, supersedes, continues or removed (of symbols; detail is the version that
    opens), or failure (of files; detail is the reason). Files that fail keep the cards that
    they had.
    """
    rows = cut_lineage(parsed(sources))
    good = rows.where("what = 'card' AND label = 'module'").select(F.col("path").alias("file"))
    facts = F.to_json(F.struct("name", "label", "start", "end"))
    fresh = rows.where("what = 'card'").select("qn", F.col("path").alias("file"), "signature", "body", facts.alias("facts"))
    changes = merge_cards(store, good, fresh, at)
    links = rows.where(F.col("what").isin("calls", "implements", "imports"))
    refs = links.select(F.col("path").alias("file"), F.xxhash64("qn", "what", "target").alias("ref"), F.col("target").alias("name"), F.col("what").alias("kind")).distinct()
    merge_references(store, good, refs, changes)
    happened = changes.where("change <> 'none'").select(F.col("change").alias("what"), F.col("qn").alias("name"), F.col("version").cast("string").alias("detail"))
    return happened.unionByName(rows.where("what = 'failure'").select("what", F.col("path").alias("name"), F.col("error").alias("detail")))


def index_directory(store: Store, root: str, at: float, skipped: list[str] = ()) -> DataFrame:
    """index_files of all code below a folder."""
    return index_files(store, code_files(store.spark, root, skipped), at)
