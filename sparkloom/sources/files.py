"""Folder scans: which files are read, and their text. Only files that the path filter admits are opened."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.functions.markdown import markdown, table_markdown
from sparkloom.sources.office import legacy_text

# Folders, names and extensions that the intake knows.
EXCLUDED_DIRS = """.git .hg .svn .idea .vscode __pycache__ .ipynb_checkpoints node_modules .venv venv env
.tox .mypy_cache .pytest_cache .ruff_cache site-packages dist build target .next .nuxt coverage
_snapshot_run models traces runs raw out outputs logs log checkpoints ckpt wandb mlruns artifacts
cache tmp temp vendor third_party llama.cpp""".split()
INCLUDED = """.md .markdown .mdx .rst .txt .org .adoc .tex .py .cpp .hpp .cc .c .h .cu .rs .go .java .kt
.ts .tsx .js .jsx .cs .swift .rb .php .lua .yaml .yml .toml .ini .cfg .sh .bat .ps1 .docx .doc""".split()
EXCLUDED_NAMES = "code_dump.txt .env poetry.lock package-lock.json yarn.lock pnpm-lock.yaml cargo.lock uv.lock".split()
EXCLUDED_ENDS = ".min.js .lock .orig .incomplete .map".split()
LEAST_BYTES, MOST_BYTES = 24, 1_200_000
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def dir_ok(name: Column, excluded: list[str] = ()) -> Column:
    low = F.lower(name)
    return ~low.isin([*EXCLUDED_DIRS, *(d.lower() for d in excluded)]) & ~low.startswith(".")


def file_ok(name: Column, length: Column, included: list[str] | None = None) -> Column:
    low = F.lower(name)
    ends = F.lit(False)
    for e in EXCLUDED_ENDS:
        ends = ends | low.endswith(e)
    # A leading dot starts no extension.
    extension = F.regexp_extract(low, r"[^.].*?(\.[^.]*)$", 1)
    return ~low.isin(EXCLUDED_NAMES) & ~ends & extension.isin(included or INCLUDED) & length.between(LEAST_BYTES, MOST_BYTES)


def path_ok(path: Column, length: Column, root: str, store: str | None = None, excluded: list[str] = (), included: list[str] | None = None) -> Column:
    """Is the file below root, outside the store, in admitted folders only, and admitted itself; false for a null path."""
    root = root.rstrip("/") + "/"
    parts = F.split(F.substr(path, F.lit(len(root) + 1)), "/")
    ok = path.startswith(root) & F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: dir_ok(d, excluded)) & file_ok(F.element_at(parts, -1), length, included)
    if store:
        ok = ok & ~path.startswith(store.rstrip("/") + "/")
    return F.coalesce(ok, F.lit(False))


def file_kind(path: Column) -> Column:
    """py, chat (JSON and its line formats) or text, by extension."""
    low = F.lower(path)
    return F.when(low.endswith(".py"), "py").when(low.endswith(".json") | low.endswith(".jsonl") | low.endswith(".ndjson"), "chat").otherwise("text")


def looks_binary(content: Column) -> Column:
    """A NUL byte among the first 8192; null content counts as binary."""
    head = F.hex(F.substring(content, 1, 8192))
    return F.coalesce(head.rlike("^(..)*?00"), F.lit(True))


def folder_files(spark: SparkSession, root: str, store: str | None = None, **rules) -> DataFrame:
    """path, modificationTime, length, content of each admitted file below root (a path or URI as Spark lists it).

    Paths and lengths are listed and filtered first, without content; the driver then names
    the admitted paths to a second read, as Spark's own listing holds all paths there.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    plain = lambda p: p if p is None or ":" not in p else p.split(":", 1)[1].replace("//", "", 1) if p.startswith("file:") else p
    path = F.regexp_replace("path", "^file:/*", "/")
    named = listed.where(path_ok(path, F.col("length"), plain(root), plain(store), **rules))
    literal = F.regexp_replace("path", r"([\[\]{}*?\\\\])", r"\\$1")  # a path is no pattern
    paths = sorted(r[0] for r in named.select(literal).collect())
    if not paths:
        return spark.read.format("binaryFile").load(root).limit(0)
    return spark.read.format("binaryFile").load(paths)


def first_of_equal_content(files: DataFrame) -> DataFrame:
    """The file of least path of each content; the digest alone is shuffled. Null contents all stay."""
    digested = files.withColumn("_digest", F.sha2("content", 256))
    first = digested.groupBy("_digest").agg(F.min("path").alias("path")).where("_digest IS NOT NULL").select("path")
    return files.join(first, "path", "left_semi").unionByName(files.where("content IS NULL"))


# ---------------------------------------------------------------- text of files


def decoded(content: bytes | None) -> str | None:
    if content is None:
        return None
    for encoding in ("utf-8-sig", "cp1251", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def docx_paragraphs(content: bytes | None) -> str:
    """The paragraphs of a word-processing package, a line each; what is no such package has no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    lines = ("".join(t.text or "" for t in p.iter(f"{W_NS}t")) for p in body.iter(f"{W_NS}p"))
    return "\n".join(line for line in lines if line.strip())


def python_notes(source: str | None) -> str:
    """Docstrings, module first, then comments; source that does not parse has none."""
    try:
        tree = ast.parse(source or "")
        tokens = list(tokenize.generate_tokens(io.StringIO(source or "").readline))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return ""
    documented = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    notes = [d for n in ast.walk(tree) if isinstance(n, documented) and (d := ast.get_docstring(n))]
    notes += [c for t in tokens if t.type == tokenize.COMMENT and (c := t.string.lstrip("#").strip())]
    return "\n\n".join(notes)


def file_texts(files: DataFrame) -> DataFrame:
    """path, text of each file (path, content) with LF line ends; binaries have ''.

    HTML and comma-separated tables become Markdown, word-processing packages and legacy
    files their paragraphs, Python files their notes; other text stays as it is.
    """

    def text(path: str | None, content: bytes | None) -> str:
        low = (path or "").lower()
        if low.endswith(".docx"):
            return docx_paragraphs(content)
        if low.endswith(".doc"):
            return legacy_text(content)
        if content is None or b"\0" in content[:8192]:
            return ""
        plain = decoded(content).replace("\r\n", "\n").replace("\r", "\n")
        if low.endswith((".html", ".htm", ".xhtml")):
            return markdown(plain)
        if low.endswith(".csv"):
            return table_markdown(plain)
        return python_notes(plain) if low.endswith(".py") else plain

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            yield pd.DataFrame({"path": t["path"], "text": [text(p, c) for p, c in zip(t["path"], t["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


# ---------------------------------------------------------------- code


def module_symbols(path: str, source: str | None) -> list[tuple]:
    """(kind, src, dst, label, start, end): a card of each module, class and function, and what each contains, calls, implements and imports by name."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = [("card", path, path, "module", 1, (source or "").count("\n") + 1)]
    todo: list[tuple[ast.AST, str]] = [(tree, path)]
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{owner}::{child.name}"
                label = "class" if isinstance(child, ast.ClassDef) else "function"
                out += [("card", inner, child.name, label, child.lineno, child.end_lineno), ("contains", owner, inner, None, None, None)]
                if label == "class":
                    out += [("implements", inner, ast.unparse(b), None, None, None) for b in child.bases]
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                out.append(("calls", owner, ast.unparse(child.func), None, None, None))
            elif isinstance(child, ast.Import):
                out += [("imports", owner, a.name, None, None, None) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out += [("imports", owner, f"{'.' * child.level}{child.module or ''}:{a.name}", None, None, None) for a in child.names]
            todo.append((child, inner))
    return out


def _complexity(source: str | None) -> list[tuple[str, int]]:
    """(dotted name, 1 + branching constructs inside) of each function of a source."""
    branching = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.BoolOp, ast.ExceptHandler)
    try:
        todo: list[tuple[ast.AST, str]] = [(ast.parse(source or ""), "")]
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node, owner in todo:  # grows while it is read
        for child in ast.iter_child_nodes(node):
            name = f"{owner}.{child.name}".lstrip(".") if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((name, 1 + sum(isinstance(x, branching) for x in ast.walk(child))))
            todo.append((child, name))
    return out


def complexities(texts: DataFrame) -> DataFrame:
    """path, name, complexity of each function of each Python source (path, source)."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            yield pd.DataFrame([(p, *r) for p, s in zip(t["path"], t["source"], strict=True) for r in _complexity(s)], columns=["path", "name", "complexity"])

    return texts.select("path", "source").mapInPandas(run, "path string, name string, complexity int")


@F.pandas_udf(StringType())
def normal_digest(texts: pd.Series) -> pd.Series:
    """32 hex digits of a text's BLAKE2b that line ends and white space at the end of lines and of the text don't change; null for null."""

    def one(text: str | None) -> str | None:
        lines = [line.rstrip() for line in re.split(r"\r\n|\r|\n", text)] if text is not None else []
        while lines and not lines[-1]:
            lines.pop()
        return None if text is None else hashlib.blake2b("\n".join(lines).encode("utf-8", "replace"), digest_size=16).hexdigest()

    return texts.map(one)


def python_symbols(texts: DataFrame) -> DataFrame:
    """kind, src, dst, label, start, end of each Python source (path, source); what does not parse gives no rows."""
    names = ["kind", "src", "dst", "label", "start", "end"]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            rows = [r for p, s in zip(t["path"], t["source"], strict=True) for r in module_symbols(p or "", s)]
            yield pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64"})

    return texts.select("path", "source").mapInPandas(run, "kind string, src string, dst string, label string, start long, end long")
