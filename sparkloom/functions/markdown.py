"""HTML as Markdown: open elements collect what is written inside them and hand it on, rewritten, when they close."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.html import RAW, OpenElements, attributes, tokens

BULLETS = "*+-"
#: Elements whose text is no text of the page.
SKIPPED = (RAW - {"textarea"}) | {"head", "template"}
_STRONG, _EMPHASIS, _CODE, _STRUCK = frozenset(("b", "strong")), frozenset(("em", "i")), frozenset(("code", "kbd", "samp")), frozenset(("del", "s"))
_PARAGRAPHS = frozenset("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form header hgroup legend main menu nav p search section summary".split())
_CELLS, _LISTS = frozenset(("td", "th")), frozenset(("ul", "ol", "menu", "dir"))
_EDGES = re.compile(r"(\s*)(.*?)(\s*)", re.S)


class _Frame:
    """What an open element has collected, and what its kind needs to know of its children."""

    __slots__ = ("name", "values", "parts", "items", "rows", "header")

    def __init__(self, name: str, written: str) -> None:
        self.name, self.values = name, attributes(written) if written else {}
        self.parts: list[str] = []
        self.items = 0  # of a list
        self.rows: list[list[str]] = []  # of a table
        self.header = False  # does a row consist of header cells


def _wrapped(text: str, mark: str) -> str:
    """text between marks, with the white space at its ends outside; nothing around nothing."""
    before, inner, after = _EDGES.fullmatch(text).groups()
    return f"{before}{mark}{inner}{mark}{after}" if inner else before + after


def _address(href: str) -> str | None:
    """A link's address with its path percent-encoded; None for schemes that no reader follows."""
    try:
        parts = urlparse(href)
    except ValueError:
        return None
    if parts.scheme and parts.scheme.lower() not in ("http", "https", "file"):
        return None
    return urlunparse(parts._replace(path=quote(unquote(parts.path))))


class Writer:
    """Takes a page's tokens in order; `text` is the Markdown at the end."""

    def __init__(self) -> None:
        self.frames = [_Frame("", "")]
        self.opened = OpenElements(self._closed)
        self.skipping = self.verbatim = self.lists = 0

    # ------------------------------------------------------------ tokens

    def write(self, value: str) -> None:
        if self.skipping:
            return
        if not self.verbatim:
            value = re.sub(r"\s+", " ", value).replace("*", r"\*").replace("_", r"\_")
        self.frames[-1].parts.append(value)

    def open(self, name: str, written: str) -> None:
        if name in ("body", "main", "div", "p", "article") and self.skipping == 1 and self.opened.stack and self.opened.stack[-1][0] == "head":
            self.opened.close("head")  # a head without its end tag
        if self.opened.open(name, written):
            self.frames.append(_Frame(name, written))
            self.skipping += name in SKIPPED
            self.verbatim += name == "pre"
            if name in _LISTS:
                self.lists += 1
        elif not self.skipping:
            self._void(name, written)

    def close(self, name: str) -> None:
        if not self.opened.close(name) and name == "p" and not self.skipping:
            self.frames[-1].parts.append("\n\n")

    def _void(self, name: str, written: str) -> None:
        given, into = attributes(written), self.frames[-1].parts
        if name == "br":
            into.append(" " if self._within(_CELLS | {"h1", "h2", "h3", "h4", "h5", "h6"}) else "  \n")
        elif name == "hr":
            into.append("\n\n---\n\n")
        elif name == "img":
            source = given.get("src") or given.get("data-src") or ""
            source = source.split(",")[0] + "..." if source.startswith("data:") else source
            title = f' "{given["title"]}"'.replace('\\"', '"') if given.get("title") else ""
            into.append(f"![{given.get('alt', '').replace(chr(10), ' ')}]({source}{title})")
        elif name == "input" and given.get("type", "").lower() == "checkbox":
            into.append("[x] " if "checked" in given else "[ ] ")

    def _within(self, names: frozenset[str] | set[str]) -> bool:
        return any(self.opened.many[n] for n in names)

    # ------------------------------------------------------------ elements that end

    def _closed(self, name: str) -> None:
        frame = self.frames.pop()
        if name in SKIPPED:
            self.skipping -= 1
            return
        if name == "pre":
            self.verbatim -= 1
        if name in _LISTS:
            self.lists -= 1
        into = self.frames[-1]
        text = "".join(frame.parts)
        if name == "table":
            into.parts.append(self._table(frame))
        elif name in ("thead", "tbody", "tfoot"):
            into.rows += frame.rows
            into.header = into.header or (name == "thead" and bool(frame.rows)) or (not (into.rows[: -len(frame.rows)] if frame.rows else into.rows) and frame.header)
            into.parts.append(text)
        elif name == "tr":
            first = not into.rows
            if frame.rows:
                into.rows.append(frame.rows[0])
                into.header = into.header or (first and frame.header)
        elif name in _CELLS:
            cell = " ".join(text.split()).replace("|", r"\|")
            if into.name != "tr":  # a cell outside a row
                into.parts.append(f"\n\n{cell}\n\n" if cell else "")
                return
            spanned = frame.values.get("colspan", "")
            row = into.rows[0] if into.rows else []
            row += [cell] + [""] * (min(int(spanned), 1000) - 1 if spanned.isascii() and spanned.isdigit() else 0)
            into.header = name == "th" if not into.rows else into.header and name == "th"
            into.rows = [row]
        else:
            into.parts.append(self._rewritten(name, frame, text))

    def _rewritten(self, name: str, frame: _Frame, text: str) -> str:
        """What an element that isn't part of a table becomes."""
        if self.verbatim and name != "pre":
            return text
        if name == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if text.strip() else ""
        if name in _STRONG or name in _EMPHASIS or name in _STRUCK:
            mark = "**" if name in _STRONG else "*" if name in _EMPHASIS else "~~"
            return text if self._within(_CODE) else _wrapped(text, mark)
        if name in _CODE:
            return _wrapped(text.replace(r"\*", "*").replace(r"\_", "_"), "`")
        if name == "a":
            return self._link(frame, text)
        if name[0] == "h" and name[1:] in ("1", "2", "3", "4", "5", "6"):
            title = " ".join(text.split())
            return f"\n\n{'#' * int(name[1:])} {title}\n\n" if title else ""
        if name == "li":
            return self._item(text)
        if name in _LISTS:
            inner = text.strip("\n")
            if not inner.strip():
                return ""
            return f"\n{inner}\n" if self.lists else f"\n\n{inner}\n\n"
        if name == "blockquote":
            inner = _tidied(text)
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in inner.split("\n")) + "\n\n" if inner else ""
        if name == "caption" or name in _PARAGRAPHS:
            inner = text.strip()
            return f"\n\n{inner}\n\n" if inner else " " if text else ""
        return text

    def _link(self, frame: _Frame, text: str) -> str:
        href, title = frame.values.get("href", ""), frame.values.get("title", "")
        before, inner, after = _EDGES.fullmatch(text).groups()
        address = _address(href) if href else None
        if not inner or address is None:
            return text
        plain = inner.replace(r"\_", "_").replace(r"\*", "*")
        if plain == address and not title:
            return f"{before}<{address}>{after}"
        note = ' "{}"'.format(title.replace('"', r"\"")) if title else ""
        return f"{before}[{re.sub(r'\s*\n\s*', ' ', inner)}]({address}{note}){after}"

    def _item(self, text: str) -> str:
        """A list item under its bullet or number; further lines stand below the first one's text."""
        around = next((f for f in reversed(self.frames) if f.name in _LISTS), None)
        inner = _tidied(text)
        if around is None or around.name != "ol":
            sign = BULLETS[(max(self.lists, 1) - 1) % len(BULLETS)]
        else:
            start = around.values.get("start", "")
            sign = f"{(int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1) + around.items}."
        if around is not None:
            around.items += 1
        first, *rest = inner.split("\n")
        return "\n".join([f"{sign} {first}".rstrip(), *((" " * (len(sign) + 1) + line).rstrip() for line in rest)]) + "\n"

    def _table(self, frame: _Frame) -> str:
        """Rows with bars; a table that doesn't begin with header cells gets an empty header. What stands between rows goes before."""
        loose = "".join(frame.parts).strip()
        if not frame.rows:
            return f"\n\n{loose}\n\n" if loose else ""
        width = max(map(len, frame.rows))
        rows = frame.rows if frame.header else [[""] * width, *frame.rows]
        line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
        lines = [line(rows[0]), line(["---"] * width), *map(line, rows[1:])]
        return "\n\n" + (loose + "\n\n" if loose else "") + "\n".join(lines) + "\n\n"

    def text(self) -> str:
        while self.opened.stack:
            name = self.opened.stack.pop()[0]
            self.opened.many[name] -= 1
            self._closed(name)
        return _tidied("".join(self.frames[0].parts))


def _tidied(text: str) -> str:
    """text without white space at its ends and at ends of lines, and with at most one empty line in a row; code blocks keep theirs."""
    out: list[str] = []
    code = False
    for line in text.split("\n"):
        fence = line.lstrip("> ").startswith("```")
        line = line if code and not fence else re.sub(r"^ (?=\S)", "", line.rstrip())
        code ^= fence
        if line or code or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def markdown(html: str | None) -> str:
    """A page's body as Markdown: headings, paragraphs, lists, quotes, code, tables, links, images, emphasis.

    Scripts, styles and the head have no text; entities are decoded; tags that overlap, don't
    end or don't begin are taken as a browser does. null gives ''.
    """
    writer = Writer()
    for kind, value, written in tokens(html or ""):
        if kind == "text":
            writer.write(value)
        elif kind == "open":
            writer.open(value, written)
        else:
            writer.close(value)
    return writer.text()


def table_markdown(text: str) -> str:
    """Comma-separated lines as a table, the first line its header; '' for no lines."""
    rows = [r for r in csv.reader(io.StringIO(text))]
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def with_markdown(pages: DataFrame, html: str = "html", into: str = "markdown") -> DataFrame:
    """pages' columns but html, then `into`: each page as Markdown with LF line ends.

    A page is one row and one pass over its characters, in Arrow batches. Null and empty
    html give ''; bytes that are no UTF-8 count as U+FFFD; repeated rows are converted each;
    an empty table stays empty; other columns stay as they are, whatever their names, unless
    one is called `into`, which goes.
    """
    kept = [c for c in pages.columns if c not in (html, into)]
    places = [f"c{i}" for i in range(len(kept))]
    rows = pages.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, places)), F.col(f"`{html}`").cast("binary").alias("html"))

    def convert(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            at = t.num_columns - 1
            for lo in range(0, t.num_rows, 256):
                some = t.slice(lo, 256)
                texts = (x.as_py() for x in some.column(at))
                yield pa.RecordBatch.from_arrays([*some.columns[:at], pa.array([markdown(b.decode("utf-8", "replace")) if b else "" for b in texts], pa.string())], names=[*places, "html"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("html", T.StringType())])
    return rows.mapInArrow(convert, schema).select(*(F.col(p).alias(c) for p, c in zip(places, kept)), F.col("html").alias(into))


def heading_rows(pages: DataFrame, ident: str, text: str = "markdown") -> DataFrame:
    """ident, place, level, title of each Markdown heading outside code blocks, in order from 1."""
    plain = F.regexp_replace(text, r"(?ms)^```$.*?^```$", "")
    found = F.regexp_extract_all(plain, F.lit(r"(?m)^(#{1,6} .+)$"), F.lit(1))
    rows = pages.select(ident, F.posexplode(found).alias("place", "line"))
    return rows.select(ident, (F.col("place") + 1).alias("place"), F.instr("line", " ").alias("_n"), F.col("line")).select(ident, "place", (F.col("_n") - 1).alias("level"), F.expr("substring(line, _n + 1)").alias("title"))


def link_rows(pages: DataFrame, ident: str, text: str = "markdown") -> DataFrame:
    """ident, place, label, target of each Markdown link that is no image, in order from 1."""
    one = r"(?<!!)\[((?:[^\[\]\\]|\\.)*+)\]\(([^()\s]*+)(?: \"(?:[^\"\\]|\\.)*+\")?\)"
    labels, targets = (F.regexp_extract_all(text, F.lit(one), F.lit(k)) for k in (1, 2))
    rows = pages.select(ident, F.posexplode(F.arrays_zip(labels.alias("label"), targets.alias("target"))).alias("place", "link"))
    return rows.select(ident, (F.col("place") + 1).alias("place"), "link.label", "link.target")
