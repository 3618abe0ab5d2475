"""Reading HTML: tags and texts in order, open elements as a browser keeps them, blocks of text with their paths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

#: A comment, a declaration, or a tag; quotes may hold '>', and a tag that never ends takes the rest.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text without tags up to their end tag; entities count in the last two.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
DECODED = frozenset(("title", "textarea"))
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script search section"
    " select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: What an end tag, or an opened block for an open paragraph, doesn't look beyond.
_SCOPE = frozenset("button caption html object table td template th".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: What an opened element closes first, and where the search for it ends.
_IMPLIED = {
    **{x: (frozenset((x,)), frozenset("ul ol menu dir".split()) | _SCOPE) for x in ("li",)},
    **{x: (frozenset(("dt", "dd")), frozenset(("dl",)) | _SCOPE) for x in ("dt", "dd")},
    **{x: (frozenset(("td", "th")), frozenset(("table", "tr"))) for x in ("td", "th")},
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **{x: (frozenset("thead tbody tfoot".split()), frozenset(("table",))) for x in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    **{x: (_HEADINGS, _SCOPE | frozenset(("div", "section", "article"))) for x in _HEADINGS},
}
#: Elements beyond this depth aren't kept open; their text belongs to the deepest one that is.
DEPTH = 512


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes as written) and ("close", name, "") in order.

    Names are in lower case; character references in texts are decoded. Comments and
    declarations give nothing. The content of scripts and the like is one text.
    """
    at, n = 0, len(html)
    while at < n:
        found = html.find("<", at)
        m = _TOKEN.match(html, found) if found >= 0 else None
        if m is None:  # no tag, or a '<' that begins none
            end = n if found < 0 else found + 1
            while found >= 0 and m is None:
                found = html.find("<", end)
                m = _TOKEN.match(html, found) if found >= 0 else None
                end = n if found < 0 else found if m else found + 1
            yield "text", unescape(html[at:end]), ""
            at = end
            continue
        if found > at:
            yield "text", unescape(html[at:found]), ""
        at = m.end()
        name, ends, attributes = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
        if not name:
            continue
        name = name.lower()
        if ends:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW:
            end = re.compile(f"</{name}(?![^\\s/>])", re.I).search(html, at)
            upto = end.start() if end else n
            if upto > at:
                yield "text", unescape(html[at:upto]) if name in DECODED else html[at:upto], ""
            at = upto


def attributes(written: str) -> dict[str, str]:
    """Attributes by name in lower case, the first of a name, with character references decoded."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(written):
        out.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return out


class OpenElements:
    """The elements that are open, outermost first, as (name, attributes as written).

    on_close is called for each element that ends, by its end tag, by a tag that implies
    it, or by the end of an element around it; void elements are never open.
    """

    def __init__(self, on_close: Callable[[str], None] = lambda name: None) -> None:
        self.stack: list[tuple[str, str]] = []
        self.many: Counter[str] = Counter()
        self.on_close = on_close

    def _cut(self, wanted: frozenset[str], barrier: frozenset[str]) -> bool:
        if not any(self.many[name] for name in wanted):
            return False
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in wanted:
                while len(self.stack) > k:
                    inner = self.stack.pop()[0]
                    self.many[inner] -= 1
                    self.on_close(inner)
                return True
            if name in barrier:
                return False
        return False

    def open(self, name: str, written: str) -> bool:
        """Close what name implies and open it; False for void elements and beyond DEPTH."""
        if name in BLOCK and name not in ("button", "option", "optgroup", "select"):
            self._cut(frozenset(("p",)), _SCOPE)
        if name in _IMPLIED:
            self._cut(*_IMPLIED[name])
        if name in VOID or len(self.stack) >= DEPTH:
            return False
        self.stack.append((name, written))
        self.many[name] += 1
        return True

    def close(self, name: str) -> bool:
        """Close the nearest open element of that name, unless it is out of scope."""
        return self._cut(frozenset((name,)), (_SCOPE if name in BLOCK else BLOCK) - {name} if name not in ("table", "html", "body") else frozenset())


def blocks(html: str) -> list[tuple[tuple[tuple[str, str], ...], str, int]]:
    """(open elements, text, characters within links) of each block of text, in order.

    A block is the text between two boundaries of block elements; elements within a line
    don't cut it. White space becomes single blanks, and blocks without other characters
    are left out.
    """
    out = []
    opened, held, linked = OpenElements(), [], 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((tuple(opened.stack), text, linked))
        held.clear()
        linked = 0

    for kind, value, written in tokens(html):
        if kind == "text":
            held.append(value)
            if any(name == "a" for name, _ in opened.stack[-4:]):
                linked += len(value)
            continue
        if value in BLOCK:
            end_block()
        if kind == "open":
            opened.open(value, written)
            if value == "br":
                held.append(" ")
        else:
            opened.close(value)
    end_block()
    return out
