"""Symbols of C and C++ sources by a lexer and a stack of scopes: modules, types, functions, what they contain, call, extend and include."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Endings of C, C++ and CUDA sources.
EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".c++", ".h", ".hh", ".hpp", ".hxx", ".cu", ".cuh")

_TOKEN = re.compile(
    r"(?P<directive>^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)"
    r"|(?P<comment>//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z))"
    r"|(?P<text>(?:u8|[uUL])?R\"(?P<fence>[^()\\\s\"]{0,16})\(.*?(?:\)(?P=fence)\"|\Z)|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*+(?:\"|$)|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)++(?:'|$))"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<number>\.?\d(?:'?[\w.])*)|(?P<sign>::|->|&&|\|\||[^\s])",
    re.S | re.M,
)
_INCLUDE = re.compile(r"\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_DIRECTIVE = re.compile(r"\s*#\s*(\w+)\s*(.*)", re.S)
#: Words in front of a parenthesis that call nothing.
_NO_CALL = frozenset(
    "if for while switch catch return sizeof alignof alignas decltype typeid noexcept throw new delete static_assert co_return co_await co_yield"
    " and or not do else case default goto using typename template requires explicit operator defined __attribute__ __declspec static_cast dynamic_cast const_cast reinterpret_cast".split()
)
#: Words behind which a name in front of a parenthesis is no declared variable.
_BEFORE_CALL = frozenset("return else do case throw new delete and or not co_return co_await co_yield in goto".split())
_TYPES = frozenset(("class", "struct", "union"))


def tokens(source: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line) without comments; of conditional branches the first that isn't #if 0."""
    line, at = 1, 0
    branches: list[list[bool]] = []  # of each open #if: is it read now, has a branch of it been read
    off = 0  # how many of them aren't read now
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup if m.lastgroup != "fence" else "text"
        reading = off == 0
        if kind == "directive":
            word, rest = _DIRECTIVE.match(m[0]).groups() if _DIRECTIVE.match(m[0]) else ("", "")
            if word in ("if", "ifdef", "ifndef"):
                on = not (word == "if" and rest.split("//")[0].strip() in ("0", "false"))
                branches.append([on, on])
                off += not on
            elif word in ("elif", "else", "elifdef", "elifndef") and branches:
                now = not branches[-1][1]
                off += branches[-1][0] - now
                branches[-1] = [now, True]
            elif word == "endif" and branches:
                off -= not branches.pop()[0]
            elif word == "include" and reading:
                yield "directive", m[0], line
        elif kind != "comment" and reading:
            yield kind, m[0], line


def _past_angles(head: list[str], at: int) -> int:
    """The place behind the '>' that closes the '<' at a place; behind the '<' if none does."""
    depth = 0
    for k in range(at, len(head)):
        depth += (head[k] == "<") - (head[k] == ">")
        if depth == 0:
            return k + 1
    return at + 1


def _bare(head: list[str]) -> list[str]:
    """A declaration's words without template prefixes and attributes."""
    while head:
        if head[0] == "template" and len(head) > 1 and head[1] == "<":
            head = head[_past_angles(head, 1) :]
        elif head[:2] == ["[", "["] and "]" in head:
            k = head.index("]")
            head = head[k + 2 :]
        else:
            break
    return head


def _function_name(head: list[str]) -> str | None:
    """The (qualified) name in front of the parameters of a function's head; None if it is none."""
    depth = 0
    for k, word in enumerate(head):
        if word == "=" and depth == 0 and "operator" not in head[:k]:
            return None
        if word in ("(", "[", "{"):
            if word == "(" and depth == 0 and k:
                if head[k - 1] == "operator":
                    depth += 1
                    continue  # the parentheses of operator() come first
                name, j = [], k - 1
                if "operator" in head[max(0, k - 4) : k]:
                    j = len(head[:k]) - 1 - head[:k][::-1].index("operator")
                    name, j = ["operator" + "".join(head[j + 1 : k])], j - 1
                elif re.match(r"[A-Za-z_]\w*$", head[j]) and head[j] not in _NO_CALL:
                    name, j = [head[j]], j - 1
                    if j >= 0 and head[j] == "~":
                        name, j = ["~" + name[0]], j - 1
                else:
                    return None
                while j > 0 and head[j] == "::":
                    j -= 1
                    if head[j] == ">":  # arguments of a template that it belongs to
                        closing = 0
                        while j >= 0:
                            closing += (head[j] == ">") - (head[j] == "<")
                            j -= 1
                            if closing == 0:
                                break
                    if j < 0 or not re.match(r"[A-Za-z_]\w*$", head[j]):
                        break
                    name.insert(0, head[j])
                    j -= 1
                return "::".join(name)
            depth += 1
        elif word in (")", "]", "}"):
            depth -= 1
    return None


def _bases(clause: list[str]) -> list[str]:
    """Names of a class's bases, without access words and template arguments."""
    out, now, depth = [], [], 0
    for word in [*clause, ","]:
        depth += (word == "<") - (word == ">")
        if word == "," and depth == 0:
            if now:
                out.append("".join(now))
            now = []
        elif depth == 0 and word not in (">", "public", "private", "protected", "virtual"):
            now.append(word)
    return out


def module_symbols(path: str, source: str | None) -> list[tuple]:
    """(kind, src, dst, label, start, end): the rows that Python sources give, of a C or C++ source.

    A symbol's full name is that of its namespaces and types and its own, joined by '::';
    the module has the path. Calls are by name, as written before the parenthesis: overloads
    aren't told apart, and calls through macros and pointers aren't seen. Functions without
    a body are declarations. Sources that aren't balanced give what can be told.
    """
    out: list[tuple] = []
    imports: dict[str, None] = {}
    # a scope is (kind, full name, row of its card in out); kinds: space, type, function, block
    scopes: list[tuple[str, str, int]] = [("space", "", -1)]
    words: list[str] = []
    lines: list[int] = []
    calls: dict[int, dict[str, None]] = {}
    before: list[str] = []  # the last words within a function
    inside = None  # the function's scope, if in one
    parens = 0

    def add(label: str, name: str, start: int, end: int) -> tuple[str, int]:
        owner = next(s for s in reversed(scopes) if s[0] in ("space", "type"))
        full = f"{owner[1]}::{name}" if owner[1] else name
        out.append(("card", full, name.rsplit("::", 1)[-1], label, start, end))
        out.append(("contains", owner[1] if owner[0] == "type" else path, full, None, None, None))
        return full, len(out) - 2

    last = 1
    for kind, word, line in tokens(source or ""):
        last = line
        if kind == "directive":
            found = _INCLUDE.match(word)
            if found:
                imports[found[1]] = None
            continue
        scope = scopes[-1]
        if inside is not None:
            if word == "{":
                scopes.append(("block", "", -1))
            elif word == "}":
                scopes.pop()
                if scope[0] == "function":
                    inside = None
                    out[scope[2]] = (*out[scope[2]][:5], line)
                    words, lines, parens = [], [], 0
            elif word == "(" and before and re.match(r"[A-Za-z_]\w*$", before[-1]) and before[-1] not in _NO_CALL:
                name, j = before[-1], len(before) - 2
                while j > 0 and before[j] == "::" and re.match(r"[A-Za-z_]\w*$", before[j - 1]):
                    name, j = f"{before[j - 1]}::{name}", j - 2
                declared = j >= 0 and re.match(r"[A-Za-z_]\w*$", before[j]) and before[j] not in _BEFORE_CALL
                if not declared:
                    calls.setdefault(inside[2], {})[name] = None
            before = [*before[-11:], word]
            continue
        if scope[0] == "block":  # an initialiser or an enumeration outside of functions
            if word == "{":
                scopes.append(("block", "", -1))
            elif word == "}":
                scopes.pop()
                if scopes[-1][0] != "block":
                    words.append("}")
                    lines.append(line)
            continue
        if word == "{":
            head, start = _bare(words), lines[0] if lines else line
            name = _function_name(head) if parens <= 0 else None
            outer = head[: head.index("(")] if "(" in head else head
            typed = next((k for k, w in enumerate(outer) if w in _TYPES), None)
            if parens > 0:
                scopes.append(("block", "", -1))
                continue
            if "namespace" in head[:2]:
                names = [w for w in head[head.index("namespace") + 1 :] if re.match(r"[A-Za-z_]\w*$", w) and w != "inline"]
                full = "::".join(([scope[1]] if scope[1] else []) + names)
                scopes.append(("space", full, -1))
            elif head[:1] == ["extern"] and len(head) == 2:
                scopes.append(("space", scope[1], -1))
            elif name is not None and not (typed is not None and "(" not in head):
                if _initialisers(head) and head[-1] not in (")", "}"):
                    scopes.append(("block", "", -1))  # a member's braces
                    continue
                full, row = add("method" if scope[0] == "type" else "function", name, start, line)
                inside = ("function", full, row)
                scopes.append(inside)
                before = []
            elif typed is not None and "enum" not in outer and "=" not in outer:
                after = outer[typed + 1 :]
                while after[:2] == ["[", "["] and "]" in after:
                    after = after[after.index("]") + 2 :]
                colon = after.index(":") if ":" in after else len(after)
                named = [w for w in after[:colon] if w != "final"]
                named = named[: named.index("<")] if "<" in named else named
                own = next((w for w in reversed(named) if re.match(r"[A-Za-z_]\w*$", w)), None)
                if own is None:
                    scopes.append(("space", scope[1], -1))  # a type without a name
                else:
                    full, row = add("class" if outer[typed] == "class" else "struct", own, start, line)
                    out += [("implements", full, b, None, None, None) for b in _bases(after[colon + 1 :])]
                    scopes.append(("type", full, row))
            else:
                scopes.append(("block", "", -1))
                continue
            words, lines, parens = [], [], 0
        elif word == "}":
            if len(scopes) > 1:
                scopes.pop()
                if scope[0] == "type":
                    out[scope[2]] = (*out[scope[2]][:5], line)
            words, lines, parens = [], [], 0
        elif word == ";" and parens <= 0:
            head = _bare(words)
            name = _function_name(head) if head and head[0] not in ("using", "typedef", "return", "friend", "static_assert") else None
            # a type stands in front of a declared function's name, unless it is a constructor or destructor
            if name is not None and (scope[0] == "type" or head[0] != name.split("::")[0]):
                add("method" if scope[0] == "type" else "declaration", name, lines[0], line)
            words, lines, parens = [], [], 0
        elif word == ":" and words and words[-1] in ("public", "private", "protected", "signals", "slots") and len(words) <= 2:
            words, lines = [], []
        else:
            parens += (word == "(") - (word == ")")
            words.append(word)
            lines.append(line)
    for kind, _, row in scopes:
        if row >= 0:
            out[row] = (*out[row][:5], last)
    out += [("calls", out[row][1], name, None, None, None) for row, named in calls.items() for name in sorted(named)]
    out += [("imports", path, name, None, None, None) for name in sorted(imports)]
    return [("card", path, path, "module", 1, (source or "").count("\n") + 1), *out]


def _initialisers(head: list[str]) -> bool:
    """Does a function's head have a list of member initialisers behind its parameters."""
    depth, closed = 0, False
    for word in head:
        depth += (word in "([") - (word in ")]")
        closed |= word == ")" and depth == 0
        if word == ":" and depth == 0 and closed:
            return True
    return False


def cpp_symbols(texts: DataFrame) -> DataFrame:
    """kind, src, dst, label, start, end of each C or C++ source (path, source); a null source has its module only."""
    names = ["kind", "src", "dst", "label", "start", "end"]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for lo in range(0, len(t), 64):
                some = t.iloc[lo : lo + 64]
                rows = [r for p, s in zip(some["path"], some["source"], strict=True) for r in module_symbols(p or "", s)]
                yield pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64"})

    return texts.select("path", "source").mapInPandas(run, "kind string, src string, dst string, label string, start long, end long")
