"""Main text of HTML pages: a bidirectional LSTM labels the blocks of a page with the whole page in view."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.html import attributes, blocks
from sparkloom.llm.common import SPACED, batches, hashed_words, least_hashed

#: Rows of the tables of path features and of words, their widths, numbers a block, units a direction.
PATHS, WORDS, PATH_WIDTH, WORD_WIDTH, NUMBERS, UNITS = 4096, 1024, 16, 8, 6, 16
WIDTH = PATH_WIDTH + WORD_WIDTH + NUMBERS
#: Blocks (padding included) that are run at once; memory only.
CELLS = 1 << 13

_ATTRIBUTES = ("class", "id", "role", "itemprop", "aria-label")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Path = tuple[tuple[str, str], ...]


def element_features(name: str, written: str) -> list[str]:
    """Features of one open element: its name, the words of its naming attributes and the beginnings of longer ones."""
    out = ["t:" + name]
    if written:
        found = attributes(written)
        for word in (w.lower() for a in _ATTRIBUTES for w in _NAME.findall(found.get(a, ""))):
            out += ["w:" + word] + (["s:" + word[:4]] if len(word) > 3 else [])
    return out


def path_features(path: Path) -> np.ndarray:
    """Rows of the path table: features of all open elements, once each, and the innermost one's name."""
    named = {f for name, written in path if name not in ("html", "body") for f in element_features(name, written)}
    named.add("leaf:" + (path[-1][0] if path else ""))
    return np.array(sorted({zlib.crc32(f.encode()) % PATHS for f in named}))


def block_numbers(text: str, linked: int, words: int) -> tuple[float, ...]:
    """Length in words, share of linked characters, sentence end, digits, capital at the start, and one word only."""
    n = len(text)
    return (np.log1p(words) / 4, min(1.0, linked / n), float(text[-1] in ".!?:\"'»”…。"), sum(c.isdigit() for c in text[:200]) / min(n, 200), float(text[0].isupper()), float(words <= 1))


def word_means(texts: Sequence[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean row of each text's words, words of each text, rows of all words, bounds of each text in them)."""
    hashes, bounds, *_ = hashed_words([t.encode("utf-8", "replace") for t in texts], SPACED)
    rows = (hashes % np.uint64(WORDS)).astype(np.int64)
    sums = np.concatenate((np.zeros((1, table.shape[1])), np.cumsum(table[rows], 0, dtype=np.float64)))
    n = np.diff(bounds)
    return ((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)[:, None]).astype(np.float32), n, rows, bounds


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, weights: Sequence[np.ndarray], backward: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, UNITS) of one direction over x (time, page, WIDTH).

    Where the mask is 0 the state stays 0, so padding behind a page doesn't reach it from
    the back either. keep, if a list, gets what the gradients need.
    """
    w, u, b = weights
    steps = range(len(x))[::-1] if backward else range(len(x))
    h = c = np.zeros((x.shape[1], UNITS), np.float32)
    out = np.zeros((len(x), x.shape[1], UNITS), np.float32)
    for at in range(0, len(x), 4096):  # inputs of all gates, a stretch of time at once
        stretch = steps[at : at + 4096]
        low = min(stretch[0], stretch[-1])
        inputs = x[low : low + len(stretch)] @ w + b
        for t in stretch:
            gates = inputs[t - low] + h @ u
            ifo = _sigmoid(gates[:, : 3 * UNITS])
            g = np.tanh(gates[:, 3 * UNITS :])
            i, f, o = ifo[:, :UNITS], ifo[:, UNITS : 2 * UNITS], ifo[:, 2 * UNITS :]
            m = mask[t][:, None]
            if keep is not None:
                before = (h, c)
            c = (f * c + i * g) * m
            s = np.tanh(c)
            h = o * s * m
            out[t] = h
            if keep is not None:
                keep.append((t, before, i, f, o, g, s, m))
    return out


def lstm_gradients(x: np.ndarray, weights: Sequence[np.ndarray], kept: list, d_out: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradients of the weights, gradient of x) from the gradient of all hidden states."""
    w, u, b = weights
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b), np.zeros_like(x)
    dh = dc = np.zeros((x.shape[1], UNITS), np.float32)
    for t, (h0, c0), i, f, o, g, s, m in reversed(kept):
        dh = (dh + d_out[t]) * m
        dc = (dc + dh * o * (1 - s * s)) * m
        d = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)), 1)
        dw += x[t].T @ d
        du += h0.T @ d
        db += d.sum(0)
        dx[t] = d @ w.T
        dh, dc = d @ u.T, dc * f
    return [dw, du, db], dx


@dataclass
class BlockModel:
    """Tables of path features and words, both directions' weights, and the output layer."""

    paths: np.ndarray
    words: np.ndarray
    ahead: list[np.ndarray]
    back: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def drawn(cls, rng: np.random.Generator) -> BlockModel:
        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        def direction() -> list[np.ndarray]:
            b = np.zeros(4 * UNITS, np.float32)
            b[UNITS : 2 * UNITS] = 1  # remember at first
            return [some(WIDTH, 4 * UNITS), some(UNITS, 4 * UNITS), b]

        return cls(rng.normal(0, 0.01, (PATHS, PATH_WIDTH)).astype(np.float32), rng.normal(0, 0.01, (WORDS, WORD_WIDTH)).astype(np.float32), direction(), direction(), some(2 * UNITS + WIDTH, 1), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.paths, self.words, *self.ahead, *self.back, self.out, self.bias]

    def vectors(self, page: list[tuple[Path, str, int]], seen: dict[Path, np.ndarray] | None = None) -> np.ndarray:
        """One input row for each block of a page, or of several pages in a row."""
        seen = {} if seen is None else seen
        words, n, _, _ = word_means([t for _, t, _ in page], self.words)
        out = np.zeros((len(page), WIDTH), np.float32)
        for k, (path, text, linked) in enumerate(page):
            if path not in seen:
                if len(seen) > 20_000:
                    seen.clear()
                seen[path] = self.paths[path_features(path)].sum(0)
            out[k, :PATH_WIDTH] = seen[path]
            out[k, PATH_WIDTH + WORD_WIDTH :] = block_numbers(text, linked, int(n[k]))
        out[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = words
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text of each block (time, page)."""
        h = np.concatenate((lstm(x, mask, self.ahead, False), lstm(x, mask, self.back, True), x), 2)
        return _sigmoid((h @ self.out)[:, :, 0] + self.bias)

    def classify(self, pages: list[list[tuple[Path, str, int]]], seen: dict[Path, np.ndarray] | None = None) -> list[np.ndarray]:
        """Probabilities of each page's blocks; pages of like length run side by side."""
        out = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            length, some = len(pages[order[-1]]), []
            while order and (not some or (len(some) + 1) * length <= CELLS):
                some.append(order.pop())
            x, mask = padded([self.vectors(pages[i], seen) for i in some])
            p = self.probabilities(x, mask)
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(len(p) for p in pages)
    x, mask = np.zeros((length, len(pages), pages[0].shape[1]), np.float32), np.zeros((length, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# ---------------------------------------------------------------- training pages

#: Words by which sites name the parts of a page; a page to learn from draws among them.
MAIN = "article main content post body entry story text page-content article-body post-content entry-content blog-post document".split()
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pagination pager sitemap toolbar skip".split(),
    "header": "header masthead banner topbar branding logo site-header title-bar hero".split(),
    "footer": "footer copyright colophon bottom legal site-footer imprint credits".split(),
    "aside": "aside sidebar widget related recommended popular trending tags archive rail more secondary complementary".split(),
    "div": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promoted promotion banner-ad outbrain".split(),
    "dialog": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall warning announcement privacy message".split(),
    "form": "form search login signup contact subscribe field register".split(),
    "section": "comments comment comment-list disqus replies reply discussion respond reviews thread feedback responses user-comments".split(),
    "ul": "share social follow menu links social-links nav-links".split(),
}
#: The part's role, where sites name one.
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "dialog": "alert"}
NEUTRAL = "container wrapper page row site inner layout col grid outer root app wrap box group".split()


class Dresser:
    """Draws pages of known labels: texts of real pages under names that sites use."""

    def __init__(self, rng: np.random.Generator, texts: list[str]) -> None:
        self.rng, self.texts = rng, texts

    def pick(self, names: Sequence[str]) -> str:
        return names[int(self.rng.integers(len(names)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, least: int, most: int) -> str:
        source = self.pick(self.texts).split()
        n, at = int(self.rng.integers(least, most + 1)), int(self.rng.integers(len(source)))
        return " ".join((source + source)[at : at + n]).replace("<", "").replace("&", "&amp;")

    def named(self, name: str) -> str:
        """A word as class or id, now and then among words that say nothing, or none of its own."""
        extra = " " + "".join(map(chr, self.rng.integers(97, 123, 5))) if self.chance(0.3) else ""
        return f'{self.pick(("class", "class", "id"))}="{name}{extra}"'

    def main_block(self) -> str:
        text = self.pick(self.texts).replace("<", "").replace("&", "&amp;") if self.chance(0.5) else self.words(1, 40)
        kind = self.pick(("p", "p", "p", "p", "p", "h2", "h3", "li", "ol", "quote", "table", "pre", "figure", "div", "link", "bold", "dl", "header"))
        some = lambda: self.words(1, 12)
        return {
            "li": f"<ul><li>{some()}<li>{some()}</li><li><a href='/x'>{some()}</a> {some()}</li></ul>",
            "ol": f"<ol><li>{text}</li><li>{some()}</li></ol>",
            "quote": f"<blockquote><p>{text}</p></blockquote>",
            "table": f"<table><tr><th>{some()}</th><th>{some()}</th></tr><tr><td>{some()}</td><td>{some()}</td></tr></table>",
            "pre": f"<pre><code>{text}</code></pre>",
            "figure": f"<figure><img src='x.png'><figcaption>{some()}</figcaption></figure>",
            "div": f"<div>{text}</div>",
            "link": f"<p>{some()} <a href='/y'>{some()}</a> {some()}</p>",
            "bold": f"<p><b>{text}<br>",
            "dl": f"<dl><dt>{some()}</dt><dd>{text}</dd></dl>",
            "header": f"<header><h1>{some()}</h1></header>",
        }.get(kind, f"<{kind}>{text}</{kind}>")

    def part(self, tag: str) -> str:
        """A part that is no main text."""
        name, outer = self.pick(PARTS[tag]), tag if self.chance(0.5) else self.pick(("div", "div", "section", "ul" if tag in ("nav", "ul") else "div"))
        role = f' role="{ROLES[tag]}"' if tag in ROLES and self.chance(0.2) else ""
        written = ("" if outer == tag and tag not in ("div", "section", "ul") and self.chance(0.5) else " " + self.named(name)) + role
        item = self.pick(("div", "li", "article"))
        links = "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(int(self.rng.integers(1, 8))))
        prose = "".join(f"<p>{self.pick(self.texts).replace('<', '').replace('&', '&amp;') if self.chance(0.4) else self.words(1, 30)}</p>" for _ in range(int(self.rng.integers(1, 5))))
        inner = {
            "nav": f"<ul>{links}</ul>" if outer != "ul" else links,
            "ul": links,
            "header": f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(1, 8)}</p>" if self.chance(0.5) else "") + (f"<h1>{self.words(1, 4)}</h1>" if self.chance(0.3) else ""),
            "footer": f"{'&copy; ' if self.chance(0.7) else ''}{self.words(1, 20)}" + (f"<ul>{links}</ul>" if self.chance(0.3) else ""),
            "aside": (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.6) else "") + (f"<ul>{links}</ul>" if self.chance(0.6) else prose),
            "div": self.words(1, 30) if self.chance(0.6) else f"<p>{self.words(1, 30)}</p>" if self.chance(0.6) else f"<a href='/ad'>{self.words(1, 8)}</a>",
            "dialog": f"<p>{self.words(1, 30)}</p><button>{self.words(1, 2)}</button>" if self.chance(0.5) else self.words(1, 30),
            "form": f"<label>{self.words(1, 3)}</label><input name='q'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(1, 9)}</p>" if self.chance(0.3) else ""),
            "section": (f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.6) else "") + "".join(f"<{item} class='{self.pick(('comment', 'reply', 'item', 'media'))}'>{self.words(1, 3)}<p>{self.words(1, 40)}</p></{item}>" for _ in range(int(self.rng.integers(1, 4)))) + (prose if self.chance(0.3) else ""),
        }[tag]
        return f"<{outer}{written} data-y='0'>{inner}</{outer}>"

    def page(self) -> str:
        """An HTML page whose parts say in data-y whether they are main text."""
        main = "".join(self.part(self.pick(("aside", "div", "div", "form", "ul", "section", "dialog"))) if self.chance(0.06) else self.main_block() for _ in range(int(self.rng.integers(1, 16))))
        if self.chance(0.7):
            main = f"<h1>{self.words(1, 9)}</h1>" + main
        tag = self.pick(("article", "article", "main", "div", "section"))
        written = " " + self.named(self.pick(MAIN)) if tag in ("div", "section") or self.chance(0.3) else ""
        main = f"<{tag}{written} data-y='1'>{main}</{tag}>"
        if self.chance(0.3):
            around = self.pick(("main", "div"))
            main = f"<{around} {self.named(self.pick(MAIN + NEUTRAL))}>{main}" + (self.part("section") if self.chance(0.4) else "") + f"</{around}>"
        before = [self.part(self.pick(("nav", "header", "div", "dialog", "ul", "form"))) for _ in range(int(self.rng.integers(0, 5)))]
        after = [self.part(self.pick(("footer", "aside", "div", "section", "dialog", "ul", "form", "nav"))) for _ in range(int(self.rng.integers(0, 5)))]
        whole = "".join(before) + main + "".join(after)
        for _ in range(int(self.rng.integers(0, 3))):
            whole = f"<div {self.named(self.pick(NEUTRAL))}>{whole}</div>"
        head = f"<title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='{self.words(1, 9)}';</script>"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{whole}" + ("<noscript>" + self.words(1, 9) + "</noscript>" if self.chance(0.2) else "") + "</body></html>"


def drawn_labels(path: Path) -> int:
    """Label of a block of a drawn page: that of the nearest part around it; outside all parts, no main text."""
    return next((int("'1'" in written) for _, written in reversed(path) if "data-y=" in written), 0)


def own_labels(page: list[tuple[Path, str, int]]) -> list[int] | None:
    """Labels of a real page by its own <article> or <main>, less menus and the like within; None if it has neither."""
    labels = []
    for path, _, _ in page:
        names = [name for name, _ in path]
        inside = max((k for k, name in enumerate(names) if name in ("article", "main")), default=-1)
        labels.append(int(inside >= 0 and not any(n in ("nav", "aside", "footer", "form", "script", "style") for n in names)))
    return labels if any(labels) else None


def train(examples: list[tuple[list[tuple[Path, str, int]], list[int]]], epochs: int, seed: int, rate: float = 0.01) -> BlockModel:
    """A model by Adam on the log loss of all blocks, in lots of pages of like length."""
    rng = np.random.default_rng(seed)
    model = BlockModel.drawn(rng)
    examples = sorted((e for e in examples if e[0]), key=lambda e: len(e[0]))
    lots = []
    for lo, hi in batches([len(p) for p, _ in examples], 800):
        pages = [p for p, _ in examples[lo:hi]]
        flat = [b for p in pages for b in p]
        _, n, rows, bounds = word_means([t for _, t, _ in flat], model.words)
        paths = [path_features(path) for path, _, _ in flat]
        numbers = np.array([block_numbers(t, linked, int(k)) for (_, t, linked), k in zip(flat, n)], np.float32)
        lengths = [len(p) for p in pages]
        place = (np.concatenate([np.arange(k) for k in lengths]), np.repeat(np.arange(len(pages)), lengths))
        y = np.array([v for _, labels in examples[lo:hi] for v in labels], np.float32)
        of = np.repeat(np.arange(len(flat)), n)
        lots.append((place, (max(lengths), len(pages)), np.concatenate(paths), np.repeat(np.arange(len(flat)), [len(p) for p in paths]), rows, of, np.maximum(n, 1)[:, None].astype(np.float32), numbers, y))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(lots)):
            place, shape, paths, path_of, rows, of, n, numbers, y = lots[k]
            flat = np.zeros((len(y), WIDTH), np.float32)
            np.add.at(flat[:, :PATH_WIDTH], path_of, model.paths[paths])
            np.add.at(flat[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH], of, model.words[rows])
            flat[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] /= n
            flat[:, PATH_WIDTH + WORD_WIDTH :] = numbers
            # some path features are hidden, so that a block is also told by its neighbours
            hidden = rng.random(len(y)) < 0.05
            flat[hidden, :PATH_WIDTH] = 0
            x, mask = np.zeros((*shape, WIDTH), np.float32), np.zeros(shape, np.float32)
            x[place], mask[place] = flat, 1
            keep_a: list = []
            keep_b: list = []
            h = np.concatenate((lstm(x, mask, model.ahead, False, keep_a), lstm(x, mask, model.back, True, keep_b), x), 2)
            p = _sigmoid((h @ model.out)[:, :, 0] + model.bias)
            d = np.zeros(shape, np.float32)
            d[place] = (p[place] - y) / len(y)
            d_out, d_bias = np.einsum("tbk,tb->k", h, d)[:, None], np.array([d.sum()], np.float32)
            dh = d[:, :, None] * model.out[:, 0]
            da, dx_a = lstm_gradients(x, model.ahead, keep_a, dh[:, :, :UNITS])
            db, dx_b = lstm_gradients(x, model.back, keep_b, dh[:, :, UNITS : 2 * UNITS])
            dx = (dh[:, :, 2 * UNITS :] + dx_a + dx_b)[place]
            dx[hidden, :PATH_WIDTH] = 0
            d_paths, d_words = np.zeros_like(model.paths), np.zeros_like(model.words)
            np.add.at(d_paths, paths, dx[path_of, :PATH_WIDTH])
            np.add.at(d_words, rows, (dx[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / n)[of])
            step += 1
            now = rate * (1 - epoch / epochs) + 0.0005
            for value, grad, (m, v) in zip(model.parameters(), [d_paths, d_words, *da, *db, d_out, d_bias], moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


#: Texts of drawn pages where no page of the table gives any.
FALLBACK = ["Text of a page that has a few words in it.", "One", "More words, and a second sentence. And a third one!"]


def fit_blocks(pages: DataFrame, ident: str = "page_id", html: str = "html", sample: int = 200, longest: int = 32_768, drawn: int = 1500, epochs: int = 8, seed: int = 12) -> BlockModel:
    """A block labeller learned from a bounded sample of pages and from pages drawn in their words.

    The `sample` pages of least hashed id with at most `longest` bytes of html are collected
    (so 6.5 MB at most, whatever the table's size). Those with an <article> or <main> of
    their own are labelled by it; the texts of all dress `drawn` pages, whose parts bear
    names that sites use. Null, empty and repeated pages teach nothing new; an empty table
    leaves drawn pages in fixed words. The same pages give the same model.
    """
    short = pages.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{html}`").alias("html")).where(F.length(F.col("html").cast("binary")).between(1, longest))
    chosen = least_hashed(short.withColumn("all", F.lit(0)), "all", "ident", sample).select("ident")
    rows = short.join(F.broadcast(chosen), "ident").groupBy("ident").agg(F.min("html").alias("html")).collect()
    real = [blocks(r.html) for r in sorted(rows, key=lambda r: (str(r.ident), r.html))]
    texts = [t for page in real for path, t, _ in page if not any(name in ("script", "style") for name, _ in path)] or FALLBACK
    dresser = Dresser(np.random.default_rng(seed), texts)
    examples = [(page, labels) for page in real if (labels := own_labels(page)) is not None]
    for _ in range(drawn):
        page = blocks(dresser.page())
        examples.append((page, [drawn_labels(path) for path, _, _ in page]))
    bare = [([(tuple((name, re.sub(r"\s?data-y='.'", "", written)) for name, written in path), t, k) for path, t, k in page], labels) for page, labels in examples]
    return train(bare, epochs, seed)


def _pages(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[tuple[Path, str, int]]]]]:
    """(first row, blocks of each page) over short runs of a batch's rows; null html has no blocks."""
    values = [x.as_py() for x in batch.column(column)]
    for lo, hi in batches([len(v or b"") for v in values], 1 << 21):
        yield lo, [blocks(v.decode("utf-8", "replace")) if v else [] for v in values[lo:hi]]


def labelled_blocks(pages: DataFrame, model: BlockModel, ident: str = "page_id", html: str = "html") -> DataFrame:
    """ident, block (from 0), path, text, score of every block of every page; score is the probability of main text. Cases as in main_texts."""

    def label(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[Path, np.ndarray] = {}
        for t in tables:
            for lo, some in _pages(t, 1):
                scores = model.classify(some, seen)
                n = [len(p) for p in some]
                if not sum(n):
                    continue
                flat = [b for p in some for b in p]
                arrays = [t.column(0).take(pa.array(np.repeat(np.arange(lo, lo + len(some)), n))), pa.array(np.concatenate([np.arange(k) for k in n]), pa.int32()), pa.array(["/".join(name for name, _ in path) for path, _, _ in flat]), pa.array([x for _, x, _ in flat]), pa.array(np.concatenate(scores), pa.float64())]
                for a in range(0, len(flat), 10_000):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 10_000) for x in arrays], names=["ident", "block", "path", "text", "score"])

    rows = pages.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{html}`").cast("binary").alias("html"))
    schema = T.StructType([rows.schema["ident"], *T.StructType.fromDDL("block int, path string, text string, score double").fields])
    return rows.mapInArrow(label, schema).withColumnRenamed("ident", ident)


def main_texts(pages: DataFrame, model: BlockModel, html: str = "html", into: str = "main_text") -> DataFrame:
    """pages' columns but html, then `into`: blocks of a score of one half or more in page order, joined by line feeds.

    Every page is read whole. Null and empty html and pages without main text give ''; bytes
    that are no UTF-8 count as U+FFFD; white space within a block is one blank; repeated rows
    are judged alike, as no page sees another; an empty table stays empty; all other columns
    stay as they are, whatever their names, unless one is called `into`, which it replaces.
    """
    kept = [c for c in pages.columns if c not in (html, into)]
    places = [f"c{i}" for i in range(len(kept))]
    rows = pages.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, places)), F.col(f"`{html}`").cast("binary").alias("html"))

    def extract(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[Path, np.ndarray] = {}
        for t in tables:
            at = t.num_columns - 1
            for lo, some in _pages(t, at):
                texts = ["\n".join(b[1] for b, p in zip(page, scores) if p >= 0.5) for page, scores in zip(some, model.classify(some, seen))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(some)) for c in t.columns[:at]), pa.array(texts, pa.string())], names=[*places, "html"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("html", T.StringType())])
    return rows.mapInArrow(extract, schema).select(*(F.col(p).alias(c) for p, c in zip(places, kept)), F.col("html").alias(into))
