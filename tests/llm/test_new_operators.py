"""Importance resampling, HTML extraction and tokenizer alignment against plain versions, and their odd cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sparkloom.functions.html import blocks
from sparkloom.llm import alignment, html_extract, importance, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
ODD = ["", None, " ", "  two  blanks ", "x \n", "\n\n a  b ", "ab▁c", "\x00 z", "<|endoftext|> <s> x<unk> [CLS]", " ́x ́", "a\xa0b c　 d", "日本語 テキスト", "é" * 50, "x " * 7, "\x1c y \x85 z", "a​ b", "🙂 🙃🙃 x", "don't  I'll 12 3.5%"]


# ---------------------------------------------------------------- importance


def drawn_plainly(docs, target, n, percent, least, seed=2024, buckets=importance.BUCKETS):
    def features(text):
        words, out, word = [], [], bytearray()
        for b in (text or "").encode().lower() + b" ":
            if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122:
                word.append(b)
            elif word:
                words.append(bytes(word))
                word = bytearray()
        for i in range(len(words)):
            out += [b" ".join(words[i : i + k]) for k in range(1, n + 1) if i + k <= len(words)]
        return len(words), out

    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                into[zlib.crc32(f) % buckets] += 1
    out, able = [], []
    for k, (i, text) in enumerate(docs):
        words, found = features(text)
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= least:
            able.append(k)
    order = sorted(able, key=lambda k: (-out[k][4], out[k][0] is not None, out[k][0] or 0))
    for place, k in enumerate(order[: percent * len(able) // 100]):
        out[k][5] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("n, nodes", [(1, importance.NODES), (3, importance.NODES), (2, 7)])
def test_importance_matches_a_plain_version(spark, monkeypatch, n, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)
    rng = random.Random(n)
    texts = [" ".join(rng.choice(("An", "bee-Sea", "dé", "x1", "y")) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs = [(rng.choice((None, k)) if k % 20 == 0 else k, x) for k, x in enumerate(texts)] + [(500 + k, x) for k, x in enumerate(ODD)] + [(501, "again and again " * 9)]
    target = ["bee sea x1 " * 5, None, ""]
    frame = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, weight string, `c0` int").repartition(5)
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    found = importance.resample(frame, aims, n=n, percent=30, least_words=8)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == drawn_plainly(docs, target, n, 30, 8)


def test_importance_of_empty_tables_and_odd_bytes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [(r.doc_id, r.n_features, r.rank) for r in importance.resample(some, none, percent=100, least_words=1).orderBy("doc_id").collect()] == [(1, 3, 1), (2, 0, None)]
    invalid = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF6220') AS string) AS text")
    assert importance.resample(invalid, some, least_words=1).collect()[0].n_features == 1


def test_ranks_are_places_in_the_whole_order(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(6)
    ranked = importance.ranked(rows, rows.k.desc(), rows.id.asc()).collect()
    assert {r.id: r["rank"] for r in ranked} == {i: n + 1 for n, (_, i) in enumerate(sorted((-(i % 7), i) for i in range(5000)))}


# ---------------------------------------------------------------- alignment


def aligned_plainly(texts, aligner):
    """One step at a time over both sides' ends, whole texts at once."""
    per, total, best = {}, Counter(), defaultdict(int)
    for i, t in texts.items():
        a = aligner.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = aligner.b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        a_sizes, b_sizes = [aligner.a_bytes[x] for x in a], [aligner.b_bytes[x] for x in b]
        per[i] = None
        if not t or b"".join(a_sizes) != whole or b"".join(b_sizes) != whole:
            continue
        x = y = 0
        a_end, b_end, links, groups, mine, other = len(a_sizes[0]), len(b_sizes[0]), Counter(), [], [a[0]], [b[0]]
        while True:
            links[a[x], b[y]] += 1
            both = a_end == b_end
            if both:
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, other)))
                mine, other = [], []
                if x + 1 == len(a):
                    break
            go_a, go_b = both or a_end < b_end, both or b_end < a_end
            if go_a:
                x += 1
                a_end += len(a_sizes[x])
                mine.append(a[x])
            if go_b:
                y += 1
                b_end += len(b_sizes[y])
                other.append(b[y])
        per[i] = len(a), len(b), groups, links
        total += links
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    out = {}
    for i, p in per.items():
        n_a, n_b, groups, links = p or (0, 0, [], {})
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[i] = (n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if total[k] == best[k[1]]), sum(n * total[k] for k, n in links.items()), digest)
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@needs_tables
def test_alignment_query_matches_a_plain_version(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    want = aligned_plainly(texts, alignment._aligner(alignment.TOKENIZERS, alignment.BYTE_LEVEL, alignment.PIECES))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_tokenizer_alignment(spark, SF).collect()} == want


@pytest.mark.parametrize("most", [10**6, 3])
def test_alignment_of_odd_texts_with_frequent_and_rare_pairs(spark, most):
    texts = dict(enumerate(ODD + ["same same text"] * 3 + ["long" * 30_000, " " * 30_000, "\t \n" * 9000]))
    want = aligned_plainly(texts, alignment._aligner(alignment.TOKENIZERS, alignment.BYTE_LEVEL, alignment.PIECES))
    frame = spark.createDataFrame([(i, t, "clash", 0) for i, t in texts.items()], "doc_id long, text string, groups string, row int").repartition(3)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digest(frame, most=most).collect()} == want


def test_alignment_of_no_rows_and_of_bytes_that_are_no_text(spark):
    assert alignment.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    frame = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text UNION ALL SELECT NULL, 'a b' UNION ALL SELECT NULL, 'a b'")
    found = sorted((r.doc_id, r.n_links) for r in alignment.alignment_digest(frame).collect() if r.doc_id) + [r.n_links for r in alignment.alignment_digest(frame).collect() if r.doc_id is None]
    assert found == [(1, 0), 2, 2]


def test_aligner_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(alignment, "PARTS", 2)
    aligner = alignment.Aligner(alignment.TOKENIZERS, alignment.BYTE_LEVEL, alignment.PIECES)
    first = aligner.align([b"one two three", b"four"])
    aligner.align([b"five six seven"])
    again = aligner.align([b"one two three", b"four"])
    assert (first[0] == again[0]).all() and first[1] == again[1] and all((x == y).all() for x, y in zip(first[2], again[2]))


def test_alignment_cuts_texts_only_where_both_sides_end(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\ta é　B1.'s\x1f́") for _ in range(rng.randrange(60))) for _ in range(400)]
    aligner = alignment.Aligner(alignment.TOKENIZERS, alignment.BYTE_LEVEL, alignment.PIECES)
    cut = aligner.align([t.encode() for t in texts])
    aligner.forget()
    aligner.cut = False
    whole = aligner.align([t.encode() for t in texts])
    assert cut[1] == whole[1] and (cut[0] == whole[0]).all()


# ---------------------------------------------------------------- html


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet") if Path(SF).exists() else spark.createDataFrame([], "page_id long, html string")
    return html_extract.fit_blocks(pages)


def test_extraction_of_pages_in_other_dresses(spark, model):
    prose = "A longer sentence of the article, with several words in it. And another one."
    pages = {
        1: f"<body><header><a href='/'>Site</a></header><nav class=menu><a href='/a'>A</a></nav><main><h1>Head &amp; line</h1><p>{prose}</p><ul><li>one<li>two</ul></main><aside class='sidebar'><h3>Related</h3><a href='/r'>r</a></aside><footer>&copy; x</footer>",
        2: f"<div id='cookie-notice'><p>We use cookies.</p><button>OK</button></div><div class='wrapper'><div class='post-content'><h2>T</h2><p>{prose}</p><div class='ad'>Buy</div><p>More&nbsp;\n text.</p></div></div><section id='comments'><h3>2 comments</h3><div class='comment'><p>{prose}</p></div></section>",
        3: f"<form class='search'><label>Find</label><input></form><article class='entry'><p>{prose}<p>Sh is.</article><div class='newsletter'><p>Subscribe</p></div><script>var a = '<p>no</p>'</script>",
        4: "", 5: None, 6: "<nav><a href='/'>x</a></nav>",
    }
    frame = spark.createDataFrame([(i, h, "kept", 1) for i, h in pages.items()], "page_id long, html string, main_text string, c0 int")
    found = {r.page_id: r.text for r in html_extract.main_texts(frame, model, into="text").collect()}
    assert found == {1: f"Head & line\n{prose}\none\ntwo", 2: f"T\n{prose}\nMore text.", 3: f"{prose}\nSh is.", 4: "", 5: "", 6: ""}
    assert html_extract.main_texts(frame.limit(0), model, into="text").collect() == []
    assert html_extract.main_texts(frame, model).columns == ["page_id", "c0", "main_text"]


def test_labels_of_drawn_pages_are_learned(model):
    dresser = html_extract.Dresser(np.random.default_rng(77), html_extract.FALLBACK)
    right = total = 0
    for _ in range(60):
        page = blocks(dresser.page())
        bare = [(tuple((n, w.replace(" data-y='0'", "").replace(" data-y='1'", "")) for n, w in path), t, k) for path, t, k in page]
        score = model.classify([bare])[0]
        right += sum((s >= 0.5) == bool(html_extract.drawn_labels(path)) for s, (path, _, _) in zip(score, page))
        total += len(page)
    assert right >= 0.95 * total


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    model = html_extract.BlockModel.drawn(rng)
    x, mask = rng.normal(size=(6, 2, html_extract.WIDTH)).astype(np.float32), np.ones((6, 2), np.float32)
    mask[4:, 1] = 0
    target = rng.normal(size=(6, 2, html_extract.UNITS)).astype(np.float32)
    for backward in (False, True):
        weights = [w.astype(np.float64) for w in model.ahead]
        kept: list = []
        html_extract.lstm(x, mask, weights, backward, kept)
        grads, dx = html_extract.lstm_gradients(x.astype(np.float64), weights, kept, target)
        loss = lambda: float((html_extract.lstm(x, mask, weights, backward) * target).sum())
        for value, grad in zip(weights, grads):
            at = tuple(int(rng.integers(k)) for k in value.shape)
            value[at] += 1e-2
            up = loss()
            value[at] -= 2e-2
            down = loss()
            value[at] += 1e-2
            assert (up - down) / 2e-2 == pytest.approx(grad[at], abs=2e-2)


def test_padding_and_lots_change_nothing(model):
    dresser = html_extract.Dresser(np.random.default_rng(3), html_extract.FALLBACK)
    pages = [blocks(dresser.page()) for _ in range(9)] + [[]]
    together = model.classify(pages)
    assert all(np.allclose(a, model.classify([p])[0], atol=1e-4) for a, p in zip(together, pages))


def test_long_and_broken_pages(spark, model):
    long = "<article>" + "<p>A sentence of the text.</p>" * 20_000 + "</article>"
    frame = spark.createDataFrame([(1, long), (2, "<p" * 5000), (3, "<div>" * 5000 + "x"), (4, "<!--" * 999)], "page_id long, html string")
    found = {r.page_id: r.main_text for r in html_extract.main_texts(frame, model).collect()}
    assert found[1].count("\n") == 19_999 and set(found) == {1, 2, 3, 4}
    rows = html_extract.labelled_blocks(frame.where("page_id = 1"), model)
    assert rows.columns == ["page_id", "block", "path", "text", "score"] and rows.count() == 20_000
    invalid = spark.sql("SELECT 1L AS page_id, cast(concat(unhex('3C61727469636C653E61FF'), encode('b</article>', 'utf-8')) AS string) AS html")
    assert html_extract.main_texts(invalid, model).collect()[0].main_text in ("a�b", "")


# ---------------------------------------------------------------- mends of earlier operators


def test_tokens_of_long_white_space_and_of_bytes_that_are_no_text(spark):
    from sparkloom.llm import token_counts

    texts = {1: b" " * 3_000_000, 2: b"\t" * 1_000_000 + b"x", 3: b"a\n" + b" \t\r" * 400_000 + b"\nb", 4: b"\x61\xff\x62", 5: b"\xff\xfe\n\xffa"}
    encoder, lengths = token_counts._encoder(token_counts.TOKENIZERS, token_counts.RANKS)
    for x in texts.values():
        assert lengths[token_counts.encode(encoder, x)].sum() == len(x)
    frame = spark.createDataFrame(list((i, x) for i, x in texts.items()), "doc_id long, text binary")
    by_doc = defaultdict(list)
    for r in token_counts.count_tokens(frame).collect():
        by_doc[r.doc_id].append((r.start, r.end, r.tokens))
    for i, x in texts.items():
        ends = [b for _, b, _ in sorted(by_doc[i])]
        assert [a for a, _, _ in sorted(by_doc[i])] == [0, *ends[:-1]] and ends[-1] == len(x) and all(x[b - 1] == 10 for b in ends[:-1])
        assert sum(n for _, _, n in by_doc[i]) == len(token_counts.encode(encoder, x))


def test_white_space_in_pieces_gives_the_same_tokens(monkeypatch):
    import re

    from sparkloom.llm import token_counts

    encoder, _ = token_counts._encoder(token_counts.TOKENIZERS, token_counts.RANKS)
    monkeypatch.setattr(token_counts, "_APART", re.compile(token_counts._APART.pattern.replace("1000", "2")))
    rng = random.Random(8)
    for _ in range(1000):
        s = "".join(rng.choice(" \n\t\xa0　ab.1é\x1f") for _ in range(rng.randrange(40)))
        assert list(token_counts.encode(encoder, s.encode())) == encoder.encode_ordinary(s)


@needs_tables
def test_pipeline_judges_each_document_once(spark, monkeypatch):
    import corpus_pipeline

    seen = spark.sparkContext.accumulator(0)

    def counted(docs):
        def count(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        return docs.mapInPandas(count, docs.schema)

    stages = list(corpus_pipeline.STAGES)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], ("counted", lambda s, docs, d: counted(docs)), *stages[2:]])
    rows = corpus_pipeline.run(spark, SF).count()
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    assert rows > 0 and seen.value == kept


def test_chats_whose_ids_are_no_numbers(spark):
    from sparkloom.llm import chat_format

    rows = [("a-1", 0, "user", "hi"), ("a-2", 0, "user", "hi"), ("a-2", 1, "assistant", "yes"), (None, 0, "user", "null"), ("0", 0, "user", "zero")]
    found = {r.conv_id: (r.n_turns, r.snapshots) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert found == {"a-2": (2, 1), None: (1, 1), "0": (1, 1)}
