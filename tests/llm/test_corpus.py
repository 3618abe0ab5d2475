"""The corpus operators against plain versions, with nulls, blanks, ties, repeats, empty tables and extra columns."""

import pickle
import random

import numpy as np
import pytest

from sparkloom.llm import ann, chat_format, exact_topk, language_id, mixing, ngram_join, packing, token_counts, toxicity, url_filter
from sparkloom.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(80):
        w = list(base[i % 12]) if i % 3 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, 0, 1, "k", 0.5))
    rows += [(90, None, "en", "s0", 0, 1, "k", 0.5), (91, "", None, "s0", 0, 1, "k", 0.5), (92, " \n\t", "de", "s1", 0, 1, "k", 0.5), (None, "one two", "de", None, 0, 1, "k", 0.5), (93, "42 !!", "en", "s1", 0, 1, "k", 0.5)]
    rows += [rows[4], rows[4], (94, "x " * 5000, "en", "s2", 0, 1, "k", 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block, side, hot", [(ngram_join.BLOCK, ngram_join.SIDE, ngram_join.HOT), (2, 3, 1), (3, 2, 1 << 20)])
def test_ngram_components_match_brute_force(docs, monkeypatch, block, side, hot):
    for name, value in (("BLOCK", block), ("SIDE", side), ("HOT", hot)):  # small ones split blocks and grids, and leave most shared shingles cold
        monkeypatch.setattr(ngram_join, name, value)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    rows = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}) for d, w in rows]
    root = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    want = {(d, len(s), min((e for k, (e, _) in enumerate(sets) if root[k] == root[i] and e is not None), default=None)) for i, (d, s) in enumerate(sets)}
    assert got == want
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0
    assert ngram_join.one_of_each_group(docs).columns == docs.columns


def test_count_tree_never_misses():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (300, ngram_join.GROUPS)).astype(np.int32)
    sizes = np.sort(points.sum(1))
    points = points[np.argsort(points.sum(1), kind="stable")]
    tree = ngram_join.CountTree(points, sizes)
    for p in range(0, 300, 17):
        want = np.flatnonzero(175 * np.minimum(points, points[p]).sum(1) >= 75 * (sizes + sizes[p]))
        assert np.array_equal(np.sort(tree.search(points[p], int(sizes[p]), 75)), want)


def test_mix_meets_targets_and_limits(docs):
    items, spans = mixing.mix_sources(docs, block=16)
    rows = mixing.words_taken(items, spans).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(abs(t - g) <= 1 for t, g, _ in by.values()) and abs(sum(g for _, g, _ in by.values()) - 1.5 * sum(s for *_, s in by.values())) < 1e-6
    again = mixing.words_taken(*mixing.mix_sources(docs.repartition(3), block=16)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.words_taken(*mixing.mix_sources(docs.limit(0))).count() == 0


def test_mix_is_the_same_by_broadcast_and_by_salted_joins(docs, monkeypatch):
    rows = lambda: sorted(map(str, mixing.words_taken(*mixing.mix_sources(docs, block=16)).collect()))
    one = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == one


def test_mix_cuts_the_last_slot_when_every_block_is_used(spark):
    # sources of one block and of several, whose incomplete pass needs all blocks
    sizes = {"a": 3000, "b": 200, "c": 500}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    rows = mixing.words_taken(*mixing.mix_sources(docs, weights=(12, 1, 3), share=1.2)).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in rows)
    b = next(r for r in rows if r.source == "b")
    assert 200 < b.target < 400


def test_packing_is_best_fit_and_loses_nothing(docs, spark):
    def plain(items, capacity):
        bins, out = [], []
        for size, source, cluster in items:
            fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
            _, at = min(fits, default=(0, len(bins)))
            if at == len(bins):
                bins.append([capacity, set(), set()])
            out.append((at, capacity - bins[at][0]))
            bins[at][0] -= size
            bins[at][1].add(source)
            bins[at][2].add(cluster)
        return out

    rng = random.Random(2)
    items = sorted(((rng.randint(1, 100), rng.randrange(6), rng.randrange(30)) for _ in range(400)), reverse=True)
    assert packing.best_fit(items, 100) == plain(items, 100)
    from sparkloom.llm.queries import packing_input

    sized = packing_input(docs)
    rows = packing.pack(sized, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(r.size for r in sized.collect())
    assert packing.pack(sized.limit(0)).count() == 0


def test_tokens_of_sections_sum_to_the_documents(spark):
    texts = ["one two\nthree four\n\nfive", "é" * 50 + "\n" + "long " * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder, _ = token_counts._encoder(token_counts.TOKENIZERS, token_counts.RANKS)
    for rule in token_counts.RULES:
        rows = token_counts.count_tokens(df, rule).collect()
        for i in (0, 1):
            own = [r for r in rows if r.doc_id == i]
            assert abs(sum(r.tokens for r in own) - len(encoder.encode_ordinary(texts[i]))) < 1e-6
            assert max(r.end for r in own) == len(texts[i].encode())
    assert list(token_counts.attribute(np.array([2, 5, 6]), np.array([3, 6]), "share")) == pytest.approx([1 + 1 / 3, 1 + 2 / 3])


def test_code_lengths_are_exact_and_separate_languages(docs, spark):
    en, de = "the cat sat on the mat and the dog ran", "der hund und die katze sind auf dem tisch"
    rows = [(i, t, lang, "s", 0, 1, "k", 0.5) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 4)]
    model = language_id.fit_languages(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got == {i: ("en", "de")[i % 2] for i in range(8)}
    odd = {r.text: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert odd[None] == odd[""] == odd["42 !!"] == ("und", 0.0)
    counts = {}
    data = (b"\n" * 3 + en.encode())
    for _ in range(4):
        for i in range(3, len(data)):
            for k in range(4):
                counts.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                counts[data[i - k : i]][data[i]] += 1
    for text in (b"the mat zap", b"\xc3\xa9 Z\x00 \xff\xfe the", b"t"):  # also bytes and contexts that no text had
        padded, bits = b"\n" * 3 + text, 0.0
        for i in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                seen = counts.get(padded[i - k : i])
                if seen:
                    total, kinds = sum(seen.values()), len(seen)
                    if padded[i] in seen:
                        bits -= np.log2(seen[padded[i]] / (total + kinds))
                        break
                    bits -= np.log2(kinds / (total + kinds))
            else:
                bits += 8
        lengths = model.code_lengths([b"", text, text * 2])
        assert lengths[1, model.langs.index("en")] == pytest.approx(bits) and not lengths[0].any()


def test_many_languages_are_learned_from_a_bounded_sample(spark):
    rng = random.Random(8)
    alphabet = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)]
    rows = []
    for lang in range(60):
        words = ["".join(rng.choices(alphabet, k=5)) for _ in range(30)]
        rows += [(lang * 100 + i, " ".join(rng.choices(words, k=40)), f"l{lang:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs, per_language=5, most=200)
    assert len(model.langs) == 60
    got = language_id.identify(docs, model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert language_id.fit_languages(docs.limit(0)).langs == []


def test_least_hashed_is_the_same_as_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sparkloom.llm.common import least_hashed

    rows = spark.range(5000).select((F.col("id") % 4700).alias("i"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 7 > 0, "b").alias("by"))
    h = F.xxhash64("i")
    rank = F.row_number().over(Window.partitionBy("by").orderBy(F.shiftrightunsigned(h, 54), h, "i"))
    want = rows.where("by IS NOT NULL").distinct().select("by", "i", rank.alias("r")).where("r <= 100")
    got = least_hashed(rows, "by", "i", 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_toxicity_search_is_exact_and_separates(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)] + (["nasty", rng.choice(["vile", "foul"])] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0, 1, "k", 0.5))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit_toxicity(docs.where("doc_id < 200"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(300)}
    terms, weights = np.arange(len(model.terms)), np.ones(len(model.terms)) / len(model.terms) ** 0.5
    found, scores = model.search(terms, weights)
    full = weights @ model.postings
    assert np.allclose(np.sort(scores), np.sort(full)[-len(scores) :])
    blank = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(blank, model).collect())


def test_toxicity_keeps_every_term_of_few_examples(spark):
    # 5 toxic and 25 clean examples: no term's chi-square can reach 31
    texts = {i: f"ay bee cee w{i} " + ("vile" if i % 6 == 0 else "fine") for i in range(30)}
    docs = spark.createDataFrame([*texts.items(), (40, "new vile one"), (41, "new fine one")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in texts], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.terms) == len({w for t in texts.values() for w in t.split()})
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[40].predicted == 1 and got[41].predicted == 0
    assert got[40].terms == ["vile"] and {e.toxic for e in got[40].evidence} == {1}


def test_toxicity_index_is_built_by_who_uses_it(spark):
    docs = spark.createDataFrame([(i, f"ay bee w{i} " + ("vile" if i % 3 == 0 else "fine")) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    model = toxicity.fit_toxicity(docs, labels)
    sent = pickle.loads(pickle.dumps(model))
    want = [r.score for r in toxicity.score_toxicity(docs, model).orderBy("doc_id").collect()]
    # the driver has only sent the examples on: 16 bytes a term of each
    assert not set(toxicity.BUILT) & set(vars(model)) and not set(toxicity.BUILT) & set(vars(sent))
    assert sum(h.nbytes + c.nbytes for *_, h, c in model.rows) == 60 * 4 * 16
    assert [s for s, *_ in sent.score([r.text.encode() for r in docs.orderBy("doc_id").collect()])] == want
    assert vars(sent).keys() >= set(toxicity.BUILT) and pickle.loads(pickle.dumps(sent)).rates == model.rates


def test_toxicity_search_matches_all_products():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(500):
        terms = np.unique(np.concatenate((rng.zipf(1.5, 40) % 3000, [3000 + i % 2])))
        rows.append((i, i % 2, terms.astype(np.uint64), rng.integers(1, 4, len(terms))))
    model = toxicity.ExampleIndex(rows, (1.0, 1.0))
    assert (model.postings.row >= 0).any() and len(model.postings.value)  # both kinds of terms
    for i in range(0, 500, 7):
        terms = np.searchsorted(model.terms, rows[i][2])
        weights = model.factor[terms] / np.linalg.norm(model.factor[terms])
        full = np.zeros(len(model.terms))
        full[terms] = weights
        want = full @ model.postings
        for skip in (-1, int(want.argmax())):
            order = [j for j in np.lexsort((np.arange(500), -want.round(12))) if j != skip and want[j] > 0][: toxicity.NEIGHBOURS]
            found, scores = model.search(terms, weights, skip)
            assert np.allclose(scores, want[order]) and np.array_equal(np.sort(want[found].round(9)), np.sort(want[order].round(9)))


def test_vector_searches_match_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(260, 8)).astype(np.float32)
    v[7] = v[3]
    # repeated rows, an id with two vectors, a hot vector, and rows that take no part
    valid = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist()), (100, v[9].tolist()), (50, v[50].tolist())] + [(400 + i, v[11].tolist()) for i in range(30)]
    df = spark.createDataFrame([*valid, (300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<float>")
    ids, d = np.array([i for i, _ in valid]), np.array([x for _, x in valid], np.float64)
    cos = (d @ d.T) / (np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(d, axis=1))

    def plain(scores, every, k, extra=()):
        out = []
        for q in np.flatnonzero(ids % every == 0):
            order = sorted([(-scores[q, i], int(ids[i])) for i in range(len(ids)) if i != q] + list(extra))[:k]
            out += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(order)]
        return sorted(out)

    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.nearest(df).collect())
    assert got == plain(cos.round(12), 50, 5)
    ints = np.floor(1024 * d).astype(np.int64)
    got = sorted(map(tuple, exact_topk.top_inner_products(df.where("vec_id <> 301 OR vec_id IS NULL")).collect()))
    assert got == plain(ints @ ints.T, 100, 10)
    assert ann.nearest(df.limit(0)).count() == exact_topk.top_inner_products(df.limit(0)).count() == 0


def test_vector_searches_with_huge_components(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, -1.0]), (2, [-1e20, 0.0]), (3, [1e200, 1e200]), (4, [1e-200, 0.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as v", "1 as key")
    near = {(r.rank, r.vec_id): r.score for r in ann.nearest(df).collect()}
    assert [i for _, i in sorted(near)] == [1, 4, 5, 3, 2]
    assert near[4, 3] == pytest.approx(0.5**0.5) and near[5, 2] == pytest.approx(-1.0)
    top = {r.vec_id: r.score for r in exact_topk.top_inner_products(df).collect()}
    assert top[1] == top[3] == 2**63 - 1 and top[2] == -(2**63) and top[4] == 0 and top[5] == 2**63 - 1


def test_url_trie_and_join_agree(spark, monkeypatch):
    urls = ["http://Example.ORG/es/1", "https://a.example.org/en/12?x#y", "http://x.com/fr/", "http://x.com/de/9", "http://x.net/", "http://org", "nothing", "", None, "http://com/de/a/b?c", "HTTP://b.org/x://y"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    one = sorted(map(tuple, url_filter.judge_urls(df, URL_RULES).collect()))
    monkeypatch.setattr(url_filter, "TRIE_RULES", 0)
    two = sorted(map(tuple, url_filter.judge_urls(df, URL_RULES).collect()))
    assert one == two
    verdicts = {r[0]: r[-2:] for r in one}
    assert verdicts[0] == ("example.org/es/", "block") and verdicts[1] == ("example.org/en/1", "block") and verdicts[3] == ("com/de/", "block")
    assert verdicts[4] == verdicts[5] == verdicts[8] == (None, "allow") and verdicts[10] == ("org/", "allow")


def test_chats_collapse_to_maximal_conversations(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", None), (None, 0, None, "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.snapshots, r.rendered) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {2, 4, None} and got[2][:2] == (2, 2)
    assert got[2][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_order_nulls_first_over_lots(spark):
    turns = [(1, None, "user", "n"), (1, -5000, "user", "m"), (1, -1, "user", "a"), (1, 0, "user", "b"), (1, 9000, None, "c"), (1, 9000, "user", None), (1, 9000, "user", None)]
    # conversation 2 is a prefix, 0 repeats it, 3 has the same turns but another last text
    turns += [(c, n, r, x) for c in (2, 0) for _, n, r, x in turns[:4]] + [(3, n, r, x) for _, n, r, x in turns[:3]] + [(3, 0, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, n int, lot string")
    got = {r.conv_id: (r.n_turns, r.snapshots, r.rendered) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {1, 3} and got[1][:2] == (7, 1) and got[3][:2] == (4, 1)
    assert [p.split("\n")[1] for p in got[1][2].split("<|im_end|>\n")[:-1]] == ["n", "m", "a", "b", "c", "", ""]


def test_trie_finds_the_longest_open_segment():
    rules = [url_filter.Rule("block", "a.org", f"/{'x' * n}") for n in range(1, 40, 2)] + [url_filter.Rule("allow", "org", ""), url_filter.Rule("allow", "a.org", "/xx/y"), url_filter.Rule("block", "a.org", "/xx/")]
    trie = url_filter.Trie(rules)

    def plain(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
        return best and (best.verdict, best.host + best.path)

    for host in ("a.org", "b.a.org", "org", "net", ""):
        for path in ("", "/", "/x", "/xxxx", "/" + "x" * 80, "/xx/", "/xx/yz", "/xx/zy", "/y/xx"):
            assert trie.find(host, path) == plain(host, path)
