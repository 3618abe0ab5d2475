"""Snapshots, whole texts and outlines of archives on a worked example."""

import math

import pytest

from sparkloom.operators import archive

NODE = "id string, branch string, parent string, index int, at double, file string, text string, status string, root_similarity double, reinforced int"


@pytest.fixture(scope="module")
def grown(spark):
    nodes = [
        ("a", "a", None, 0, 0.0, "x/one.md", "first", "superseded", 0.5, 2), ("b", "a", "a", 1, 0.0, "x/one.md", "second", "active", 0.25, 0),
        ("c", "c", "a", 2, 30 * 86400.0, "two.md", "third", "active", 0.0, 0), ("d", "d", None, 3, 0.0, "two.md", "t" * 300, "active", 0.0, 0),
    ]
    edges = [("c", "a", "supersedes", 0), ("b", "d", "contradicts", 1), ("a", "b", "continues", 2), ("c", "a", "reinforces", 3)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, kind string, seq long")


def ask(spark, *ids):
    return spark.createDataFrame([("q", i, x) for i, x in enumerate(ids)], "query string, place int, id string")


def test_snapshot(spark, grown):
    got = archive.snapshot(ask(spark, "a", "nobody"), *grown).orderBy("position").collect()
    assert [(r.id, r.tag, r.semantic, r.temporal, r.weight, r.tokens, r.overflow) for r in got] == [
        ("a", "SEED_SUPERSEDED_BY_c", 1.0, 1.0, 1.0, 1, False), ("b", "LINEAGE", 0.25, 1.0, 0.55, 1, False), ("c", "CURRENT_VERSION", 1.0, 0.5, 0.8, 1, False),
    ]
    assert got[0].piece == "[SEED_SUPERSEDED_BY_c | a | status=superseded]\nfirst\n"
    row = archive.snapshot_blocks(archive.snapshot(ask(spark, "a"), *grown)).first()
    shares = [x / 2.35 for x in (1.0, 0.55, 0.8)]
    assert row.entropy == pytest.approx(-sum(p * math.log(p) for p in shares), abs=1e-4) and row.tokens == 3
    assert row.block == "\n---\n".join(r.piece for r in got)


def test_snapshot_overflow(spark, grown):
    tight = archive.snapshot(ask(spark, "d", "b"), *grown, budget=60).collect()
    assert [(r.id, r.overflow) for r in tight] == [("b", True)]  # the long seed is passed over, nothing follows the seeds
    some = archive.snapshot(ask(spark, "b"), *grown, budget=60).collect()
    assert [(r.id, r.tag, r.overflow) for r in some] == [("b", "SEED", True)]  # the relation doesn't fit, so no lineage follows
    assert archive.snapshot(ask(spark, "nobody"), *grown).isEmpty()


def test_full_text(spark, grown):
    branches = spark.createDataFrame([("a", False), ("c", True), ("d", False)], "id string, dormant boolean")
    rows = archive.full_text(*grown, branches, chars=6).orderBy("section", "folder", "file", "index").collect()
    assert [(r.section, r.folder, r.line) for r in rows] == [
        (1, "", "- [two.md] third"), (1, "", "- [two.md] " + "t" * 200), (1, "", "- [x/one.md] second"), (2, "", "- «second» contradicts «" + "t" * 150 + "»"),
        (3, "", "third"), (3, "", "tttttt"), (3, "x", "[outdated, see c] first"), (3, "x", "second"),
    ]
    assert archive.full_text(*grown, branches, with_dormant=False).where("section = 1").count() == 2


def test_outline(spark):
    texts = [("README.md", "# Loom\n## Parts \n### Deep\nUse `cut_lineage` and DataFrame."), ("docs/notes.txt", "# Notes\nno names"), ("src/a.py", "# not a document `hidden`"), (".git/README.md", "# Hidden"), ("x.md", None)]
    row = archive.outline(spark.createDataFrame(texts, "path string, text string"), "folder").first()
    assert (row.project, row.domains, row.modules, row.concepts) == ("Loom", ["docs", "src"], ["Loom", "Notes", "Parts"], ["DataFrame", "cut_lineage"])
    assert row.text == "Project: Loom\nDomains: docs, src\nModules: Loom, Notes, Parts\nConcepts: DataFrame, cut_lineage"
    none = archive.outline(spark.createDataFrame([], "path string, text string"), "folder").first()
    assert (none.project, none.modules, none.text) == ("folder", [], "Project: folder")


def test_embedding(spark):
    import numpy as np

    from sparkloom.operators import embedding

    embedding.register("length", lambda model: lambda texts: np.array([[len(t), float(model)] for t in texts]))
    embedding.register("broken", lambda model: lambda texts: np.full((len(texts), 2), np.nan))
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 9000)], "id long, text string")
    got = {r.id: r.v for r in embedding.embed(texts, "length", "4", 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 1.0] and got[3][0] / got[3][1] == pytest.approx(1500)
    for provider, dim in (("broken", 2), ("length", 3)):
        with pytest.raises(Exception, match="numbers"):
            embedding.embed(texts, provider, "4", dim).collect()
    assert [embedding.can_embed(*x) for x in (("hash", "words", 7), ("length", "1", 2), ("length", "1", 3), ("length", "?", 2), ("nobody", "m", 2))] == [True, True, False, False, False]
    hashed = {r.id: r.v for r in embedding.embed(texts, "hash", "words", 8).collect()}
    assert sum(hashed[1]) == 1 and hashed[2] == [0.0] * 8


def test_cards_and_digests(spark):
    from sparkloom.operators import code
    from sparkloom.sources import files

    cards = spark.createDataFrame([(1, "function", "method", "m.f", "Does.", {"purpose": "adds", "side_effects_summary": "Unknown", "other": "x"}), (2, "module", "file", "m", None, None)], "id int, kind string, subkind string, qn string, docstring string, known map<string,string>")
    assert {r.id: r.text for r in code.card_text(cards).collect()} == {1: "function:method m.f\nDoes.\npurpose: adds", 2: "module:file m"}
    fields = spark.createDataFrame([(1, "x", "high", ["e"]), (2, "x", "high", []), (3, "Unknown", "none", None), (4, "x", "none", []), (5, None, "none", [])], "id int, value string, confidence string, evidence array<string>")
    assert {r.id: r.fault for r in code.card_faults(fields).collect()} == {2: "confidence without evidence", 4: "value without confidence"}
    source = "class A:\n    def f(self, x):\n        if x and x > 1:\n            return 1\n        for _ in x:\n            pass\n        def g():\n            with x:\n                pass\n\ndef h():\n    pass\n"
    rows = files.complexities(spark.createDataFrame([("a.py", source), ("b.py", "def ("), ("c.py", None)], "path string, source string")).collect()
    assert {r["name"]: r.complexity for r in rows} == {"A.f": 5, "A.f.g": 2, "h": 1}
    texts = spark.createDataFrame([(1, "a \r\nb\n\n"), (2, "a\nb"), (3, "a\n\nb"), (4, None), (5, ""), (6, "\n \n")], "id int, text string")
    got = {r.id: r.d for r in texts.select("id", files.normal_digest("text").alias("d")).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5] == got[6] and len(got[5]) == 32
