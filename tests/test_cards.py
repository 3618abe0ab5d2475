"""Versioned cards against a replay one symbol at a time, references, slim cards of any shape."""

import json
import random

from pyspark.sql import functions as F

from sparkloom.operators import cards
from sparkloom.sources.store import Store


def replay(batches):
    """Versions by qn, one file's symbols at a time: (version, file, signature, body, since, until, ended)."""
    out = {}
    for at, files, fresh in batches:
        now = {}
        for qn, file, signature, body in sorted(fresh, key=lambda x: (x[1], [-ord(c) for c in x[3]])):
            now[qn] = (file, signature, body)
        for qn, versions in out.items():
            live = versions[-1][5] is None
            if live and qn not in now and versions[-1][1] in files:
                versions[-1] = (*versions[-1][:5], at, "removed")
        for qn, (file, signature, body) in now.items():
            versions = out.setdefault(qn, [])
            if versions and versions[-1][5] is None:
                old = versions[-1]
                ended = "supersedes" if old[2] != signature else "continues" if (old[3], old[1]) != (body, file) else None
                if ended is None:
                    continue
                versions[-1] = (*old[:5], at, ended)
            versions.append((len(versions) + 1, file, signature, body, at, None, None))
    return out


def test_merges_are_a_replay(spark, tmp_path):
    rng = random.Random(6)
    store, batches, state = Store(spark, str(tmp_path / "s"), 2), [], {}
    for at in (1.0, 2.0, 3.0):
        files = rng.sample(["a", "b", "c", "d"], 3) if at > 1 else ["a", "b", "c"]
        for f in files:
            state[f] = {f"{rng.choice('mn')}.x{rng.randrange(7)}": (rng.choice("st"), rng.choice("uvw")) for _ in range(rng.randrange(5))}
        fresh = [(qn, f, s, b) for f in files for qn, (s, b) in state[f].items()]
        batches.append((at, files, fresh))
    for at, files, fresh in batches:
        frame = spark.createDataFrame([(*r, "{}") for r in fresh], "qn string, file string, signature string, body string, facts string")
        named = spark.createDataFrame([(f,) for f in files], "file string")
        changes = cards.merge_cards(store, named, frame, at)
        assert changes.count() > 0
    want = replay(batches)
    found = {}
    for r in store.rows("cards").orderBy("qn", "version").collect():
        found.setdefault(r.qn, []).append((r.version, r.file, r.signature, r.body, r.since, r.until, r.ended))
    assert found == {q: v for q, v in want.items() if v}
    changes = cards.merge_cards(store, named, frame, 9.0)  # the last batch again
    assert {r.change for r in changes.collect()} <= {"none"}
    assert {r.qn for r in cards.active_cards(store).collect()} == {q for q, v in want.items() if v and v[-1][5] is None}
    assert {(r.qn, r.version) for r in cards.cards_at(store, 1.5).collect()} == {(q, x[0]) for q, v in want.items() for x in v if x[4] <= 1.5 and (x[5] is None or x[5] > 1.5)}
    assert {(r.src, r.src_version, r.dst_version, r.kind) for r in cards.version_edges(store).collect()} == {(q, y[0], x[0], x[6]) for q, v in want.items() for x, y in zip(v, v[1:]) if x[6] != "removed"}


def test_references_follow_what_comes_and_goes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)

    def step(at, symbols, refs):
        files = spark.createDataFrame([(f,) for f in sorted({f for f, _ in symbols} | {f for f, *_ in refs})], "file string")
        fresh = spark.createDataFrame([(q, f, "s", "b", "{}") for f, q in symbols], "qn string, file string, signature string, body string, facts string")
        changes = cards.merge_cards(store, files, fresh, at)
        n = cards.merge_references(store, files, spark.createDataFrame(refs, "file string, ref long, name string, kind string"), changes)
        return n, {(r.file, r.ref): r.target for r in store.rows("card_references").collect()}

    n, got = step(1.0, [("a", "a.run"), ("a", "a.help")], [("a", 1, "run", "calls"), ("a", 2, "gone", "calls"), ("b", 1, "help", "calls"), ("b", 2, "a.run", "calls")])
    assert n == 4 and got == {("a", 1): "a.run", ("a", 2): None, ("b", 1): "a.help", ("b", 2): "a.run"}
    n, got = step(2.0, [("c", "c.help"), ("c", "c.gone")], [("c", 1, "help", "calls")])  # help is ambiguous now, gone is known
    assert n == 3 and got == {("a", 1): "a.run", ("a", 2): "c.gone", ("b", 1): None, ("b", 2): "a.run", ("c", 1): "c.help"}
    n, got = step(3.0, [("c", "c.other")], [("c", 1, "run", "calls")])
    assert got == {("a", 1): "a.run", ("a", 2): None, ("b", 1): "a.help", ("b", 2): "a.run", ("c", 1): "a.run"}


def test_slim_cards(spark):
    card = {"qualified_name": "m.f", "text": "", "kind": None, "n": 0, "tags": [], "odd \"key\"": 1, "layer_1": {"calls": [], "complexity": 3, "is_async": False, "raises": ["E"]}, "layer_2": {"purpose": {"value": "Unknown", "by": "x"}, "role": {"value": "r"}, "plain": "p"}, "layer_1_provenance": {"complexity": "ast"}}
    rows = [(1, json.dumps(card)), (2, "{}"), (3, None), (4, json.dumps({"qualified_name": {"a": [1, None]}, "layer_2": {"x": {"value": None}}}))]
    frame = spark.createDataFrame(rows, "id long, j string").withColumn("facts", F.parse_json("j"))
    keep = ["qualified_name", "text", "kind", "n", "tags"]
    found = {r.id: r.s and json.loads(r.s) for r in cards.slim_cards(frame, keep).withColumn("s", F.to_json("slim")).collect()}
    assert found == {1: {"qualified_name": "m.f", "n": 0, "layer_1": {"complexity": 3, "raises": ["E"]}, "layer_2": {"role": "r", "plain": "p"}}, 2: {"layer_2": cards.NOT_FILLED}, 3: None, 4: {"qualified_name": {"a": [1, None]}, "layer_2": cards.NOT_FILLED}}
    whole = {r.id: json.loads(r.s) for r in cards.slim_cards(frame.where("id = 1"), keep, provenance=True).withColumn("s", F.to_json("slim")).collect()}
    assert whole[1]["provenance"] == {"layer_1_provenance": card["layer_1_provenance"], "layer_2": card["layer_2"]}
