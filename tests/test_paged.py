"""The paged source against a made indexer: short and empty last pages, failures, filters."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import paged

INDEXER = """
import json, os, sys
kind, skip, limit = sys.argv[1], int(sys.argv[2]), int(sys.argv[3])
here = os.path.dirname(os.path.abspath(__file__))
open(os.path.join(here, f"asked-{kind}-{skip}-{os.getpid()}"), "w").close()
rows = json.load(open(os.path.join(here, "rows.json"))).get(kind, [])
broken = os.path.join(here, f"broken-{kind}-{skip}")
if os.path.exists(broken):
    what = open(broken).read()
    if what != "always":
        os.remove(broken)
    print("half an ans" if what == "half" else "", end="")
    sys.exit(0 if what == "half" else 3)
print(json.dumps(rows[skip : skip + limit]))
"""


@pytest.fixture
def indexer(tmp_path):
    (tmp_path / "indexer.py").write_text(INDEXER)

    def serve(rows):
        (tmp_path / "rows.json").write_text(json.dumps(rows))
        return f"{sys.executable} {tmp_path}/indexer.py"

    return tmp_path, serve


def function(i):
    return [f"p.f{i}", f"f{i}", f"src/{i % 3}.py", i + 1, i + 2]


@pytest.mark.parametrize("n, page, lanes", [(0, 5, 2), (4, 5, 2), (5, 5, 2), (23, 5, 3), (20, 5, 4), (7, 1, 4)])
def test_every_page_is_read_once(spark, indexer, n, page, lanes):
    _, serve = indexer
    command = serve({"Function": [function(i) for i in range(n)], "CALLS": [[f"p.f{i}", f"p.f{i + 1}"] for i in range(n)] + [["p.f0", "other.x"]]})
    nodes, edges = paged.code_graph(spark, command, "p", page=str(page), lanes=str(lanes))
    assert sorted(r.qn for r in nodes.collect()) == sorted(f"f{i}" for i in range(n))
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted((f"f{i}", f"f{i + 1}") for i in range(n - 1))


def test_failed_pages_are_asked_again_and_lasting_failures_end_the_job(spark, indexer):
    folder, serve = indexer
    command = serve({"Function": [function(i) for i in range(12)]})
    for skip, what in ((0, "once"), (5, "half")):
        (folder / f"broken-Function-{skip}").write_text(what)
    nodes, _ = paged.code_graph(spark, command, "p", page="5", lanes="2", pause="0")
    assert nodes.count() == 12
    (folder / "broken-Function-10").write_text("always")
    with pytest.raises(Exception, match="page 2 of Function"):
        nodes.count()
    with pytest.raises(Exception, match="no-such-program"):
        paged.code_graph(spark, "no-such-program", "p")[0].count()


def test_kinds_that_nobody_wants_are_not_asked_for(spark, indexer):
    folder, serve = indexer
    command = serve({"Function": [function(1)], "Class": [function(2)], "CALLS": [["p.f1", "p.f2"]]})
    paged.register(spark)
    rows = spark.read.format("code_pages").options(command=command, lanes="1").load()
    assert [r.kind for r in rows.where("kind = 'Class'").collect()] == ["Class"]
    assert {f.name.split("-")[1] for f in folder.glob("asked-*")} == {"Class"}
    assert sorted(r.kind for r in rows.where(F.col("kind").isin("CALLS", "Function") & (F.col("page") == 0)).collect()) == ["CALLS", "Function"]
    assert {f.name.split("-")[1] for f in folder.glob("asked-*")} == {"Class", "CALLS", "Function"}
    assert rows.where("kind = 'Other'").collect() == []
