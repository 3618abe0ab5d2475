"""A folder of code, indexed twice: what is read, what fails, what changes."""

from sparkloom.operators import cards
from sparkloom.sources import code_index
from sparkloom.sources.store import Store


def test_a_folder_indexed_twice(spark, tmp_path):
    root = tmp_path / "build"  # the root's own name doesn't matter

    def put(name, text):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("a/mod.py", "import os\n\ndef run(x: int) -> int:\n    return helper(x)\n\ndef helper(x):\n    return x\n\nclass A(B):\n    def go(self):\n        run(1)\n")
    put("a/lib.cpp", '#include "x.h"\nnamespace n { int f(int a) { return g(a); } }\n')
    put("a/bad.py", "def (:\n")
    put("a/latin.py", b"# \xe9\nx = 1\n")
    put("a/empty.py", "\n")
    put("a/node_modules/x.py", "def no(): pass\n")
    put("a/out-fast/CMakeCache.txt", "x")
    put("a/out-fast/deep/gen.cpp", "int no() {}\n")
    put("a/notes.md", "def no(): pass")
    store = Store(spark, str(tmp_path / "store"), 2)
    first = {(r.what, r.name.replace(f"file:{root}", "").replace(f"file://{root}", "")): r.detail for r in code_index.index_directory(store, str(root), 1.0).collect()}
    assert {k for k in first if k[0] == "failure"} == {("failure", "/a/bad.py"), ("failure", "/a/latin.py")}
    assert first["failure", "/a/bad.py"].startswith("SyntaxError") and first["failure", "/a/latin.py"].startswith("UnicodeDecodeError")
    assert {k[1] for k in first if k[0] == "new"} == {"/a/mod.py", "/a/mod.py::run", "/a/mod.py::helper", "/a/mod.py::A", "/a/mod.py::A::go", "/a/lib.cpp", "n::f", "/a/empty.py"}
    targets = {(r.name, r.kind): r.target and r.target.rsplit("/", 1)[-1] for r in store.rows("card_references").collect()}
    assert targets["helper", "calls"] == "mod.py::helper" and targets["run", "calls"] == "mod.py::run" and targets["g", "calls"] is None and targets["B", "implements"] is None
    put("a/mod.py", "import os\n\ndef run(x: str) -> int:\n    return helper(x)\n\ndef helper(x):\n    return x + 1\n")
    put("a/lib.cpp", '#include "x.h"\nnamespace n { int g(int a) { return a; } int f(int a) { return g(a); } }\n')
    put("a/empty.py", "def (")
    second = {(r.what, r.name.rsplit("/", 1)[-1]) for r in code_index.index_directory(store, str(root), 2.0).collect()}
    assert second == {("failure", "bad.py"), ("failure", "latin.py"), ("failure", "empty.py"), ("continues", "mod.py"), ("supersedes", "mod.py::run"), ("continues", "mod.py::helper"), ("removed", "mod.py::A"), ("removed", "mod.py::A::go"), ("continues", "lib.cpp"), ("new", "n::g"), ("continues", "n::f")}
    assert "empty.py" in {r.qn.rsplit("/", 1)[-1] for r in cards.active_cards(store).collect()}  # what can't be read keeps its cards
    assert {r.target for r in store.rows("card_references").where("name = 'g'").collect()} == {"n::g"}
    assert code_index.index_directory(store, str(root), 3.0).where("what <> 'failure'").count() == 0
