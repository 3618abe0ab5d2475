"""Folder scans and session logs on small files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from sparkloom.sources import files, transcripts


def test_folder_scan_admits_by_folder_name_and_size(spark, tmp_path):
    long = "x" * 40
    for name, body in {"a.md": long, "b.txt": "short", "sub/c.py": long, "build/d.md": long, ".hid/e.md": long, "f.min.js": long, "g.bin": long, "store/h.md": long, ".md": long, "copy.md": long}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    found = files.folder_files(spark, str(tmp_path), store=str(tmp_path / "store"))
    assert sorted(r.path.rsplit(str(tmp_path) + "/")[-1] for r in found.select("path").collect()) == ["a.md", "copy.md", "sub/c.py"]
    assert files.first_of_equal_content(found).count() == 1


def test_kind_and_binary(spark):
    rows = [("ptr/types.py", b"abc"), ("exports/Chat.JSONL", b"a\0b"), ("Makefile", None), ("docs/note.md", b"\x10\x01")]
    got = spark.createDataFrame(rows, "path string, content binary").select(files.file_kind(F.col("path")), files.looks_binary(F.col("content"))).collect()
    assert [tuple(r) for r in got] == [("py", False), ("chat", True), ("text", True), ("text", False)]


def test_texts_of_files(spark):
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.W_NS[1:-1]}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    rows = [("a.docx", package.getvalue()), ("b.docx", b"no package"), ("c.py", b'"""Doc."""\nx = 1  # note\n'), ("d.py", b"def ("), ("e.txt", "a\r\nпривет".encode("cp1251")), ("f.txt", None), ("g.txt", b"a\0"), (None, b"t")]
    got = {r.path: r.text for r in files.file_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.docx": "one two\nthree", "b.docx": "", "c.py": "Doc.\n\nnote", "d.py": "", "e.txt": "a\nпривет", "f.txt": "", "g.txt": "", None: "t"}
    assert files.file_texts(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_python_symbols(spark):
    source = "import os\nfrom .a import b\nclass C(B):\n    def m(self):\n        return os.getcwd()\n"
    got = {tuple(r) for r in files.python_symbols(spark.createDataFrame([("p.py", source), ("q.py", "def ("), ("r.py", None)], "path string, source string")).where("src LIKE 'p.py%'").collect()}
    assert got == {("card", "p.py", "p.py", "module", 1, 6), ("imports", "p.py", "os", None, None, None), ("imports", "p.py", ".a:b", None, None, None), ("card", "p.py::C", "C", "class", 3, 5), ("contains", "p.py", "p.py::C", None, None, None), ("implements", "p.py::C", "B", None, None, None), ("card", "p.py::C::m", "m", "function", 4, 5), ("contains", "p.py::C", "p.py::C::m", None, None, None), ("calls", "p.py::C::m", "os.getcwd", None, None, None)}


def test_turn_atoms(spark, tmp_path):
    say = lambda kind, content, **more: json.dumps({"type": kind, "message": {"content": content}, **more})
    tool = {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py", "prompt": "later"}}
    lines = [
        "broken {",
        say("user", "How does the merge work?", timestamp="2026-01-01T00:00:00Z"),
        say("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": " It sorts. "}, tool]),
        say("user", [{"type": "tool_result", "content": "x"}]),
        say("assistant", [{"type": "text", "text": "Then it joins."}]),
        say("user", "<system-reminder>a\nb</system-reminder>"),
        say("user", "hidden question of a side chain", isSidechain=True),
        say("user", "[tiny]"),
        say("user", "All of what was said before", isCompactSummary=True),
        say("assistant", [{"type": "text", "text": "An answer after the summary."}]),
        say("user", "Many calls, please"),
        say("assistant", [{"type": "tool_use", "name": f"T{i}"} for i in range(30)]),
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    got = transcripts.turn_atoms(transcripts.session_lines(spark, str(tmp_path / "s.jsonl"))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.question) for r in got] == [(0, "How does the merge work?"), (1, transcripts.SUMMARY), (2, ""), (3, "Many calls, please")]
    assert got[0].answer == "It sorts.\n\nThen it joins.\n\nTools: [Edit] a.py" and got[0].at == 1767225600.0
    assert got[1].answer == "All of what was said before" and got[2].text == "An answer after the summary."
    assert got[3].answer.count("\n") == 24 and "… 6 more tool calls …" in got[3].answer
    assert transcripts.turn_atoms(spark.createDataFrame([], "file string, line long, value string, modified double")).count() == 0
