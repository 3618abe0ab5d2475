"""HTML as Markdown: worked cases, the driver's pages against a plain version, broken and very long pages."""

import re
import time
from html import unescape
from pathlib import Path

import duckdb
import pytest

from sparkloom.functions.html import blocks, tokens
from sparkloom.functions.markdown import heading_rows, link_rows, markdown, table_markdown, with_markdown
from sparkloom.sources.files import file_texts

SF = "/root/testdata/sf0.001"

CASES = {
    "<html><head><title>t</title></head><body><h1>Heading</h1><p>A <b>bold</b> word.</p><ul><li>one</li><li>two</li></ul></body></html>": "# Heading\n\nA **bold** word.\n\n* one\n* two",
    "<ul><li>a<ul><li>b<li>c<ol><li>d</ol></ul></li><li><p>p1</p><p>p2</p></li></ul><ol start=3><li>x<li>y</ol>": "* a\n  + b\n  + c\n    1. d\n* p1\n\n  p2\n\n3. x\n4. y",
    "<table><tr><th>A<th>B</tr><tr><td>1|2<td><b>x</b> <a href='/q q'>l</a></table>": "| A | B |\n| --- | --- |\n| 1\\|2 | **x** [l](/q%20q) |",
    "<table><thead><tr><td>h</thead><tbody><tr><td>v</table><table><tr><td colspan=2>1<tr><td>2</table>": "| h |\n| --- |\n| v |\n\n|  |  |\n| --- | --- |\n| 1 |  |\n| 2 |  |",
    "<blockquote><p>q1<p>q2<blockquote>n</blockquote></blockquote><pre><code>a *b*\n\n\n  c_d</code></pre>x<hr>y<br>z": "> q1\n>\n> q2\n>\n> > n\n\n```\na *b*\n\n\n  c_d\n```\n\nx\n\n---\n\ny\nz",
    "<p>a <a href='javascript:x'>j</a> <a href='http://x.y/'>http://x.y/</a> <a href='/z' title='t'>z</a> <img src='i.png' alt='al'>": 'a j <http://x.y/> [z](/z "t") ![al](i.png)',
    "<b> e </b>.<em></em> <s>gone</s> snake_case 2*3 <code>a_b</code>": "**e** . ~~gone~~ snake\\_case 2\\*3 `a_b`",
    "<p><b>For<br><p>x</p></b>y": "**For**\n\nx\n\ny",
    "<head><title>x</title><body>b": "b",
    "<script>if (a < b) '</p>'</script><style>p{}</style>a</p>b &lt;c&gt; &amp; 1 < 2": "a\n\nb <c> & 1 < 2",
    "<div>one<div>two</div>three</div>": "one\n\ntwo\n\nthree",
    "<dl><dt>t<dd>d</dl><input type=checkbox checked>c": "t\n\nd\n\n[x] c",
    "": "", "   ": "", "<!-- c -->": "", "<p></p><b></b>": "",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert markdown(html) == CASES[html]


def plain_page(html):
    """What the driver's pages come to, read off their one layout."""
    text = lambda x: re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip().replace("*", r"\*").replace("_", r"\_")
    parts = ["\n".join(f"* [{text(label)}]({href})" for href, label in re.findall(r'<li><a href="([^"]*)">(.*?)</a></li>', html))]
    parts += [text(re.search(r'(?s)<div class="ad">(.*?)</div>', html)[1]), "# " + text(re.search(r"(?s)<h1>(.*?)</h1>", html)[1])]
    for p in re.split("</?p>", re.search(r"(?s)</h1>(.*?)</article>", html)[1]):
        if text(p):
            parts.append(f"**{text(p)}**" if p.startswith("<b>") else text(p))
    parts.append(text(re.search(r"(?s)<footer>(.*?)(?:</footer>|$)", html)[1]))
    return "\n\n".join(x for x in parts if x)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_pages_match_a_plain_version(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    found = {r.page_id: r.markdown for r in with_markdown(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")).collect()}
    decoded = lambda x: re.sub(r"%([0-9A-F]{2}(?:%[0-9A-F]{2})*)", lambda m: bytes.fromhex(m[1].replace("%", "")).decode(), x)
    assert {i: decoded(x) for i, x in found.items()} == {i: decoded(plain_page(h)) for i, h in pages.items()}


def test_pages_that_break_rules_take_linear_time():
    for html in ("<div>" * 100_000 + "x", "<p><td>" * 50_000, "<" * 500_000, '<a "' * 100_001 + ">", "<!--" * 100_000, "<b>x" * 50_000, "<li>x" * 50_000, "<p>word</p>" * 100_000, "<script>" * 100_000):
        began = time.time()
        markdown(html)
        blocks(html)
        assert time.time() - began < 20


def test_tokens_lose_no_text():
    assert list(tokens("a<B c='>'>d</b >e<!-- f --><g/>h<")) == [("text", "a", ""), ("open", "b", " c='>'"), ("text", "d", ""), ("close", "b", ""), ("text", "e", ""), ("open", "g", "/"), ("text", "h<", "")]
    assert list(tokens("<textarea>&lt;<p></TEXTAREA>x")) == [("open", "textarea", ""), ("text", "<<p>", ""), ("close", "textarea", ""), ("text", "x", "")]


def test_rows_of_any_kind(spark):
    html = [(1, "<h2>T</h2><p>x <a href='/a'>l</a> ![n](m)</p><pre># no\n</pre><h3>U *</h3>"), (2, None), (None, ""), (4, "<p>same</p>"), (4, "<p>same</p>")]
    frame = spark.createDataFrame([(i, h, "kept", 1) for i, h in html], "page_id long, html string, c0 string, markdown int")
    out = with_markdown(frame)
    assert out.columns == ["page_id", "c0", "markdown"]
    assert sorted((str(r.page_id), r.c0, r.markdown) for r in out.collect()) == [("1", "kept", "## T\n\nx [l](/a) ![n](m)\n\n```\n# no\n```\n\n### U \\*"), ("2", "kept", ""), ("4", "kept", "same"), ("4", "kept", "same"), ("None", "kept", "")]
    assert [tuple(r) for r in heading_rows(out, "page_id").orderBy("place").collect()] == [(1, 1, 2, "T"), (1, 2, 3, "U \\*")]
    assert [tuple(r) for r in link_rows(out, "page_id").collect()] == [(1, 1, "l", "/a")]
    assert with_markdown(frame.limit(0)).collect() == []
    invalid = spark.sql("SELECT 1 AS page_id, cast(unhex('3C703E61FF') AS string) AS html")
    assert with_markdown(invalid).collect()[0].markdown == "a�"


def test_files_become_markdown(spark):
    files = [("/a/x.HTML", b"<h1>T</h1>\r\n<p>p"), ("/a/t.csv", b'a,b\r\n"1,5",2\r\n'), ("/a/n.md", b"# T\r\nx\ry"), ("/a/b.html", b"\0\1"), ("/a/none.html", None)]
    found = {r.path: r.text for r in file_texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert found == {"/a/x.HTML": "# T\n\np", "/a/t.csv": "| a | b |\n| --- | --- |\n| 1,5 | 2 |", "/a/n.md": "# T\nx\ny", "/a/b.html": "", "/a/none.html": ""}
    assert table_markdown("") == ""
