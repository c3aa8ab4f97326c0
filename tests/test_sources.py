"""Files and parsers."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quarry.operators.store import Store
from quarry.sources import files, parsers
from quarry.sources.watch import Watch


def test_listing_and_guards(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"x", "b.PY": b"def f():\n  pass\n", ".hidden.txt": b"x", "empty.md": b"", "x.pyc": b"x", "sub/c.md": b"# T\nbody", "d.xyz": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.guarded(files.list_files(spark, [f"file://{tmp_path}"]), patterns=["*.pyc", ".*"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.txt", "b.PY", "c.md"]
    assert files.folder_size(files.list_files(spark, [f"file://{tmp_path}"])).first().n_files == 5  # the listing itself leaves out hidden and empty files
    blocks = parsers.parse_files(files.list_files(spark, [f"file://{tmp_path}"], content=True).where(files.supported(F.col("path")) & (F.col("length") > 0)))
    assert {r.path.rsplit("/", 1)[1]: r.title for r in blocks.collect()}["c.md"] == "T"


def test_watch(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    watch = Watch(Store(spark, f"file://{tmp_path}/store"), [f"file://{root}"])
    poll = lambda: sorted((r.path.rsplit("/", 1)[1], r.event_type) for r in watch.poll(spark).collect())
    for name in "abc":
        (root / name).write_text(name)
    assert poll() == [("a", "created"), ("b", "created"), ("c", "created")] and poll() == []
    (root / "a").write_text("longer")
    (root / "b").unlink()
    (root / "d").write_text("d")
    assert poll() == [("a", "modified"), ("b", "deleted"), ("d", "created")] and poll() == []


def test_ignore_rules(spark):
    paths = ["/a/.x", "/a/x.pyc", "/environment/x.txt", "/a/x.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.i for r in df.select(files.ignored(F.col("path")).alias("i")).collect()]
    assert got == [True, True, True, False]
    assert [r.i for r in df.select(files.ignored(F.col("path"), ["x.txt"]).alias("i")).collect()] == [False, False, True, True]


def test_markdown():
    doc = parsers.parse_markdown("a.md", b"---\ntitle: Hi\n---\nintro\n# One\ntext\n####### no\n###### Six\nend")
    assert doc.title == "Hi" and [(b.section, b.text) for b in doc.blocks] == [(None, "intro"), ("# One", "# One\ntext\n####### no"), ("###### Six", "###### Six\nend")]
    data = "é\n# A\nb".encode()
    block = parsers.parse_markdown("a.md", data).blocks[1]
    assert data[block.start : block.end] == b"# A\nb"
    assert parsers.parse_markdown("a.md", b"plain").blocks[0].section is None


def test_csv():
    assert [parsers.sniff_delimiter(t) for t in ("a,b\n1,2", "a;b\n1;2", "a\tb\n1\t2", "a|b\n1|2")] == [",", ";", "\t", "|"]
    doc = parsers.parse_csv("a.csv", b'a;b\n1;"x\ny"\nragged\n2;z\n')
    assert doc.metadata == {"rows": "2", "columns": "2"} and [b.kind for b in doc.blocks] == ["header", "sample", "data"]
    assert doc.blocks[2].text == "a | b\n1 | x y\n2 | z"


PAGE = b"""<html><head><title>A &amp; B</title><style>p{}</style></head><body><div class="m"><p>First <b>one</b> paragraph text.</p>
<div>inner</div><ul><li>item one<li>item two</ul></div><script>var x = "<p>no</p>";</script><h2>Head</h2><pre>code here that is long enough</pre></body></html>"""


def test_html():
    doc = parsers.parse_html("a.html", PAGE)
    assert doc.title == "A & B"
    assert [b.kind for b in doc.blocks] == ["p", "div", "pre", "li", "li", "h2"]
    assert doc.blocks[0].text == "First one paragraph text." and "First one paragraph text." in doc.blocks[1].text and "no" not in "".join(b.text for b in doc.blocks).split()
    assert [b.text for b in doc.blocks if b.kind == "li"] == ["item one", "item two"]
    at = 0
    for b in doc.blocks:
        assert (b.start, b.end) == (at, at + len(b.text.encode()))
        at = b.end + 1
    assert parsers.html_title('<meta property="og:title" content="Og &lt;">') == "Og <"
    assert [b.text for b in parsers.parse_html("a.html", b"<i>tiny</i>").blocks] == ["tiny"]


def test_notebook():
    book = {"nbformat": 4, "metadata": {"kernelspec": {"name": "py3", "language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# Ti", "tle\n", "t"]}, {"cell_type": "code", "source": "x = '#no' # yes\n# all"}, {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": ""}]}
    doc = parsers.parse_notebook("a.ipynb", json.dumps(book).encode())
    assert doc.title == "Title" and doc.language == "python" and [b.kind for b in doc.blocks] == ["markdown", "code", "comments"]
    assert doc.blocks[2].text == "yes\nall"


def test_code():
    py = 'import x\n\nclass A(B):\n    """Doc of A."""\n    def inner(self): pass\n\ndef f(a,\n      b): pass\n\ndef g(a) -> int:\n    """Two\n    lines."""\n'
    found = parsers.code_definitions(py, "python")
    assert [(b.section, b.kind) for b in found] == [("A", "class"), ("g", "function")] and found[0].text == 'class A(B):\nDoc of A.'
    assert py.encode()[found[1].start : found[1].end] == b"def g(a) -> int:"
    names = lambda lang, text: [b.section for b in parsers.code_definitions(text, lang)]
    assert names("javascript", "// makes\nexport async function go(a) {\nconst h = (x) => x\nclass K {") == ["go", "h", "K"]
    assert names("go", "func (s *S) Do(a int) {\ntype T struct {") == ["Do", "T"]
    assert names("rust", "pub fn f(a: u8) {\nstruct S;\npub trait T {\nenum E {") == ["f", "S", "T", "E"]
    assert names("java", "public final class Q {") == ["Q"] and names("c", "int main(void) {\nstruct P {") == ["main", "P"] and names("ruby", "def go(x)\nclass Z") == ["go", "Z"]
    plain = parsers.parse_code("x.sql", "\n".join(f"select {i}" for i in range(120)).encode())
    assert [b.section for b in plain.blocks] == ["lines_1-50", "lines_51-100", "lines_101-120"]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Intro") + p("Part", "Heading1") + p("text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    doc = parsers.parse_docx("a.docx", out.getvalue())
    assert doc.title == "Part" and [(b.section, b.text) for b in doc.blocks] == [(None, "Intro"), ("Part", "text"), ("Part", "a | b\n--- | ---\n1 | 2")]


def test_pluggable_and_broken(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (30).to_bytes(4, "big") + (20).to_bytes(4, "big")
    assert parsers.parse_image("a.png", png).metadata["width"] == "30" and parsers.parse_pdf("a.pdf", b"/Type /Page /Type /Pages").metadata["pages"] == "1"
    rows = spark.createDataFrame([("x.docx", bytearray(b"broken")), ("y.txt", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in parsers.parse_files(rows).collect()}
    assert got["x.docx"][0] is None and "BadZipFile" in got["x.docx"][1] and got["y.txt"] == (None, None)
    assert parsers.decoded(b"\xef\xbb\xbfa\xff") == "a�"
