import json
import shutil

import pytest
from pyspark.sql import functions as F

from quire.operators import segment
from quire.sources import export, extract, readers, tools, writers
from quire.streaming import arrivals


def test_documents_of_every_kind(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\r\n\r\ntext {#x}\n")
    (tmp_path / "my_notes.txt").write_text("First line\nsecond line.\n\nMy Great Chapter\n\nMore.\n")
    (tmp_path / "c.html").write_text("<html><head><title>T</title><style>x{}</style></head><body><h1>H</h1><p>one <b>two</b><ul><li>x<li>y</ul><a href='u'>l</a></body>")
    (tmp_path / "d.docx").write_bytes(b"PK")
    (tmp_path / "e.md").write_text(" \n")
    (tmp_path / "f.xyz").write_text("?")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.md"].title == "Title" and got["a.md"].text == "# Title\n\ntext\n"
    assert got["my_notes.txt"].title == "my notes" and "## My Great Chapter" in got["my_notes.txt"].text and "First line second line." in got["my_notes.txt"].text
    assert got["c.html"].title == "T" and "# H" in got["c.html"].text and "- x\n\n- y" in got["c.html"].text and "[l](u)" in got["c.html"].text and "x{}" not in got["c.html"].text
    assert "no pandoc found" in got["d.docx"].problem and got["e.md"].problem == "no text" and got["f.xyz"].problem == "no reader for xyz"
    pages = readers.documents(spark, str(tmp_path), {"docx": lambda c: F.lit("converted")})
    assert {r.text for r in pages.where("format = 'docx'").collect()} == {"converted\n"}


def test_tolerant_text(spark):
    df = spark.createDataFrame([(b"ok",), (b"\xff\xfe\x00",), (None,)], "c binary")
    assert [r[0] for r in df.select(readers.tolerant("c")).collect()] == ["ok", None, None]
    pick = spark.createDataFrame([(" ", "x", "y")], "a string, b string, c string")
    assert pick.select(readers.first_non_blank("a", "b", "c")).first()[0] == "x"


def test_json_relations(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"terms": [{"source": "A", "aliases": ["B"], "target": "T", "category": "place", "honorific": ""}], "honorifics": [{"id": "h", "target": "(x)"}]}))
    terms, honorifics = readers.glossary(spark, str(tmp_path / "g.json"))
    assert terms.first().source == "A" and honorifics.first().id == "h"
    (tmp_path / "bad.json").write_text("{nope")
    assert readers.json_relation(spark, str(tmp_path / "bad.json"), "a int").count() == 0
    assert readers.json_relation(spark, str(tmp_path / "missing.json"), "a int").count() == 0


def fake(folder, name, body):
    """A tool of that name: a shell script."""
    folder.mkdir(exist_ok=True)
    at = folder / name
    at.write_text("#!/bin/sh\n" + body)
    at.chmod(0o755)


def alone(monkeypatch, folder):
    """Only the tools of the folder (and the shell's own) are on the path."""
    folder.mkdir(exist_ok=True)
    for name in ("sh", "cat", "printf", "head", "sleep", "echo", "dirname"):
        at = shutil.which(name)
        if at and not (folder / name).exists():
            (folder / name).symlink_to(at)
    monkeypatch.setenv("PATH", str(folder))
    monkeypatch.setattr(tools, "module", lambda name: None)
    monkeypatch.delenv("QUIRE_BROWSER", raising=False)


def test_pdf_tools_are_tried_in_turn(monkeypatch, tmp_path):
    bin_ = tmp_path / "bin"
    alone(monkeypatch, bin_)
    with pytest.raises(RuntimeError, match="no tool found.*poppler.*pymupdf.*pypdf.*Calibre"):
        extract.pdf_text(b"%PDF-")
    fake(bin_, "pdftotext", "echo broken >&2; exit 3\n")
    fake(bin_, "ebook-convert", 'printf "page one\\fpage two" > "$2"\n')
    assert extract.pdf_text(b"%PDF-") == ("page one\fpage two", "calibre")
    with pytest.raises(RuntimeError, match="pdftotext: broken"):
        extract.pdf_text(b"%PDF-", "pdftotext")
    fake(bin_, "pdftotext", "echo '  '\n")
    fake(bin_, "ebook-convert", "exit 1\n")
    with pytest.raises(RuntimeError, match="pdftotext: no text came out.*calibre: exit code 1"):
        extract.pdf_text(b"%PDF-")
    fake(bin_, "pdftotext", 'cat "$5"\n')
    assert extract.pdf_text(b"some text") == ("some text", "pdftotext")


def test_pdf_and_office_files_are_documents(spark, monkeypatch, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"x")
    (tmp_path / "in/b.docx").write_bytes(b"y")
    got = {r.format: r for r in readers.documents(spark, str(tmp_path / "in")).collect()}
    assert "no text out of the PDF" in got["pdf"].problem and "no pandoc found" in got["docx"].problem
    meta = {"meta": {"title": {"t": "MetaInlines", "c": [{"t": "Str", "c": "My"}, {"t": "Space"}, {"t": "Emph", "c": [{"t": "Str", "c": "Book"}]}]}}}
    fake(tmp_path / "bin", "pandoc", f"""case "$*" in *json*) echo '{json.dumps(meta)}';; *) printf "# H\\n\\nbody\\n";; esac\n""")
    monkeypatch.setenv("PATH", f"{tmp_path}/bin:/usr/bin:/bin")
    assert extract.pandoc_markdown(b"y", "docx") == ("# H\n\nbody\n", "My Book", "")


def test_metadata_is_flattened():
    word = lambda s: {"t": "Str", "c": s}
    assert extract.flat_text(None) == "" and extract.flat_text({"t": "MetaString", "c": "a b"}) == "a b"
    link = {"t": "Link", "c": [["", [], []], [word("link")], ["u", ""]]}
    quoted = {"t": "Quoted", "c": [{"t": "DoubleQuote"}, [word("q")]]}
    span = {"t": "Span", "c": [["", [], []], [word("s")]]}
    inlines = [word("a"), {"t": "SoftBreak"}, {"t": "Strong", "c": [word("b")]}, {"t": "Space"}, link, quoted, span, {"t": "Code", "c": [["", [], []], "c"]}, {"t": "Note", "c": [word("n")]}]
    assert extract.flat_text({"t": "MetaInlines", "c": inlines}) == "a b linkqsc"
    assert extract.flat_text({"t": "MetaList", "c": [{"t": "MetaString", "c": "x"}, {"t": "MetaString", "c": ""}, {"t": "MetaString", "c": "y"}]}) == "x; y"
    assert extract.flat_text({"t": "MetaMap", "c": {"k": {"t": "MetaBlocks", "c": [{"t": "Para", "c": [word("z")]}]}}}) == "z"


PANDOC = """for last; do out="$prev"; prev="$last"; done
case "$*" in *--help*) echo --epub-title-page;; *) while [ $# -gt 0 ]; do [ "$1" = -o ] && out="$2"; shift; done; cat book.md > "$out";; esac
"""


def test_exports_skip_with_the_reason(monkeypatch, tmp_path):
    alone(monkeypatch, tmp_path / "bin")
    done = export.export("# A\n", str(tmp_path / "a"))
    assert set(done["produced"]) == {"md"} and set(done["skipped"]) == {"html", "docx", "epub", "pdf"}
    assert "pandoc" in done["skipped"]["html"] and done["skipped"]["pdf"] == "there is no HTML to render"


def test_exports_with_tools(monkeypatch, tmp_path):
    bin_ = tmp_path / "bin"
    alone(monkeypatch, bin_)
    fake(bin_, "pandoc", PANDOC)
    done = export.export("# A\n", str(tmp_path / "a"), export.Options(alias="My Book: 1/2"))
    assert set(done["produced"]) == {f"{n}{x}" for n in ("md", "html", "docx", "epub") for x in ("", "_alias")}
    assert (tmp_path / "a/My-Book-1-2.epub").read_text() == "# A\n" and "no tool found" in done["skipped"]["pdf"]
    # a browser that fails, one that complains after a good file
    fake(bin_, "chromium", "echo crashed >&2; exit 1\n")
    fake(bin_, "wkhtmltopdf", 'for last; do :; done; { printf "%%PDF-"; head -c 2000 /dev/zero; } > "$last"; exit 1\n')
    done = export.export("# A\n", str(tmp_path / "b"), export.Options(("pdf",)))
    assert set(done["produced"]) == {"md", "pdf"} and done["renderer"] == "wkhtmltopdf" and not done["skipped"]
    done = export.export("# A\n", str(tmp_path / "b"), export.Options(("pdf",), renderer="chrome"))
    assert "chrome: crashed" in done["skipped"]["pdf"] and not (tmp_path / "b/book.pdf").exists()
    bad = export.export('<img src="x" "bad>\n', str(tmp_path / "c"), export.Options(("html",)))
    assert "malformed" in bad["skipped"]["html"]


def test_books_are_exported_by_tasks(spark, tmp_path):
    books = spark.createDataFrame([(1, "T", "# One\n"), (2, "U", "# Two\n")], "doc_id long, title string, text string")
    done = export.export_books(books, str(tmp_path / "out"), export.Options(("md",))).collect()
    assert sorted((r.doc_id, r.format) for r in done) == [(1, "md"), (2, "md")] and (tmp_path / "out/2/book.md").read_text() == "# Two\n"


def test_capabilities(monkeypatch, tmp_path):
    bin_ = tmp_path / "bin"
    alone(monkeypatch, bin_)
    none = tools.capabilities()
    assert none["outputs"] == ["md"] and set(none["hints"]) == {"pandoc", "pdf_input", "pdf_output"} and none["pandoc"] == {"ok": False, "version": None, "path": None}
    fake(bin_, "pandoc", "echo pandoc 3.1.2\n")
    fake(bin_, "pdftotext", "")
    fake(bin_, "mybrowser", "")
    monkeypatch.setenv("QUIRE_BROWSER", "mybrowser")
    some = tools.capabilities()
    assert some["pandoc"]["version"] == "3.1.2" and some["pdf_extractors"] == ["pdftotext"] and some["pdf_renderers"] == {"chrome": str(bin_ / "mybrowser")}
    assert "pdf" in some["outputs"] and "docx" in some["inputs"] and not some["hints"]


def test_columns_of_files(spark):
    df = spark.createDataFrame([("My Book: 1/2", b"%PDF-" + b"x" * 1100), ("***", b"%PDF-")], "t string, c binary")
    assert [(r[0], r[1]) for r in df.select(writers.alias_name("t", "pdf"), writers.is_pdf("c")).collect()] == [("My-Book-1-2.pdf", True), ("book.pdf", False)]
    page = spark.createDataFrame([("T", "# H\n\na < b")], "t string, b string").select(writers.html_page("t", "b")).first()[0]
    assert "<h1>H</h1>" in page and "a &lt; b" in page


def test_arrivals(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\n\ntwo", "en", "s", 8)], arrivals.SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    q = arrivals.chunk_arrivals(arrivals.new_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert [r.text for r in got.collect()] == [r.text for r in segment.chunk_table(docs).collect()]
