"""Text out of PDF and office formats, through whatever tool the machine has.

Every function takes the bytes of one file; columns run them in the executors, where a file
that no tool can read becomes a row with a problem.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.sources import tools

#: Formats that pandoc reads.
PANDOC_FORMATS = ("docx", "epub", "odt", "rtf", "fb2")
_PANDOC_SECONDS, _CALIBRE_SECONDS = 600, 1800


def _pdftotext(tool: list[str], path: str) -> str:
    return tools.run([*tool, "-enc", "UTF-8", "-eol", "unix", path, "-"], _PANDOC_SECONDS)


def _pymupdf(_: list[str], path: str) -> str:
    import fitz

    with fitz.open(path) as doc:
        return "\f".join(page.get_text("text") for page in doc)


def _pypdf(_: list[str], path: str) -> str:
    from pypdf import PdfReader

    return "\f".join(page.extract_text() or "" for page in PdfReader(path).pages)


def _calibre(tool: list[str], path: str) -> str:
    target = f"{path}.txt"
    tools.run([*tool, path, target], _CALIBRE_SECONDS)
    return Path(target).read_text(encoding="utf-8", errors="replace")


def _with_text(do: Callable[[list[str], str], str]) -> Callable[[list[str], str], str]:
    def checked(tool: list[str], path: str) -> str:
        text = do(tool, path)
        if not text.strip():
            raise RuntimeError("no text came out (a scan without text?)")
        return text

    return checked


#: Tried in this order.
PDF = (
    tools.Way("pdftotext", lambda: tools.on_path("pdftotext"), _with_text(_pdftotext)),
    tools.Way("pymupdf", lambda: tools.module("fitz"), _with_text(_pymupdf)),
    tools.Way("pypdf", lambda: tools.module("pypdf"), _with_text(_pypdf)),
    tools.Way("calibre", lambda: tools.on_path("ebook-convert") or tools.application("calibre"), _with_text(_calibre)),
)


def pdf_text(content: bytes, method: str = "auto", ways: Sequence[tools.Way] = PDF) -> tuple[str, str]:
    """(text with form feeds between pages, name of the tool); a RuntimeError with every tool's complaint."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "in.pdf")
        path.write_bytes(content)
        return tools.first_way(ways, "no text out of the PDF", str(path), wanted=method)


def flat_text(node: object) -> str:
    """Plain text of a value in pandoc's JSON, metadata or inline: strings as they are, any white space as one
    space, lists of metadata with semicolons, maps with commas, notes and raw markup left out."""
    kinds_of_space = ("Space", "SoftBreak", "LineBreak")

    def walk(x: object) -> str:
        if isinstance(x, list):
            return "".join(map(walk, x))
        if not isinstance(x, dict) or "t" not in x:
            return ""
        kind, c = x["t"], x.get("c")
        if kind in kinds_of_space:
            return " "
        if kind in ("Str", "MetaString"):
            return c
        if kind in ("Code", "Math"):
            return c[-1]
        if kind == "MetaList":
            return "; ".join(filter(None, map(flat_text, c)))
        if kind == "MetaMap":
            return ", ".join(filter(None, map(flat_text, c.values())))
        if kind in ("Span", "Quoted"):
            return walk(c[-1])
        if kind == "Link":
            return walk(c[1])
        return walk(c) if kind in ("MetaInlines", "MetaBlocks", "Emph", "Strong", "SmallCaps", "Strikeout", "Underline", "Para", "Plain") else ""

    return " ".join(walk(node).split())


def pandoc_markdown(content: bytes, form: str, media: str | None = None) -> tuple[str, str, str]:
    """(Markdown, title, author) of a file of one of PANDOC_FORMATS; pictures go to the folder media, if named."""
    tool = tools.on_path("pandoc")
    if tool is None:
        raise RuntimeError(f"no pandoc found. {tools.HINTS['pandoc']}")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, f"in.{form}")
        path.write_bytes(content)
        kept = [f"--extract-media={media}"] if media else []
        text = tools.run([*tool, str(path), "-t", "gfm", "--wrap=none", "--markdown-headings=atx", *kept], _PANDOC_SECONDS)
        try:
            meta = json.loads(tools.run([*tool, str(path), "-t", "json"], _PANDOC_SECONDS)).get("meta", {})
        except (RuntimeError, ValueError):
            meta = {}
    return text.replace(media, "media") if media else text, flat_text(meta.get("title")), flat_text(meta.get("author"))


_RESULT = "text string, method string, title string, author string, problem string"


def _column(read: Callable[[bytes, str], tuple[str | None, str | None, str | None, str | None]], content: Column, form: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, forms in batches:
            rows = []
            for data, name in zip(contents, forms, strict=True):
                if data is None:
                    rows.append((None,) * 5)
                    continue
                try:
                    rows.append((*read(bytes(data), name), None))
                except RuntimeError as e:
                    rows.append((None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return F.pandas_udf(run, _RESULT)(content, form)


def pdf_column(content: Column, form: Column, method: str = "auto") -> Column:
    """struct<text, method, title, author, problem> of PDF bytes; null content gives nulls."""
    return _column(lambda data, _: (*pdf_text(data, method), None, None), content, form)


def pandoc_column(content: Column, form: Column, media: str | None = None) -> Column:
    """The same of office formats; title and author null where they are empty."""

    def read(data: bytes, name: str) -> tuple[str, str, str | None, str | None]:
        text, title, author = pandoc_markdown(data, name, media)
        return text, "pandoc", title or None, author or None

    return _column(read, content, form)
