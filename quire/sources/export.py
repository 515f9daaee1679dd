"""Books as files: Markdown, HTML with contents and cover, DOCX, EPUB, PDF.

A format whose tool is absent or fails is skipped with the reason.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from quire.operators.assemble import image_tags
from quire.sources import tools

FORMATS = ("md", "html", "docx", "epub", "pdf")
_RENDER_SECONDS, _PANDOC_SECONDS = 180, 600
CSS = """body { max-width: 38em; margin: 2em auto; padding: 0 1em; font-family: serif; line-height: 1.6; }
.arabic, .arabic-block { direction: rtl; font-family: "Amiri", "Scheherazade New", serif; font-size: 1.3em; }
.arabic-block { text-align: center; margin: 1em 0; }
.cover { text-align: center; margin-bottom: 3em; }
.front-matter { display: none; }
@page { size: A5; margin: 18mm 16mm; }
"""
TEMPLATE = """<!DOCTYPE html>
<html lang="$if(lang)$$lang$$else$ur-Latn$endif$">
<head>
<meta charset="utf-8">
<title>$if(title-meta)$$title-meta$$else$$title$$endif$</title>
<style>
$css$
</style>
</head>
<body>
<header class="cover">
$if(cover-image)$<img src="$cover-image$" alt="">$endif$
<h1>$title$</h1>
$if(subtitle)$<p>$subtitle$</p>$endif$
$if(author)$<p>$for(author)$$author$$sep$, $endfor$</p>$endif$
$if(translator)$<p>$translator$</p>$endif$
$if(publisher)$<p>$publisher$</p>$endif$
$if(date)$<p>$date$</p>$endif$
</header>
$if(toc)$<nav>$toc$</nav>$endif$
<main>$body$</main>
</body>
</html>
"""


def is_pdf_file(path: str | Path) -> bool:
    p = Path(path)
    return p.is_file() and p.stat().st_size > 1024 and p.read_bytes()[:5] == b"%PDF-"


def _rendered(command: Callable[[list[str], str, str, str, str], list[str]]) -> Callable[..., str]:
    """Runs a renderer; the file decides, since some renderers complain after writing a good one."""

    def do(tool: list[str], page: str, target: str, paper: str) -> str:
        Path(target).unlink(missing_ok=True)
        said = ""
        with tempfile.TemporaryDirectory() as scratch:
            try:
                tools.run(command(tool, page, target, paper, scratch), _RENDER_SECONDS)
            except RuntimeError as e:
                said = str(e)
        if not is_pdf_file(target):
            raise RuntimeError(said or "no PDF was written")
        return target

    return do


def _browser(tool: list[str], page: str, target: str, paper: str, scratch: str) -> list[str]:
    sandbox = ["--no-sandbox"] if hasattr(os, "geteuid") and os.geteuid() == 0 else []
    flags = ["--headless=new", "--disable-gpu", "--no-first-run", "--no-default-browser-check", "--no-pdf-header-footer", "--virtual-time-budget=5000"]
    return [*tool, *flags, *sandbox, f"--user-data-dir={scratch}", f"--print-to-pdf={target}", Path(page).as_uri()]


def _wkhtmltopdf(tool: list[str], page: str, target: str, paper: str, scratch: str) -> list[str]:
    margins = [x for side, size in (("top", 18), ("bottom", 18), ("left", 16), ("right", 16)) for x in (f"--margin-{side}", f"{size}mm")]
    return [*tool, "--enable-local-file-access", "--page-size", paper, *margins, "--encoding", "utf-8", "--quiet", page, target]


#: Tried in this order.
RENDERERS = (
    tools.Way("chrome", tools.browser, _rendered(_browser)),
    tools.Way("wkhtmltopdf", lambda: tools.on_path("wkhtmltopdf"), _rendered(_wkhtmltopdf)),
    tools.Way("weasyprint", lambda: tools.on_path("weasyprint") or tools.module("weasyprint"), _rendered(lambda tool, page, target, paper, scratch: [*tool, page, target])),
    tools.Way("calibre", lambda: tools.on_path("ebook-convert") or tools.application("calibre"), _rendered(lambda tool, page, target, paper, scratch: [*tool, page, target, "--paper-size", paper.lower(), "--pdf-page-numbers"])),
)


def render_pdf(page: str, target: str, renderer: str = "auto", paper: str = "A5", ways: Sequence[tools.Way] = RENDERERS) -> tuple[str, str]:
    """(path, renderer) of the PDF of an HTML file."""
    if not Path(page).is_file():
        raise RuntimeError(f"there is no {page}")
    return tools.first_way(ways, "no PDF", str(Path(page).resolve()), str(Path(target).resolve()), paper, wanted=renderer)


@dataclass(frozen=True)
class Options:
    formats: Sequence[str] = FORMATS
    toc_depth: int = 2
    cover: str | None = None
    alias: str | None = None
    renderer: str = "auto"
    paper: str = "A5"


class _Book:
    """One book's folder."""

    def __init__(self, folder: str, options: Options):
        self.at, self.o = Path(folder), options
        self.pandoc = tools.on_path("pandoc")
        self.common = ["book.md", "-f", "markdown+smart", "--toc", f"--toc-depth={options.toc_depth}", "--resource-path", str(self.at)]

    def _pandoc(self, *args: str) -> str:
        if self.pandoc is None:
            raise RuntimeError(f"no pandoc found. {tools.HINTS['pandoc']}")
        return tools.run([*self.pandoc, *args], _PANDOC_SECONDS, str(self.at))

    def html(self, target: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            template = Path(folder, "template.html")
            template.write_text(TEMPLATE.replace("$css$", CSS.replace("$", "$$")), encoding="utf-8")
            self._pandoc(*self.common, "-t", "html5", "--standalone", "--template", str(template), "-o", target)
        _, bad = image_tags(Path(target).read_text(encoding="utf-8"))
        if bad:
            raise RuntimeError(f"malformed img attributes {bad[:5]}")
        return "pandoc"

    def docx(self, target: str) -> str:
        self._pandoc(*self.common, "-o", target)
        return "pandoc"

    def epub(self, target: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            css = Path(folder, "book.css")
            css.write_text(CSS, encoding="utf-8")
            titled = ["--epub-title-page=true"] if "--epub-title-page" in self._pandoc("--help") else []
            cover = [f"--epub-cover-image={self.o.cover}"] if self.o.cover and Path(self.o.cover).is_file() else []
            self._pandoc(*self.common, "--css", str(css), "--metadata", "lang=ur-Latn", *titled, *cover, "-o", target)
        return "pandoc"

    def pdf(self, target: str) -> str:
        page = self.at / "book.html"
        if not page.is_file():
            raise RuntimeError("there is no HTML to render")
        return render_pdf(str(page), target, self.o.renderer, self.o.paper)[1]


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name).strip("-") or "book"


def export(text: str, folder: str, options: Options | None = None) -> dict:
    """One book into a folder: {"produced": {format: path}, "renderer": name, "skipped": {format: reason}}.

    The HTML that a PDF needs is written, but only counts as produced if it was asked for.
    """
    o = options or Options()
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "book.md").write_text(text, encoding="utf-8")
    book, produced, skipped, renderer = _Book(folder, o), {"md": str(at / "book.md")}, {}, None
    for name in FORMATS[1:]:
        target = at / f"book.{name}"
        if name not in o.formats and not (name == "html" and "pdf" in o.formats):
            continue
        target.unlink(missing_ok=True)
        try:
            by = getattr(book, name)(str(target))
            if not target.is_file():
                raise RuntimeError(f"{by} wrote no file")
            produced |= {name: str(target)} if name in o.formats else {}
            renderer = by if name == "pdf" else renderer
        except RuntimeError as e:
            skipped |= {name: str(e)} if name in o.formats else {}
    if o.alias:
        for name, path in list(produced.items()):
            produced[f"{name}_alias"] = shutil.copyfile(path, at / f"{slug(o.alias)}.{name}")
            produced[f"{name}_alias"] = str(produced[f"{name}_alias"])
    return {"produced": produced, "skipped": skipped, "renderer": renderer}


EXPORTED = "doc_id long, format string, path string, reason string"


def export_books(books: DataFrame, folder: str, options: Options | None = None) -> DataFrame:
    """(doc_id, format, path, reason): books (doc_id, title, text) as files in folder/doc_id, which executors share.

    Each task writes the books it holds; a book that is written again replaces its files.
    """
    o = options or Options()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                done = export(text, f"{folder}/{doc_id}", o)
                rows += [(doc_id, k, v, None) for k, v in done["produced"].items()] + [(doc_id, k, None, v) for k, v in done["skipped"].items()]
            yield pd.DataFrame(rows, columns=["doc_id", "format", "path", "reason"])

    return books.select("doc_id", "text").mapInPandas(run, EXPORTED)
