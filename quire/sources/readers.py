"""Readers: Markdown, text, HTML, extracted pages and JSON relations."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.python import per_text
from quire.operators import segment
from quire.sources import extract

MARKDOWN, TEXT, HTML = ("md", "markdown"), ("txt",), ("html", "htm")

_HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
_BLOCKS = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "body", "header", "footer", "main", *_HEADINGS, "li", "blockquote", "pre", "br", "hr"}
_SILENT = {"script", "style", "head", "noscript", "template"}


class _Markdown(HTMLParser):
    """Collects blocks of Markdown; tolerant of unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.lead = ""
        self.silent = 0
        self.pre = False
        self.lists: list[int | None] = []
        self.href: list[str] = []
        self.title: list[str] = []
        self.in_title = False
        self.meta: dict[str, str] = {}

    def flush(self) -> None:
        raw = "".join(self.text)
        body = raw.strip("\n") if self.pre else " ".join(raw.split())
        if body:
            self.blocks.append(f"```\n{body}\n```" if self.pre else self.lead + body)
        self.text, self.lead = [], ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag == "meta" and named.get("name") and named.get("content"):
            self.meta[named["name"].lower()] = named["content"]
        if tag in _SILENT:
            self.silent += 1
        if tag == "body":
            self.silent = 0
        if tag in _BLOCKS:
            self.flush()
            self.pre = self.pre or tag == "pre"
            self.lead = _HEADINGS.get(tag, "> " if tag == "blockquote" else "")
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            self.lead = "- " if number is None else f"{number + 1}. "
        elif tag == "a":
            self.href.append(named.get("href") or "")
            self.text.append("[" if self.href[-1] else "")
        elif tag == "img" and named.get("src"):
            self.text.append(f"![{named.get('alt') or ''}]({named['src']})")
        elif tag in ("b", "strong"):
            self.text.append("**")
        elif tag in ("i", "em"):
            self.text.append("*")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCKS:
            self.flush()
            if tag == "pre":
                self.pre = False
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.href:
            target = self.href.pop()
            self.text.append(f"]({target})" if target else "")
        elif tag in ("b", "strong"):
            self.text.append("**")
        elif tag in ("i", "em"):
            self.text.append("*")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)


def html_to_markdown(c: Column | str) -> Column:
    """struct<text, title, author> of a page."""

    def read(page: str) -> dict:
        p = _Markdown()
        p.feed(page)
        p.close()
        p.flush()
        text = re.sub(r"\n{3,}", "\n\n", "\n\n".join(p.blocks))
        return {"text": text + "\n" if text else "", "title": " ".join("".join(p.title).split()) or None, "author": p.meta.get("author")}

    return per_text(lambda: read, "text string, title string, author string", c, null="")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, format, content): whole files of any kind."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?\z", 1)
    return raw.select("path", stem.alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("format"), "content")


def decoded(content: Column | str) -> Column:
    """Bytes as text, undecodable ones replaced."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def tolerant(content: Column | str) -> Column:
    """Bytes as text, null if they do not decode."""
    return F.try_validate_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def first_non_blank(*extracted: Column | str) -> Column:
    """The first extractor's text that is not blank."""
    return F.coalesce(*[F.when(~T.is_blank(c), F.col(c) if isinstance(c, str) else c) for c in extracted])


def documents(
    spark: SparkSession, path: str, extractors: dict[str, Callable[[Column], Column]] | None = None, pdf_method: str = "auto",
    keep_page_numbers: bool = False, media: str | None = None,
) -> DataFrame:
    """(path, format, method, title, author, text, problem) of the files of a folder.

    Markdown, text and HTML are read here, PDF and office formats through the tools of the machine,
    or through extractors by format.  A file without a reader, whose tool fails, or whose text
    comes out blank, has a problem and no text.  The files are listed and read once; every format
    is a branch of one projection, and a branch sees only its own files' bytes.
    """
    form, content = F.col("format"), F.col("content")
    mine = {**dict.fromkeys(MARKDOWN, "markdown"), **dict.fromkeys(TEXT, "text"), **dict.fromkeys(HTML, "html"), "pdf": "pdf", **dict.fromkeys(extract.PANDOC_FORMATS, "office")}
    mine |= {name: f"{name} extractor" for name in extractors or {}}
    kind = F.lit(None).cast("string")
    for name, k in mine.items():
        kind = F.when(form == name, k).otherwise(kind)
    only = lambda k, c: F.when(F.col("kind") == k, c)
    raw = files(spark, path).withColumn("kind", kind)
    raw = raw.withColumn("raw", F.when(F.col("kind").isin("markdown", "text", "html"), decoded("content")))
    read = raw.withColumns({
        "html": html_to_markdown(only("html", F.col("raw"))), "pdf": extract.pdf_column(only("pdf", content), form, pdf_method),
        "office": extract.pandoc_column(only("office", content), form, media),
        **{f"by_{name}": extractor(only(f"{name} extractor", content)) for name, extractor in (extractors or {}).items()},
    })
    own = {name: segment.reflow(f"by_{name}", keep_page_numbers) if name == "pdf" else F.col(f"by_{name}") for name in extractors or {}}
    md = F.when(F.col("kind") == "markdown", F.col("raw")).when(F.col("kind") == "text", segment.txt_to_markdown("raw")).when(F.col("kind") == "html", F.col("html.text"))
    md = md.when(F.col("kind") == "pdf", segment.reflow("pdf.text", keep_page_numbers)).when(F.col("kind") == "office", F.col("office.text"))
    for name, text in own.items():
        md = md.when(F.col("kind") == f"{name} extractor", text)
    read = read.select(
        "path", "stem", "format", F.coalesce("pdf.method", "office.method", "kind").alias("method"), md.alias("md"), F.coalesce("html.title", "office.title").alias("title"),
        F.coalesce("html.author", "office.author").alias("author"), F.coalesce("pdf.problem", "office.problem").alias("problem"),
    )
    df = read.withColumn("clean", T.clean_markdown("md")).withColumn("text", F.when(~T.is_blank("clean"), F.col("clean")))
    problem = F.when(F.col("method").isNull(), F.concat(F.lit("no reader for "), "format")).when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("text").isNull(), "no text")
    return df.select("path", "format", "method", F.coalesce("title", T.first_title("text", "stem")).alias("title"), "author", "text", problem.alias("problem"))


def json_relation(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """A JSON file as a relation; malformed or missing input gives the default (or no rows)."""
    empty = default if default is not None else spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
        return empty if rows.where("_broken is not null").take(1) else rows.drop("_broken")
    except Exception as e:  # noqa: BLE001 - only a missing path is tolerated
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty


TERM_FIELDS = "source string, aliases array<string>, target string, category string, honorific string, gender string, plural boolean, note string, frequency bigint"
GLOSSARY_SCHEMA = (
    "version int, domain string, top_n int, honorifics array<struct<id:string,target:string,female_target:string,plural_target:string,"
    "dual_target:string,triggers:array<string>>>, terms array<struct<source:string,aliases:array<string>,target:string,category:string,"
    "honorific:string,gender:string,plural:boolean,note:string,frequency:bigint>>"
)


def glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, honorifics) of a glossary file; term_id is the position in it."""
    data = json_relation(spark, path, GLOSSARY_SCHEMA)
    terms = data.select(F.posexplode("terms").alias("term_id", "t")).select("term_id", "t.*")
    return terms, data.select(F.inline("honorifics"))


def chunk_listing(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of the manifest; for documents without one, those found by name."""
    return listed.select("doc_id", "chunk_no").union(found.join(listed.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "chunk_no"))
