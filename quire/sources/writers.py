"""Writers and exports."""

from __future__ import annotations

import html
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lint

def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Replaces a table; readers see the old one or the new one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_reports(linted: DataFrame, path: str, strict: bool = False) -> None:
    """Reports of linted pairs: every chunk's findings, and per document the roll-up with the totals of fixes.
    The pairs are linted once; the roll-up reads what was written."""
    linted.write.mode("overwrite").parquet(f"{path}/findings")
    done = linted.sparkSession.read.schema(linted.schema).parquet(f"{path}/findings")
    done.write.mode("overwrite").json(f"{path}/lint")
    lint.per_chunk(done).write.mode("overwrite").json(f"{path}/lint_chunks")
    lint.summary(done, strict).write.mode("overwrite").json(f"{path}/lint_summary")


def write_books(books: DataFrame, path: str) -> None:
    """(doc_id, title, text) as a table, many books a file; see export.export_books for files."""
    write_table(books.select("doc_id", "title", "text"), path)


def html_page(title: Column | str, body: Column | str, css: str = "") -> Column:
    """A page of Markdown paragraphs and headings; other syntax stays as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            pages = []
            for name, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                parts = []
                for block in (text or "").split("\n\n"):
                    level = len(block) - len(block.lstrip("#"))
                    inner = html.escape(block.lstrip("# ").strip())
                    if inner:
                        parts.append(f"<h{level}>{inner}</h{level}>" if 0 < level < 7 else f"<p>{inner}</p>")
                pages.append(f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(name or '')}</title><style>{css}</style></head>\n<body>\n" + "\n".join(parts) + "\n</body></html>\n")
            yield pd.Series(pages)

    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.pandas_udf(run, "string")(F.struct(column(title).alias("t"), column(body).alias("b")))


def is_pdf(content: Column | str) -> Column:
    """Longer than 1024 bytes and begins as a PDF does."""
    c = F.col(content) if isinstance(content, str) else content
    return (F.octet_length(c) > 1024) & (F.substring(c, 1, 5) == F.lit(b"%PDF-"))


def alias_name(title: Column | str, extension: str) -> Column:
    return F.concat(T.slug(title), F.lit(f".{extension}"))


def cleanup(folder: str) -> list[str]:
    """Removes lint reports and the merged text of a run folder; the names removed."""
    gone = [p for pattern in ("lint_*.json", "merged.md") for p in Path(folder).glob(pattern)]
    for p in gone:
        p.unlink()
    return sorted(p.name for p in gone)


def session(app: str = "quire", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
