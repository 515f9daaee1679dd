"""python -m quire COMMAND: the last line of the output is JSON; exit 0 for success, 1 for findings, 2 for misuse."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import dictionary
from quire.plans import jobs
from quire.sources import export, readers, tools, writers

Done = tuple[object, int]


def _rows(df: DataFrame) -> Done:
    """Prints rows as they come; the last line says how many."""
    n = 0
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        n += 1
    return {"rows": n}, 0


def _glossary(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return readers.glossary(spark, a.glossary or f"{a.run}/glossary.json")


def _terms(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return _glossary(spark, a)[0] if a.glossary else None


def _convert(spark: SparkSession, a: argparse.Namespace) -> Done:
    done = jobs.convert(spark, a.source, a.run, a.chunk_size, a.force, pdf_method=a.pdf_method, keep_page_numbers=a.keep_page_numbers)
    return done, 0 if done["documents"] else 1


def _lint(spark: SparkSession, a: argparse.Namespace) -> Done:
    done = jobs.check(spark, a.run, a.rules, a.fix, a.strict, a.glossary)
    return done, int(done["failed"])


def _build(spark: SparkSession, a: argparse.Namespace) -> Done:
    options = export.Options(tuple(a.formats.split(",")), a.toc_depth, a.cover, a.export_name, a.pdf_renderer, a.page_size)
    done = jobs.build(spark, a.run, a.out, options)
    return done, int(done["errors"] > 0)


def _add(spark: SparkSession, a: argparse.Namespace) -> Done:
    """Adds terms of a JSON file to the run's glossary file's table, which is written beside it."""
    terms, _ = _glossary(spark, a)
    new = readers.json_relation(spark, a.from_json, readers.TERM_FIELDS)
    rows = [dictionary.row_of(r, i) for i, r in enumerate(new.collect(), terms.count())]
    merged, refused = dictionary.add_terms(terms, dictionary.load_terms(spark, rows))
    writers.write_table(merged, f"{a.run}/glossary")
    return {"added": merged.count() - terms.count(), "refused": [r.asDict() for r in refused.collect()]}, int(refused.count() > 0)


def _validate(spark: SparkSession, a: argparse.Namespace) -> Done:
    done, _ = _rows(dictionary.validate(*_glossary(spark, a), strict=a.strict))
    return done, int(done["rows"] > 0)


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], Done]] = {
    "convert": _convert,
    "domain": lambda s, a: _rows(jobs.domain(s, a.run, _terms(s, a), a.override)),
    "candidates": lambda s, a: _rows(jobs.mine(s, a.run, _terms(s, a), a.min_freq)),
    "lint": _lint,
    "build": _build,
    "seed": lambda s, a: _rows(jobs.seed_glossary(s, a.run, _glossary(s, a)[0], a.override)),
    "add": _add,
    "validate": _validate,
    "list": lambda s, a: _rows(dictionary.by_category(_glossary(s, a)[0], a.category)),
    "count": lambda s, a: _rows(dictionary.recount(jobs.chunks_of(s, a.run), _glossary(s, a)[0]).select("source", "frequency")),
    "terms": lambda s, a: _rows(jobs.term_tables(s, a.run, a.glossary)),
    "context": lambda s, a: _rows(jobs.context.neighbour_prompt(jobs.context.neighbour_context(jobs.chunks_of(s, a.run), a.chars)).select("doc_id", "chunk_no", "prompt")),
    "prompt": lambda s, a: _rows(jobs.prompts(s, a.run, a.kind, a.glossary, instructions=a.instructions)),
    "manifest": lambda s, a: _rows(jobs.integrity.manifest(jobs.chunks_of(s, a.run))),
    "settings": lambda s, a: _rows(jobs.settings(s, a.run)),
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quire")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        if name == "convert":
            s.add_argument("source")
        s.add_argument("run")
        s.add_argument("--glossary")
        for flag in ("--fix", "--strict", "--force", "--keep-page-numbers"):
            s.add_argument(flag, action="store_true")
        for text in ("--rules", "--override", "--category", "--cover", "--export-name", "--out"):
            s.add_argument(text)
        s.add_argument("--from-json", required=name == "add")
        s.add_argument("--chunk-size", type=int, default=4500)
        s.add_argument("--min-freq", type=int, default=2)
        s.add_argument("--chars", type=int, default=300)
        s.add_argument("--toc-depth", type=int, default=2)
        s.add_argument("--kind", choices=("translate", "retry", "review", "glossary"), default="translate")
        s.add_argument("--instructions", default="")
        s.add_argument("--formats", default="md")
        s.add_argument("--pdf-method", default="auto")
        s.add_argument("--pdf-renderer", default="auto")
        s.add_argument("--page-size", default="A5")
    sub.add_parser("doctor")
    return p


def main(args: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "doctor":
        print(json.dumps(tools.capabilities()))
        return 0
    try:
        done, code = COMMANDS[a.command](writers.session(), a)
    except (jobs.Drift, ValueError) as e:
        print(json.dumps({"error": str(e)}, ensure_ascii=False))
        return 2
    print(json.dumps(done, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
