"""Whole runs over a run folder: convert, mine, translate, lint and build.

A run folder holds Parquet tables.  Every run writes chunks under a new version and then
records it, so a table is never read and replaced at once: chunks of unchanged documents
are carried over from the version before.  Outputs (doc_id, chunk_no, out_text) have
versions of their own; each keeps the hash of the chunk it is the translation of, and the
newest one counts: repairs are a new version, and an output of a chunk that has changed
since is neither merged nor taken for done.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import assemble, context, dictionary, integrity, lint, phrases, rewrite, segment
from quire.sources import export, readers, writers

CHUNKS = "doc_id long, chunk_no int, chunk_id string, text string"
DOCUMENTS = "path string, format string, method string, title string, author string, text string, problem string, doc_id long"
BOOK = "struct<title:string,subtitle:string,author:string,translator:string,publisher:string>"
BUILT = (
    "version long, tables long, doc_id long, input_file string, format string, method string, title string, author string, sha256 string, size long, chunk_size int, "
    f"chunk_count long, domain string, domain_detection string, book {BOOK}, created string"
)
OUTPUTS = "doc_id long, chunk_no int, out_text string"
STORED = f"{OUTPUTS}, source_hash string, version long"
Worker = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class Drift(RuntimeError):
    """A source is not the one that the run folder was made from."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001 - a table that no run has made yet has no rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _current(spark: SparkSession, run: str) -> tuple[int, DataFrame]:
    built = _read(spark, f"{run}/built", BUILT)
    version = built.agg(F.max("version")).first()[0] or 0
    return version, built.where(F.col("version") == version)


def _tables(spark: SparkSession, run: str) -> int:
    """The version of the chunks and the manifest that the current settings go with."""
    return _current(spark, run)[1].agg(F.max("tables")).first()[0] or 0


def chunks_of(spark: SparkSession, run: str) -> DataFrame:
    return _read(spark, f"{run}/chunks/version={_tables(spark, run)}", CHUNKS)


def settings(spark: SparkSession, run: str) -> DataFrame:
    """The run's settings, one row per document."""
    return _current(spark, run)[1]


def _next(versions: DataFrame) -> int:
    return (versions.agg(F.max("version")).first()[0] or 0) + 1


def configure(spark: SparkSession, run: str, decided: DataFrame) -> None:
    """Records decisions for documents, which later conversions keep.

    decided: doc_id, and any of domain, domain_detection and book; null leaves a setting as it is.
    """
    version, built = _current(spark, run)
    named = [c for c in ("domain", "domain_detection", "book") if c in decided.columns]
    new = decided.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in named])
    merged = built.join(new, "doc_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in named}).withColumn("version", F.lit(version + 1).cast("long"))
    merged.select(*built.columns).write.mode("append").parquet(f"{run}/built")


def convert(
    spark: SparkSession, source: str, run: str, target: int = segment.TARGET, force: bool = False, extractors: dict | None = None, **reading: object
) -> dict:
    """Reads the files of a folder; new documents, and all of them if the chunk size changed, are chunked.

    A document whose text is not the one that the run was made from is a Drift, unless forced; then it
    is chunked anew and what was translated of it before no longer counts.
    """
    version, built = _current(spark, run)
    at = f"{run}/documents/version={version + 1}"
    readers.documents(spark, source, extractors, **reading).withColumn("doc_id", F.xxhash64("path")).write.mode("overwrite").parquet(at)
    files = _read(spark, at, DOCUMENTS)
    docs = files.where("problem is null")
    changed = integrity.check_fingerprints(docs.select("doc_id", "text"), built, force).where("state = 'changed'")
    names = [r.path for r in changed.join(docs, "doc_id").select("path").orderBy("path").limit(5).collect()]
    if names:
        raise Drift(f"made from other sources: {', '.join(names)}; use a new run folder, or force")
    fresh = integrity.to_rebuild(docs.select("doc_id", "text"), built, target, force)
    kept = chunks_of(spark, run).join(docs.select("doc_id"), "doc_id", "left_semi").join(fresh.select("doc_id"), "doc_id", "left_anti")
    kept.unionByName(segment.chunk_table(fresh, target)).write.parquet(f"{run}/chunks/version={version + 1}")
    chunks = _read(spark, f"{run}/chunks/version={version + 1}", CHUNKS)
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    new = docs.join(counts, "doc_id").select(
        F.lit(version + 1).cast("long").alias("version"), F.lit(version + 1).cast("long").alias("tables"), "doc_id", F.col("path").alias("input_file"), "format", "method", "title", "author", F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size"), F.lit(target).alias("chunk_size"), "chunk_count", F.lit("auto").alias("domain"),
        F.lit(None).cast("string").alias("domain_detection"), F.lit(None).cast(BOOK).alias("book"), F.lit(datetime.now(UTC).isoformat(timespec="seconds")).alias("created"),
    )
    before = built.limit(0) if force else built
    merged = integrity.merge_config(new, before)
    merged.select(*new.columns).write.mode("append").parquet(f"{run}/built")
    integrity.manifest(chunks).write.parquet(f"{run}/manifest/version={version + 1}")
    skipped = [{"path": r.path, "problem": r.problem} for r in files.where("problem is not null").select("path", "problem").orderBy("path").limit(100).collect()]
    return {"documents": docs.count(), "rebuilt": fresh.count(), "chunks": chunks.count(), "skipped": skipped}


def _glossary(spark: SparkSession, run: str, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Terms and honorifics of a glossary file, by default the run's own; none where there is no file."""
    return readers.glossary(spark, path or f"{run}/glossary.json")


def expected_honorifics(terms: DataFrame, honorifics: DataFrame) -> list[tuple[str, list[str]]]:
    """(target, forms of its honorific) of the terms that have one: part of the lint's plan, as rules are."""
    forms = ("target", "female_target", "plural_target", *(["dual_target"] if "dual_target" in honorifics.columns else []))
    known = honorifics.select(F.col("id").alias("honorific"), F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in forms])).alias("forms"))
    rows = terms.where("target <> '' and honorific <> ''").join(known, "honorific").where(F.size("forms") > 0).orderBy("term_id").select("target", "forms").collect()
    return [(r.target, r.forms) for r in rows]


def domain(spark: SparkSession, run: str, terms: DataFrame | None = None, override: str | None = None) -> DataFrame:
    whole = assemble.merge(chunks_of(spark, run))
    wanted = dictionary.surface_list(terms) if terms is not None else []
    return dictionary.decide_domain(dictionary.domain_stats(whole, wanted), override=override)


def mine(spark: SparkSession, run: str, terms: DataFrame | None = None, least: int = 2, triggers: Sequence[str] = ()) -> DataFrame:
    known = dictionary.surface_index(terms) if terms is not None else None
    return phrases.candidates(chunks_of(spark, run), known, least, triggers=triggers)


def outputs_of(spark: SparkSession, run: str) -> DataFrame:
    """(doc_id, chunk_no, out_text, source_hash): the newest output of every chunk."""
    every = _read(spark, f"{run}/outputs", STORED)
    newest = every.groupBy("doc_id", "chunk_no").agg(F.max_by(F.struct("out_text", "source_hash"), "version").alias("o"))
    return newest.select("doc_id", "chunk_no", "o.out_text", "o.source_hash")


def save_outputs(spark: SparkSession, run: str, outputs: DataFrame) -> int:
    """Adds outputs (doc_id, chunk_no, out_text) of the current chunks as a new version; its number."""
    version = _next(_read(spark, f"{run}/outputs", STORED))
    sources = _read(spark, f"{run}/manifest/version={_tables(spark, run)}", "doc_id long, chunk_no int, source_hash string")
    outputs.select("doc_id", "chunk_no", "out_text").join(sources, ["doc_id", "chunk_no"]).write.parquet(f"{run}/outputs/version={version}")
    return version


def _fresh_outputs(spark: SparkSession, run: str) -> DataFrame:
    """The newest outputs of chunks that have not changed since."""
    sources = _read(spark, f"{run}/manifest/version={_tables(spark, run)}", "doc_id long, chunk_no int, source_hash string")
    return outputs_of(spark, run).join(sources, ["doc_id", "chunk_no", "source_hash"], "left_semi")


def translate(spark: SparkSession, run: str, worker: Worker, force: bool = False) -> int:
    """Puts the chunks in the work queue through a worker, frames of (doc_id, chunk_no, text) in, (doc_id,
    chunk_no, out_text) out, and saves what it gives; how many.  The model behind it is the caller's."""
    queue = context.work_queue(chunks_of(spark, run), _fresh_outputs(spark, run), force)
    if queue.isEmpty():
        return 0
    version = save_outputs(spark, run, queue.select("doc_id", "chunk_no", "text").mapInPandas(worker, OUTPUTS))
    return _read(spark, f"{run}/outputs/version={version}", OUTPUTS).count()


def pairs(spark: SparkSession, run: str) -> DataFrame:
    outputs = _fresh_outputs(spark, run).select("doc_id", "chunk_no", F.col("out_text").alias("out"))
    return chunks_of(spark, run).withColumnRenamed("text", "src").join(outputs, ["doc_id", "chunk_no"], "left")


def check(spark: SparkSession, run: str, rules: str | None = None, fix: bool = False, strict: bool = False, glossary: str | None = None) -> dict:
    """Lints all pairs and writes the reports; with fix the repaired outputs are linted and become the
    newest ones.  Honorifics go by the glossary."""
    compiled, both, fixes = rewrite.load_rules(rules), pairs(spark, run), {}
    expected = expected_honorifics(*_glossary(spark, run, glossary))
    if fix:
        at = f"{run}/fixed"
        fixed = both.withColumn("f", rewrite.apply_fixes("out", compiled)).withColumn("changed", F.col("out").isNotNull() & (F.col("out") != F.col("f.text")))
        fixed.select("doc_id", "chunk_no", "src", F.when(F.col("out").isNotNull(), F.col("f.text")).alias("out"), F.col("f.fixes").alias("fixes"), "changed").write.mode("overwrite").parquet(at)
        both = _read(spark, at, "doc_id long, chunk_no int, src string, out string, fixes map<string,int>, changed boolean")
        repaired = both.where("changed").select("doc_id", "chunk_no", F.col("out").alias("out_text"))
        if not repaired.isEmpty():
            save_outputs(spark, run, repaired)
        both = both.drop("changed")
    writers.write_reports(lint.lint(both, expected, rewrite.spelling_matches(F.coalesce("out", F.lit("")), compiled)), f"{run}/reports", strict)
    rolled = spark.read.json(f"{run}/reports/lint_summary", schema="chunks long, errors long, warnings long, fixes map<string,long>")
    chunks, errors, warnings = (int(x or 0) for x in rolled.agg(F.sum("chunks"), F.sum("errors"), F.sum("warnings")).first())
    for r in rolled.select(F.explode("fixes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect():
        fixes[r.k] = r.n
    return {"chunks": chunks, "errors": errors, "warnings": warnings, "fixes": fixes, "failed": errors > 0 or (strict and warnings > 0)}


def seed_glossary(spark: SparkSession, run: str, terms: DataFrame, domain_name: str | None = None) -> DataFrame:
    return dictionary.seed(chunks_of(spark, run), terms, domain_name)


def term_tables(spark: SparkSession, run: str, glossary: str | None = None, top_n: int = 25, most: int = 60) -> DataFrame:
    terms, honorifics = _glossary(spark, run, glossary)
    return assemble.term_table(dictionary.select_terms(chunks_of(spark, run), terms, top_n, most).join(dictionary.resolve_honorifics(terms, honorifics), "term_id"))


def prompts(spark: SparkSession, run: str, kind: str = "translate", glossary: str | None = None, template: str | None = None, instructions: str = "", **more: object) -> DataFrame:
    """(doc_id, chunk_no, prompt): for a retry with the findings of the last lint, for a glossary with the candidates."""
    chunks = chunks_of(spark, run)
    near = context.neighbour_prompt(context.neighbour_context(chunks))
    feedback, found = None, ""
    if kind == "retry":
        reports = _read(spark, f"{run}/reports/findings", f"doc_id long, chunk_no int, findings array<{lint.FINDING}>")
        feedback = reports.select("doc_id", "chunk_no", assemble.format_findings(F.col("findings")).alias("feedback"))
    if kind == "glossary":
        found = assemble.candidate_list(mine(spark, run))
    tables = None if kind == "glossary" else term_tables(spark, run, glossary)
    return assemble.prompts(chunks, template or assemble.TEMPLATES[kind], kind, tables, near, feedback, instructions=instructions, run_dir=run, candidates=found, **more)


def build(spark: SparkSession, run: str, folder: str | None = None, options: export.Options | None = None) -> dict:
    """Books of all documents whose outputs pass the merge checks and show the source's images; the others
    with their first problem.  folder: where to export files, which executors share."""
    _, built = _current(spark, run)
    outputs = outputs_of(spark, run)
    recorded = outputs.select("doc_id", "chunk_no", F.col("source_hash").alias("then"))
    # what an output was made from is the recorded hash of its chunk
    listed = spark.read.parquet(f"{run}/manifest/version={_tables(spark, run)}").join(recorded, ["doc_id", "chunk_no"], "left")
    listed = listed.withColumn("source_hash", F.coalesce("then", "source_hash")).drop("then")
    found = integrity.validate_for_merge(listed, chunks_of(spark, run), outputs.select("doc_id", "chunk_no", F.col("out_text").cast("binary").alias("content")))
    parity = assemble.image_parity(pairs(spark, run).where("out is not null")).select(
        "doc_id", "chunk_no", F.concat(F.lit("image "), "problem", F.lit(" "), "item").alias("reason"), F.lit("error").alias("severity")
    )
    found = found.unionByName(parity)
    writers.write_table(found, f"{run}/build_findings")
    found = spark.read.schema(found.schema).parquet(f"{run}/build_findings")
    good = integrity.mergeable(listed, found).where("ok").select("doc_id")
    merged = assemble.merge(outputs.withColumnRenamed("out_text", "text").join(good, "doc_id", "left_semi"))
    text = merged.withColumn("text", rewrite.wrap_arabic("text"))
    chosen = lambda c: F.coalesce(F.nullif(F.col(f"book.{c}"), F.lit("")), F.col(c) if c in ("title", "author") else F.lit(None).cast("string")).alias(c)
    cover = F.lit(os.path.basename(options.cover) if options and options.cover else None).cast("string")
    meta = built.select("doc_id", *[chosen(c) for c in ("title", "subtitle", "author", "translator", "publisher")], cover.alias("cover_image"), F.lit(None).cast("string").alias("date"))
    writers.write_books(assemble.book(text, meta).join(meta.select("doc_id", "title"), "doc_id"), f"{run}/books")
    books, done = _read(spark, f"{run}/books", "doc_id long, title string, text string"), {}
    if folder:
        export.export_books(books, folder, options).write.mode("overwrite").parquet(f"{run}/exports")
        for r in spark.read.parquet(f"{run}/exports").groupBy("format", F.col("path").isNotNull().alias("made")).agg(F.count(F.lit(1)).alias("n"), F.min("reason").alias("reason")).collect():
            done.setdefault("produced" if r.made else "skipped", {})[r.format] = r.n if r.made else r.reason
    bad = found.where("severity = 'error'")
    return {"books": books.count(), "errors": bad.count(), "first": [r.asDict() for r in bad.orderBy("doc_id", "chunk_no").limit(10).collect()], **done}
