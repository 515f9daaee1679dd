"""Content hashes, manifests, fingerprints and the checks before a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

KEY = ["doc_id", "chunk_no"]


def manifest(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, source_file, output_file, source_hash)."""
    name = T.chunk_id("chunk_no")
    return chunks.select(
        *KEY, name.alias("chunk_id"), F.concat(name, F.lit(".md")).alias("source_file"),
        F.concat(F.lit("output_"), name, F.lit(".md")).alias("output_file"), F.sha2("text", 256).alias("source_hash"),
    )


def nested_manifest(flat: DataFrame) -> DataFrame:
    """One row per document: chunk_count and the chunks in order."""
    chunk = F.struct("chunk_no", "chunk_id", "source_file", "source_hash", "output_file")
    return flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_sort(F.collect_list(chunk)).alias("chunks"))


def validate_for_merge(listed: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, severity, reason): the first failure of each listed chunk.

    listed: a manifest; sources: (doc_id, chunk_no, text); outputs: (doc_id, chunk_no, content
    binary).  Checked in turn: the source is there and has the recorded hash; the output is
    there, not empty, readable, not blank; a tenth of the source's bytes is a warning.
    """
    src = sources.select(*KEY, F.lit(True).alias("has_source"), F.sha2("text", 256).alias("now"), F.octet_length("text").alias("source_bytes"))
    out = outputs.select(
        *KEY, F.lit(True).alias("has_output"), F.octet_length("content").alias("output_bytes"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("readable"), T.is_blank(F.col("content").cast("string")).alias("blank"),
    )
    both = listed.join(src, KEY, "left").join(out, KEY, "left")
    reason = (
        F.when(F.col("has_source").isNull(), "source missing")
        .when(F.col("source_hash") != F.col("now"), "source changed")
        .when(F.col("has_output").isNull() | F.col("output_bytes").isNull(), "output missing")
        .when(F.col("output_bytes") == 0, "output empty")
        .when(~F.col("readable"), "output unreadable")
        .when(F.col("blank"), "output blank")
        .when(F.col("output_bytes") * 10 < F.col("source_bytes"), "output suspiciously short")
    )
    severity = F.when(F.col("reason") == "output suspiciously short", "warning").otherwise("error")
    return both.select(*KEY, reason.alias("reason")).where("reason is not null").withColumn("severity", severity)


def mergeable(listed: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, ok): documents none of whose chunks has an error."""
    bad = findings.where("severity = 'error'").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return listed.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("ok"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha256, size): what a later run compares."""
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def check_fingerprints(docs: DataFrame, before: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, state): new, same or changed; with force a changed source counts as new."""
    old = before.select("doc_id", F.col("sha256").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("sha256"), "same").otherwise("new" if force else "changed")
    return fingerprints(docs).join(old, "doc_id", "left").select("doc_id", state.alias("state"))


def to_rebuild(docs: DataFrame, built: DataFrame, chunk_size: int, force: bool = False) -> DataFrame:
    """Documents whose chunks cannot be reused; built: (doc_id, sha256, chunk_size, chunk_count)."""
    if force:
        return docs
    good = built.where((F.col("chunk_size") == chunk_size) & (F.col("chunk_count") > 0)).select("doc_id", "sha256")
    mine = docs.withColumn("sha256", F.sha2("text", 256))
    return mine.join(good, ["doc_id", "sha256"], "left_anti").drop("sha256")


def merge_config(new: DataFrame, old: DataFrame, kept: tuple[str, ...] = ("domain", "domain_detection", "book", "created")) -> DataFrame:
    """New run settings that keep what the earlier run decided."""
    shared = [c for c in kept if c in old.columns]
    before = old.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in shared])
    joined = new.join(before, "doc_id", "left")
    merged = {c: F.coalesce(f"old_{c}", c) if c in new.columns else F.col(f"old_{c}") for c in shared}
    return joined.withColumns(merged).drop(*[f"old_{c}" for c in shared])
