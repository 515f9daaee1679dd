"""The corpus pipeline: documents that a quality classifier accepts, without exact copies,
near copies and repeated passages, packed into training sequences.

Each stage works on all that the one before it kept and is written as a table before the
next reads it, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import read_table, stash
from quire.llm.crf_quality import keep_good
from quire.llm.exact_dedup import drop_exact_copies
from quire.llm.packing import pack
from quire.llm.simhash import drop_near_copies
from quire.llm.suffix_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted on the labels table, accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids have too."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its training sequence."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packing)]

#: The classifier's scores are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
