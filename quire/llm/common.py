"""What the training-data operators share: reading documents, shared folders, sizing.

Rules that hold for every operator of this subpackage:

* a row whose ``doc_id`` is null names no document and is left out;
* a null text counts as the empty text;
* further columns are ignored (or passed through by filtering stages), whatever their names;
* a repeated row is a document of its own and is returned as often as it occurs; filters decide on
  rows, never on ids alone, and keep one of several equal rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null ids left out, null texts empty, other columns dropped."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, least: int = 100_000) -> DataFrame:
    """rows joined with groups (one row a key; size: how many of the rows have it), whatever the skew.

    Keys with at least max(least, a thousandth of all rows) rows are at most a thousand, so they
    are broadcast; the other keys meet in an ordinary shuffled join.  groups must be a written
    table, since it is read more than once.
    """
    total, most = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit = max(least, -(-total // 1000))
    if most < limit:
        return rows.join(groups, key)
    heavy, cold = F.broadcast(groups.where(F.col(size) >= limit)), groups.where(F.col(size) < limit)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(cold, key))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the cluster names none, and only in local mode (tests), a temporary
    folder is made: there one process does all the work.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(__import__("shutil").rmtree, made.removeprefix("file://"), True)
    return made


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def sweep() -> None:
    """Removes the tables that stash() wrote; runs when the driver ends, and may be called before."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # noqa: BLE001, S112 - a session that is gone leaves its tables to the cluster's clean-up
            continue


def discard(df: DataFrame) -> None:
    """Removes a table of stash() that nothing will read any more (the rounds of an iteration)."""
    found = [w for w in _written if w[1] == getattr(df, "_stashed_at", None)]
    for w in found:
        _written.remove(w)
        _remove(*w)


def stash(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written once as a table in the shared folder and read back: lineage ends there,
    so a lost executor costs no recomputation, and later readers scan only what they need."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    _written.append((spark, at))
    df.write.option("compression", codec).parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._stashed_at = at
    return back


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass without a shuffle of rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` bytes make up `total_bytes`."""
    return max(least, -(-total_bytes // each))
