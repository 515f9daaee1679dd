"""Incremental runs: new files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import integrity, segment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def new_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the document files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def chunk_arrivals(stream: DataFrame, out: str, checkpoint: str, target: int = segment.TARGET, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Chunks and manifest of every batch, each in a folder of its own batch number, so that a
    batch run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = segment.chunk_table(batch, target)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        integrity.manifest(chunks).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")
        if then is not None:
            then(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
