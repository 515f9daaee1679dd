"""Neighbours, sampling, batches, work queue and retries over chunk relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def neighbour_context(chunks: DataFrame, chars: int = 300, key: str = "doc_id", no: str = "chunk_no") -> DataFrame:
    """Per chunk: the tail of chunk no-1 and the head of chunk no+1, stripped; '' where that number is missing."""
    if chars < 0:
        raise ValueError("chars must not be negative")
    # only the excerpts travel through the window, not the chunks
    ends = chunks.select(key, no, F.right("text", F.lit(chars)).alias("tail"), F.left("text", F.lit(chars)).alias("head"))
    w = Window.partitionBy(key).orderBy(no)
    prev, following = F.lag(no).over(w) == F.col(no) - 1, F.lead(no).over(w) == F.col(no) + 1
    return ends.select(
        key, no,
        F.when(prev, F.col(no) - 1).alias("prev_no"),
        F.when(following, F.col(no) + 1).alias("next_no"),
        F.coalesce(F.when(prev, T.strip(F.lag("tail").over(w))), F.lit("")).alias("prev_excerpt"),
        F.coalesce(F.when(following, T.strip(F.lead("head").over(w))), F.lit("")).alias("next_excerpt"),
    )


def neighbour_prompt(context: DataFrame, no: str = "chunk_no") -> DataFrame:
    """context with prompt: the excerpts as fenced blocks, '' without any."""
    block = lambda title, n, text: F.when(F.col(text) != "", F.concat(
        F.lit(f"{title} chunk excerpt ("), T.chunk_id(n), F.lit(", read-only):\n```text\n"), text, F.lit("\n```")))
    return context.withColumn("prompt", F.concat_ws("\n\n", block("Previous", "prev_no", "prev_excerpt"), block("Next", "next_no", "next_excerpt")))


def batches(chunks: DataFrame, size: int = 6, key: str = "doc_id", no: str = "chunk_no") -> DataFrame:
    w = Window.partitionBy(key).orderBy(no)
    return chunks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("long"))


def review_sample(chunks: DataFrame, share: float = 0.10, least: int = 3, key: str = "doc_id", no: str = "chunk_no") -> DataFrame:
    """max(least, ceil(share n)) chunks of each document: the first, the last and evenly spaced ones between."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    ranked = chunks.withColumns({"n_chunks": n, "rn": F.row_number().over(w.orderBy(no))})
    k = F.least(F.col("n_chunks"), F.greatest(F.lit(least), F.ceil(F.col("n_chunks") * F.lit(share))))
    step = F.col("n_chunks") - 1
    # rn is chosen if some i in 0..k-1 rounds to it
    i = F.round((F.col("rn") - 1) * (k - 1) / F.nullif(step, F.lit(0))).cast("long")
    hit = F.floor(F.coalesce(i, F.lit(0)) * step / F.nullif(k - 1, F.lit(0)) + F.lit(0.5)) == F.col("rn") - 1
    return ranked.where(F.coalesce(hit, F.col("rn") == 1)).drop("rn")


def work_queue(chunks: DataFrame, outputs: DataFrame, force: bool = False, key: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """Chunks without an output, or with a blank one; all of them if forced."""
    if force:
        return chunks
    done = outputs.where(F.col("out_text").isNotNull() & ~T.is_blank("out_text")).select(*key)
    return chunks.join(done, list(key), "left_anti")


def retry_selection(
    findings: DataFrame, attempts: DataFrame, reviews: DataFrame | None = None, most: int = 2, low_score: int = 3,
    key: tuple[str, ...] = ("doc_id", "chunk_no"),
) -> DataFrame:
    """Chunks with an error and fewer than `most` attempts, or a review of low_score or less."""
    wrong = findings.where(F.col("severity") == "error").select(*key).distinct()
    tried = wrong.join(attempts, list(key), "left").where(F.coalesce("attempts", F.lit(0)) < most).select(*key)
    if reviews is None:
        return tried
    return tried.union(reviews.where(F.col("score") <= low_score).select(*key)).distinct()


def systematic_issues(issues: DataFrame, share: float = 0.5, no: str = "chunk_no") -> DataFrame:
    """Issue types found in at least `share` of a document's reviewed chunks; issues: (doc_id, chunk_no, type)."""
    per_type = issues.where(F.col("type").isNotNull()).groupBy("doc_id", "type").agg(F.countDistinct(no).alias("chunks"))
    sampled = issues.groupBy("doc_id").agg(F.countDistinct(no).alias("sampled"))
    return per_type.join(sampled, "doc_id").where(F.col("chunks") >= F.col("sampled") * F.lit(share))
