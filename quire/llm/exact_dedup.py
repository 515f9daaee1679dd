"""Exact dedup by skew-safe combining, with DataFrame operators only.

1. local: the partial aggregate of each input partition keeps one row per
   (digest, salt, whole text), so a group that holds a third of all rows leaves each
   partition as at most SALTS rows;
2. salted: those rows meet by (digest, salt, whole text);
3. global: the winners of the salts meet by (digest, whole text).

The whole text is part of the key at every stage: equal digests alone never merge rows.
The global stage also counts the different texts under a digest.  Every row took part in
that comparison, so under a digest with one text the digest names the text, and rows find
their winner by it; under a digest with several texts they find it by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quire.llm.common import documents, join_groups, stash

SALTS = 16
#: Equal rows laid out at a time.
BLOCK = 1 << 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest doc_id), group_size, variants (texts under
    the digest), text (null where it is the only one)."""
    keyed = documents(docs).select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # dealt by digest, so that the texts of one digest also meet for the count
    merged = salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    counted = merged.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("digest")))
    return counted.select("digest", "keep_id", "group_size", "variants", F.when(F.col("variants") > 1, F.col("text")).alias("text"))


def _one_kept(found: DataFrame, *also: str) -> DataFrame:
    """found (doc_id, digest, keep_id, group_size, also) with kept: true for one row of a group that has the
    largest doc_id.  Rows equal in doc_id and text are alike, so they are counted and laid out again."""
    stay = found.where("doc_id = keep_id").groupBy("digest", "keep_id", "group_size", *also).agg(F.count(F.lit(1)).alias("n"))
    block = stay.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.lit(BLOCK)))).alias("b"))
    place = F.sequence(F.col("b") * F.lit(BLOCK), F.least("n", (F.col("b") + 1) * F.lit(BLOCK)) - 1)
    again = block.select(F.col("keep_id").alias("doc_id"), "digest", "keep_id", "group_size", F.explode(place).alias("i")).withColumn("kept", F.col("i") == 0).drop("i")
    return again.unionByName(found.where("doc_id <> keep_id").select("doc_id", "digest", "keep_id", "group_size", F.lit(False).alias("kept")))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256, least_hot: int = 100_000) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, without any normalisation; null counts as empty and
    the empty text is a text like any other.  Of equal texts the row with the largest
    doc_id stays; of rows equal in doc_id and text too, one is marked as kept.  A repeated
    row counts in group_size and is returned each time.  Rows without doc_id are left out;
    an empty table gives an empty result.
    """
    won = stash(winners(docs, salts, digest))
    rows = documents(docs).withColumn("digest", digest(F.col("text")))
    # a digest of several texts has no winner by itself; none is known for SHA-256, so this part is empty in practice
    twins = won.where("variants > 1")
    met = join_groups(rows.select("doc_id", "digest"), won.where("variants = 1").drop("text", "variants"), "digest", "group_size", least_hot)
    found = _one_kept(stash(met))
    if not twins.isEmpty():
        found = found.unionByName(_one_kept(stash(rows.join(twins.drop("variants"), ["digest", "text"])), "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of docs, all columns, per distinct text: the one with the largest doc_id.

    Of several rows with that doc_id and text one stays, chosen by a hash of its columns.  Other
    rows that share its doc_id are untouched.  A null text counts as the empty text and comes out
    as it is.  Rows without doc_id are left out.
    """
    names = [c for c in docs.columns if c != "text"]
    hashed = [docs[f"`{f.name}`"] for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, MapType | VariantType)]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.where(docs["doc_id"].cast("long").isNotNull()).select(
        F.sha2(text, 256).alias("digest"),
        F.pmod(F.xxhash64(docs["doc_id"].cast("long")), F.lit(salts)).alias("salt"),
        text.alias("whole"),
        F.struct(docs["doc_id"].cast("long").alias("id"), F.xxhash64(*hashed, docs["text"].isNull()).alias("tie")).alias("rank"),
        F.struct(docs["text"].isNull().alias("blank"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
    )
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    salted = keyed.groupBy("digest", "salt", "whole").agg(*best)
    won = salted.groupBy("digest", "whole").agg(*best)
    place = {c: f"row.c{i}" for i, c in enumerate(names)}
    whole = F.when(~F.col("row.blank"), F.col("whole")).cast(docs.schema["text"].dataType).alias("text")
    return won.select(*[whole if c == "text" else F.col(place[c]).alias(c) for c in docs.columns])
