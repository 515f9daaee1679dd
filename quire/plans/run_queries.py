"""The registered queries of what a run reads, keeps and reports, and of spelling, over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.spelling import SHIPPED_RULES
from quire.operators import assemble, dictionary, integrity, lint, rewrite
from quire.plans import fixtures as X
from quire.plans.lint_queries import CHECKS_SQL, EVERY, HONORIFICS, every_pair
from quire.plans.queries import ARABIC, CITED, PAIRS_SQL, pairs, query, turns
from quire.sources import readers, writers


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# --- bytes and extractors ---


def _bytes() -> Column:
    """Texts as bytes, every third with one that no UTF-8 text has."""
    return F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || chr(65533) ELSE text END) AS decoded, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS tolerant FROM documents")
def read_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes read with undecodable ones replaced, and read as no text if there are any."""
    read = _documents(spark, d).select("doc_id", _bytes().alias("content"))
    return read.select("doc_id", F.sha2(readers.decoded("content"), 256).alias("decoded"), F.sha2(readers.tolerant("content"), 256).alias("tolerant"))


@query(r"""
    SELECT doc_id, sha256(CASE WHEN doc_id % 4 >= 2 AND regexp_matches(text, '\S') THEN text WHEN doc_id % 4 = 3 THEN NULL ELSE source || ' by another tool' END) AS sha256 FROM documents""")
def first_extracts(spark: SparkSession, d: str) -> DataFrame:
    """The first of three extractors whose text is not blank: one fails or gives blanks for half of the documents."""
    i = F.col("doc_id") % 4
    tools = [F.when(i >= 2, F.col("text")).when(i == 1, F.lit(" \n\t")), F.lit("\f \n"), F.when(i < 3, F.concat("source", F.lit(" by another tool")))]
    return _documents(spark, d).select("doc_id", F.sha2(readers.first_non_blank(*tools), 256).alias("sha256"))


@query("SELECT doc_id, doc_id % 2 = 0 AND strlen(text) + 5 > 1024 AS ok FROM documents")
def pdf_heads(spark: SparkSession, d: str) -> DataFrame:
    """Rendered files, every other one with the head of a PDF, tested for what a renderer must have made."""
    head = F.when(F.col("doc_id") % 2 == 0, "%PDF-").otherwise("%PS--")
    return _documents(spark, d).select("doc_id", writers.is_pdf(F.concat(head, "text").cast("binary")).alias("ok"))


# --- settings, decisions and reports ---


@query("""
    SELECT doc_id, chunk_size, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN lang ELSE 'auto' END AS domain, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS created
    FROM (SELECT doc_id, lang, length(text) AS chunk_size FROM documents)""")
def kept_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a second run over settings of a first one, which half of the documents have, some undecided."""
    docs = _documents(spark, d)
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("domain"), F.lit("first").alias("created"))
    new = docs.select("doc_id", F.length("text").cast("long").alias("chunk_size"), F.lit("auto").alias("domain"), F.lit("second").alias("created"))
    return integrity.merge_config(new, old)


@query("""
    SELECT doc_id, 'chosen' AS domain, 'override' AS confidence, CASE WHEN (words >= 8 AND density >= 3) OR strong >= 1.5 THEN 'islamic' ELSE 'general' END AS auto_domain
    FROM (SELECT doc_id, length(text) % 17 AS words, (length(text) % 64) / 8 AS density, (length(text) % 5) / 2 AS strong FROM documents)""")
def domain_override(spark: SparkSession, d: str) -> DataFrame:
    """A domain named by hand over statistics that go by the length of the text."""
    n = F.length("text")
    stats = _documents(spark, d).select(
        "doc_id", (n % 17).alias("distinct_terms"), ((n % 64) / 8).alias("hits_per_1000_words"), ((n % 5) / 2).alias("strong_hits_per_1000_words")
    )
    return dictionary.decide_domain(stats, override="chosen").select("doc_id", "domain", "confidence", "auto_domain")


@query(f"""{CHECKS_SQL}
    SELECT e.doc_id, e.chunk_no, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
    FROM {EVERY} e LEFT JOIN found f ON f.doc_id = e.doc_id AND f.chunk_no = e.chunk_no GROUP BY e.doc_id, e.chunk_no""")
def lint_per_chunk(spark: SparkSession, d: str) -> DataFrame:
    checks = [c for c in lint.CHECKS if c != "spelling"]
    return lint.per_chunk(lint.lint(every_pair(spark, d), HONORIFICS, checks=checks)).drop("ratio")


@query("""
    SELECT doc_id, chunk_no, array_to_string(list_concat(['Reviewer score: ' || coalesce(CAST(score AS VARCHAR), '?') || '/5. ' || said], list_filter([
        CASE WHEN short THEN '- length: "' || head || '" -> more' END, CASE WHEN chunk_no % 2 = 0 THEN '- issue: "" -> ' || head END], lambda x: x IS NOT NULL)), chr(10)) AS feedback
    FROM (SELECT conv_id AS doc_id, turn AS chunk_no, nullif(length(text) % 6, 0) AS score, 'Seen by ' || role AS said, length(text) < 80 AS short, replace(left(text, 12), chr(10), ' ') AS head FROM conversations)""")
def review_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of turns, by their length, as the text of a retry prompt."""
    head, none = F.replace(F.left("text", F.lit(12)), F.lit("\n"), F.lit(" ")), F.lit(None).cast("string")
    issue = lambda kind, quote, suggestion: F.struct(kind.alias("type"), quote.alias("quote"), suggestion.alias("suggestion"))
    issues = F.array_compact(F.array(F.when(F.length("text") < 80, issue(F.lit("length"), head, F.lit("more"))), F.when(F.col("chunk_no") % 2 == 0, issue(none, none, head))))
    score = F.nullif(F.length("text") % 6, F.lit(0))
    return turns(spark, d).select("doc_id", "chunk_no", assemble.format_review(score, F.concat(F.lit("Seen by "), "role"), issues).alias("feedback"))


# --- glossary ---

_NEW = [(2000 + i, name, aliases, target) for i, (name, aliases, target) in enumerate([
    ("Asia Minor", ["Anatolia"], "Asiya"), ("Levant", ["ASIA"], "Sham"), ("Sind", [], ""), ("Hejaz", ["anatolia "], "Hijaz"), ("Najd", ["Nejd"], "Najd"), ("nejd", [], "Nijd"), ("Nubia", [" france"], "Nuba"),
])]


@query(f"""
    WITH RECURSIVE new AS (
        SELECT term_id, target, list_filter(list_transform(list_prepend(source, aliases), lambda s: lower(trim(s))), lambda s: s <> '') AS keys
        FROM {X.sql_values([(i, s, a, t) for i, s, a, t in _NEW], "term_id, source, aliases, target")}),
    fold(term_id, taken, ok) AS (
        SELECT 1999, (SELECT list(lower(n_name)) FROM nation) || (SELECT list(lower(r_name)) FROM region), false
        UNION ALL
        SELECT new.term_id, CASE WHEN fine THEN taken || keys ELSE taken END, fine
        FROM fold, LATERAL (SELECT *, target <> '' AND NOT list_has_any(taken, keys) AS fine FROM new WHERE new.term_id = fold.term_id + 1) new)
    SELECT CAST(term_id AS INT) AS term_id, ok AS accepted FROM fold WHERE term_id >= 2000""")
def glossary_add(spark: SparkSession, d: str) -> DataFrame:
    """Terms added one after the other to a glossary of nations that also answer to their regions."""
    fields = "term_id int, source string, aliases array<string>, target string"
    named = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = named.select(F.col("n_nationkey").cast("int").alias("term_id"), F.col("n_name").alias("source"), F.array("r_name").alias("aliases"), F.col("n_name").alias("target"))
    glossary, refused = dictionary.add_terms(nations, spark.createDataFrame(_NEW, fields))
    return glossary.where("term_id >= 2000").select("term_id", F.lit(True).alias("accepted")).union(refused.select("term_id", F.lit(False)))


# --- spelling ---

#: The shipped rules that list their variants: what they look for, SQL has words for too.
LISTED = [r for r in SHIPPED_RULES if not r.get("regex")]
_EDGE = r"[^\p{L}\p{N}_'']"


def _variants_sql(rule: dict) -> str:
    """Variants of a rule in the text whose word-ending characters are doubled, so that one can end two words."""
    twice = [re.sub(r"([^\w'])", r"\1\1", v) for v in sorted(rule["reject"], key=lambda v: -len(v))]
    listed = "|".join(re.sub(r"([?.()])", r"\\\1", v) for v in twice).replace("'", "''")
    name = rule["canonical"].replace("'", "''")
    return f"SELECT doc_id, chunk_no, '{name}' AS canonical, unnest(regexp_extract_all(twice, '(?i)(?:^|{_EDGE})({listed})(?:$|{_EDGE})', 1)) AS found FROM t"


# what is protected becomes one character that no variant has: a letter for Arabic, a mark for the others
_OPEN_TEXT = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(out, '{CITED}', chr(1), 'g'), '`[^`\n]+`', chr(1), 'g'), '(https?://|www\.)\S+', 'h', 'g'), '[{ARABIC}][{ARABIC}\s]*', chr(1575), 'g')"


@query(f"""
    WITH t AS MATERIALIZED (SELECT doc_id, chunk_no, regexp_replace({_OPEN_TEXT}, '({_EDGE})', '\\1\\1', 'g') AS twice FROM ({PAIRS_SQL}))
    SELECT doc_id, chunk_no, canonical, regexp_replace(found, '({_EDGE}){_EDGE}', '\\1', 'g') AS variant, count(*) AS n
    FROM ({" UNION ALL ".join(map(_variants_sql, LISTED))}) GROUP BY ALL""")
def spelling_hits(spark: SparkSession, d: str) -> DataFrame:
    """Variants that the listing rules reject, as found outside protected spans."""
    found = pairs(spark, d).select("doc_id", "chunk_no", rewrite.spelling_matches("out", rewrite.compile_rules(LISTED)).alias("found"))
    return found.select("doc_id", "chunk_no", F.inline_outer("found")).where("n is not null")
