"""The registered queries over (source, output) pairs: structure, citations, language, honorifics, script.

The pairs are those of the conversations and the inline ones, which have Markdown in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lint, rewrite
from quire.plans import fixtures as X
from quire.plans.queries import ARABIC, CITED, ENGLISH_WORDS, ORACLE_SQL, PAIRS_SQL, QUERIES, SPACE, UNTRANSLATED, pairs, query, squash, strip, turns

EVERY = f"""(
    SELECT doc_id, chunk_no, src, out FROM ({PAIRS_SQL})
    UNION ALL SELECT CAST(doc_id + 1000000 AS BIGINT), chunk_no, src, out FROM {X.sql_values(X.PAIRS, "doc_id, chunk_no, src, out")})"""


def every_pair(spark: SparkSession, d: str) -> DataFrame:
    inline = spark.createDataFrame([(r[0] + 1000000, *r[1:]) for r in X.PAIRS], "doc_id long, chunk_no long, src string, out string")
    return pairs(spark, d).unionByName(inline)


def _prose_sql(side: str) -> str:
    """Lines outside fences of one side of the pairs."""
    return rf"""
        SELECT doc_id, chunk_no, i, line FROM (
            SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id, chunk_no ORDER BY i) AS seen
            FROM (SELECT doc_id, chunk_no, i, lines[i] AS line, regexp_matches(lines[i], '^\s*(```|~~~)') AS fence
                  FROM (SELECT doc_id, chunk_no, lines, unnest(range(1, len(lines) + 1)) AS i
                        FROM (SELECT doc_id, chunk_no, string_split({side}, chr(10)) AS lines FROM {EVERY})))
        ) WHERE NOT fence AND seen % 2 = 0"""


_IMAGES = r"regexp_extract_all(regexp_replace(prose, '\\!\[', chr(2), 'g'), '!\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)', 1)"
_LINKS = r"regexp_extract_all(regexp_replace(prose, '!\[|\\\[', chr(2), 'g'), '\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)', 1)"


def _features_sql(side: str) -> str:
    return rf"""
        SELECT doc_id, chunk_no, headings, list_items, blockquotes, table_rows, fences, {_IMAGES} AS images, {_LINKS} AS links,
               list_distinct(regexp_extract_all(prose, '\[\^[^\]\s]+\]')) AS footnotes, arabic_chars
        FROM (
            SELECT p.doc_id, p.chunk_no, coalesce(headings, '') AS headings, coalesce(list_items, 0) AS list_items, coalesce(blockquotes, 0) AS blockquotes,
                   coalesce(table_rows, 0) AS table_rows, p.fences, coalesce(prose_text, '') AS prose, arabic_chars
            FROM (SELECT doc_id, chunk_no, len(list_filter(string_split({side}, chr(10)), lambda x: regexp_matches(x, '^\s*(```|~~~)'))) AS fences,
                         len(regexp_extract_all({side}, '[{ARABIC}]')) AS arabic_chars FROM {EVERY}) p
            LEFT JOIN (
                SELECT doc_id, chunk_no, string_agg(length(regexp_extract(line, '^(#{{1,6}})', 1)), ',' ORDER BY i) FILTER (regexp_matches(line, '^(#{{1,6}})\s+\S')) AS headings,
                       count(*) FILTER (regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+\S')) AS list_items, count(*) FILTER (regexp_matches(line, '^\s*>')) AS blockquotes,
                       count(*) FILTER (regexp_matches(line, '^\s*\|')) AS table_rows, string_agg(line, chr(10) ORDER BY i) AS prose_text
                FROM ({_prose_sql(side)}) GROUP BY doc_id, chunk_no) l ON l.doc_id = p.doc_id AND l.chunk_no = p.chunk_no)"""


@query(f"""
    SELECT doc_id, chunk_no, headings, list_items, blockquotes, table_rows, fences, array_to_string(images, ' ') AS images, array_to_string(links, ' ') AS links,
           array_to_string(list_sort(footnotes), ' ') AS footnotes, arabic_chars
    FROM ({_features_sql("src")})""")
def structure_features(spark: SparkSession, d: str) -> DataFrame:
    f = every_pair(spark, d).select("doc_id", "chunk_no", lint.features(F.col("src")).alias("f"))
    return f.select(
        "doc_id", "chunk_no", F.array_join(F.col("f.headings").cast("array<string>"), ",").alias("headings"), "f.list_items", "f.blockquotes", "f.table_rows", "f.fences",
        F.array_join("f.images", " ").alias("images"), F.array_join("f.links", " ").alias("links"), F.array_join(F.array_sort("f.footnotes"), " ").alias("footnotes"), "f.arabic_chars",
    )


@query(rf"""
    WITH a AS (SELECT doc_id, chunk_no, unnest(links) AS item FROM ({_features_sql("src")})), b AS (SELECT doc_id, chunk_no, unnest(links) AS item FROM ({_features_sql("out")})),
    x AS (SELECT doc_id, chunk_no, item, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT doc_id, chunk_no, item, count(*) AS n FROM b GROUP BY ALL)
    SELECT doc_id, chunk_no, item, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS missing, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS extra
    FROM x FULL JOIN y USING (doc_id, chunk_no, item) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    p = every_pair(spark, d)
    side = lambda c: p.select("doc_id", "chunk_no", F.explode(lint.features(F.col(c))["links"]).alias("item"))
    return lint.bag_difference(side("src"), side("out"), ["doc_id", "chunk_no"], "item")


@query(f"SELECT doc_id, chunk_no, line FROM ({_prose_sql('src')})")
def fence_mask(spark: SparkSession, d: str) -> DataFrame:
    prose, _ = lint.prose_lines(F.col("src"))
    return every_pair(spark, d).select("doc_id", "chunk_no", F.explode(prose).alias("line"))


_NUMBERS = r"list_filter(list_sort(list_distinct(regexp_extract_all(src, '\b\d+[:/]\d+\b'))), lambda r: NOT contains(out, r))"


@query(f"SELECT doc_id, chunk_no, unnest({_NUMBERS}) AS ref FROM {EVERY}")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    return every_pair(spark, d).select("doc_id", "chunk_no", F.explode(lint.missing_numbers(F.col("src"), F.col("out"))).alias("ref"))


_SCRIPT = f"list_sort(list_filter(list_distinct(regexp_extract_all(out, '[{ARABIC}]+')), lambda w: NOT list_contains(regexp_extract_all(src, '[{ARABIC}]+'), w)))"


@query(f"SELECT doc_id, chunk_no, unnest({_SCRIPT}) AS word FROM {EVERY}")
def script_words_new(spark: SparkSession, d: str) -> DataFrame:
    words = lint.set_minus(lint.arabic_words(F.col("out")), lint.arabic_words(F.col("src")))
    return every_pair(spark, d).select("doc_id", "chunk_no", F.explode(words).alias("word"))


HONORIFICS = [("Nabi", ["(Sallallahu Alaihi Wasallam)"])]
_LATIN = f"SELECT doc_id, chunk_no, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '[{ARABIC}]')), '') AS t FROM ({_prose_sql('out')}) GROUP BY doc_id, chunk_no"
_SON = r"(?i:bin|ibne|ibn-e|ibn|b\.)"
_SUBJECT = r"'\b(?:Rasoolullah|Nabi|Huzoor|Muhammad)\b'"
_LENGTHS = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
# where a mention ends: after the text before it and the mentions so far
_PROPHET_SQL = rf"""
    SELECT doc_id, chunk_no, k, substr(t, pos, 40) AS after FROM (
        SELECT *, CAST({_LENGTHS("rests[1:k]")} + {_LENGTHS("names[1:k]")} AS BIGINT) + 1 AS pos FROM (
            SELECT *, unnest(range(1, len(names) + 1)) AS k FROM (
                SELECT *, regexp_split_to_array(t, {_SUBJECT}) AS rests, regexp_extract_all(t, {_SUBJECT}) AS names FROM ({_LATIN}))))
    WHERE NOT regexp_matches(substr(t, pos, 40), '(?i)sallallahu\s+alaihi\s+wasallam')
      AND NOT (names[k] = 'Muhammad' AND (regexp_matches(substr(t, pos), '^\s+{_SON}(?:\W|$)') OR regexp_matches(left(t, pos - 1 - length(names[k])), '\b{_SON}\s{{0,9}}$')))"""


@query(f"SELECT doc_id, chunk_no, after FROM ({_PROPHET_SQL})")
def prophet_honorifics(spark: SparkSession, d: str) -> DataFrame:
    prose, _ = lint.prose_lines(F.col("out"))
    return every_pair(spark, d).select("doc_id", "chunk_no", F.explode(lint.missing_prophet_honorifics(prose)).alias("after"))


# mentions of "Nabi" outside citations: places of the word less those between the ends of a citation
_TERM_SQL = rf"""
    SELECT doc_id, chunk_no, pos, substr(low, pos + 4, 30) AS after FROM (
        SELECT *, unnest(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, 4) = 'nabi'
            AND NOT (i > 1 AND regexp_matches(substr(low, i - 1, 1), '[\p{{L}}\p{{N}}_'']')) AND NOT regexp_matches(substr(low, i + 4, 1), '[\p{{L}}\p{{N}}_'']'))) AS pos
        FROM (SELECT doc_id, chunk_no, lower(t) || chr(10) AS low, regexp_split_to_array(lower(t), '{CITED}') AS rests, regexp_extract_all(lower(t), '{CITED}') AS cites
              FROM ({_LATIN}) WHERE contains(lower(t), 'nabi')))
    WHERE len(list_filter(range(1, len(cites) + 1), lambda k:
            pos > {_LENGTHS("rests[1:k]")} + {_LENGTHS("cites[1:k - 1]")} AND pos <= {_LENGTHS("rests[1:k]")} + {_LENGTHS("cites[1:k]")})) = 0
      AND NOT contains(substr(low, pos + 4, 30), 'sallallahu alaihi wasallam')"""
_NEAR = r"regexp_matches(low, name || '(?:|[^()\n]{0,39}[^()\n0-9])' || n || '(?:[^0-9]|$)')"
_NAMED_SQL = rf"""
    SELECT doc_id, chunk_no, {squash("ref")} AS ref FROM (
        SELECT *, lower(list_filter(regexp_extract_all(regexp_extract(ref, '^\(([^:]*):', 1), '[A-Za-z'']+'), lambda w: length(w) > 2)[-1]) AS name,
               regexp_extract_all(regexp_extract(ref, ':(.*)\)$', 1), '\d+') AS numbers
        FROM (SELECT doc_id, chunk_no, lower({squash("out")}) AS low, unnest(regexp_extract_all(src, '\([A-Za-z][A-Za-z\s\-''.]*:\s*\d+[\d,\s]*\)')) AS ref FROM {EVERY} WHERE out IS NOT NULL))
    WHERE NOT contains(low, lower({squash("ref")})) AND NOT coalesce(name IS NOT NULL AND len(list_filter(numbers, lambda n: NOT {_NEAR})) = 0, false)"""


def _bag(word: str, a: str, b: str, c: str) -> str:
    times = lambda side: f"len(list_filter({side}.{c}, lambda y: y = x))"
    repeated = f"list_transform(range(greatest(0, {times(a)} - {times(b)})), lambda k: '{word} ' || x)"
    return f"flatten(list_transform(list_sort(list_distinct({a}.{c})), lambda x: {repeated}))"


def _set(word: str, a: str, b: str) -> str:
    return f"list_transform(list_sort(list_filter({a}.footnotes, lambda x: NOT list_contains({b}.footnotes, x))), lambda x: '{word} ' || x)"


def _structure_sql() -> str:
    join = "FROM a JOIN b USING (doc_id, chunk_no)"
    head = "SELECT doc_id, chunk_no, 'error' AS severity, 'E_STRUCTURE' AS code,"
    parts = [f"{head} 'headings' AS test, 1 AS n, ['source ' || a.headings, 'output ' || b.headings] AS detail {join} WHERE a.headings <> b.headings"]
    for c in ("list_items", "blockquotes", "table_rows", "fences"):
        parts.append(f"{head} '{c}', abs(b.{c} - a.{c}), ['source ' || a.{c}, 'output ' || b.{c}] {join} WHERE a.{c} <> b.{c}")
    for c, missing, extra in (
        ("images", _bag("missing", "a", "b", "images"), _bag("extra", "b", "a", "images")), ("links", _bag("missing", "a", "b", "links"), _bag("extra", "b", "a", "links")),
        ("footnotes", _set("missing", "a", "b"), _set("extra", "b", "a")),
    ):
        parts.append(f"{head} '{c}', len(items), items FROM (SELECT doc_id, chunk_no, list_concat({missing}, {extra}) AS items {join}) WHERE len(items) > 0")
    near = "b.arabic_chars * 10 BETWEEN a.arabic_chars * 9 AND a.arabic_chars * 11"
    parts.append(f"{head} 'arabic_chars', abs(b.arabic_chars - a.arabic_chars), ['source ' || a.arabic_chars, 'output ' || b.arabic_chars] {join} WHERE a.arabic_chars > 0 AND NOT ({near})")
    return " UNION ALL ".join(parts)


_OPENING = r"(?i)^(Here\b|Sure\b|Translation\b|Below\b|Note:|Okay\b|Certainly\b|Of course\b)"
_LIVE = "regexp_matches(out, '[^\\s]')"
# findings of all checks but spelling, whose protected spans SQL has no words for
CHECKS_SQL = rf"""
    WITH p AS (SELECT *, regexp_replace(out, '^{SPACE}+', '') AS o, regexp_replace(src, '^{SPACE}+', '') AS s FROM {EVERY} WHERE {_LIVE}),
    a AS (SELECT * FROM ({_features_sql("src")}) SEMI JOIN p USING (doc_id, chunk_no)), b AS (SELECT * FROM ({_features_sql("out")}) SEMI JOIN p USING (doc_id, chunk_no)),
    u AS (SELECT doc_id, chunk_no, list(left({strip("line")}, 160) ORDER BY i) AS items
          FROM (SELECT *, {ENGLISH_WORDS} AS words FROM ({_prose_sql("out")}) SEMI JOIN p USING (doc_id, chunk_no)) WHERE {UNTRANSLATED} GROUP BY doc_id, chunk_no),
    h AS (SELECT doc_id, chunk_no, list(after ORDER BY k) AS items FROM ({_PROPHET_SQL}) SEMI JOIN p USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no),
    t AS (SELECT doc_id, chunk_no, list(after ORDER BY pos) AS items FROM ({_TERM_SQL}) SEMI JOIN p USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no),
    r AS (SELECT doc_id, chunk_no, list_sort(list(DISTINCT ref)) AS items FROM ({_NAMED_SQL}) SEMI JOIN p USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no),
    z AS (SELECT doc_id, chunk_no, CAST(length({strip("src")}) AS DOUBLE) AS ls, length({strip("out")}) AS lo FROM p),
    found AS (
    {_structure_sql()}
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_EMPTY', 'empty', 1, ['output is empty or missing'] FROM {EVERY} WHERE out IS NULL OR NOT {_LIVE}
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_COMMENTARY', 'opening', 1, [left(regexp_extract(o, '^([^\n]*)', 1), 120)] FROM p WHERE regexp_matches(regexp_extract(o, '^([^\n]*)', 1), '{_OPENING}')
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_COMMENTARY', 'code fence', 1, [] FROM p WHERE o LIKE '```%' AND s NOT LIKE '```%'
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_COMMENTARY', 'note', 1, [] FROM p WHERE contains(lower(o), '[translator''s note') AND NOT contains(lower(s), '[translator''s note')
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_CITATION', 'numbers', len(items), items FROM (SELECT doc_id, chunk_no, {_NUMBERS} AS items FROM p) WHERE len(items) > 0
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_CITATION', 'references', len(items), items FROM r
    UNION ALL SELECT doc_id, chunk_no, 'error', 'E_UNTRANSLATED', 'untranslated', len(items), items[1:10] FROM u
    UNION ALL SELECT doc_id, chunk_no, 'warning', 'W_HONORIFIC', 'prophet', len(items), items[1:5] FROM h
    UNION ALL SELECT doc_id, chunk_no, 'warning', 'W_HONORIFIC', 'term Nabi', len(items), items[1:3] FROM t
    UNION ALL SELECT doc_id, chunk_no, 'warning', 'W_URDU_SCRIPT', 'script', len(items), items[1:10] FROM (SELECT doc_id, chunk_no, {_SCRIPT} AS items FROM p) WHERE len(items) > 0
    UNION ALL SELECT doc_id, chunk_no, 'warning', 'W_LENGTH', 'length', 1, [CAST(round(lo / ls, 3) AS VARCHAR)] FROM z
        WHERE ls > 0 AND CASE WHEN ls < 200 THEN lo / ls < 0.5 OR lo / ls > 4.0 ELSE lo / ls < 0.9 OR lo / ls > 2.3 END
    )"""
_PLAIN = [c for c in lint.CHECKS if c != "spelling"]
_CODES = {
    "commentary": "E_COMMENTARY", "structure": "E_STRUCTURE", "citations": "E_CITATION", "untranslated": "E_UNTRANSLATED", "honorifics": "W_HONORIFIC",
    "script": "W_URDU_SCRIPT", "length": "W_LENGTH",
}


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("detail", F.array_join("detail", " | "))


def _checks_query(name: str, *checks: str) -> None:
    """A query of the findings of some checks, which E_EMPTY always comes with."""
    wanted = ", ".join(f"'{_CODES[c]}'" for c in checks)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(lint.findings(lint.lint(every_pair(spark, d), HONORIFICS, checks=checks)))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""{CHECKS_SQL}
    SELECT doc_id, chunk_no, severity, code, test, CAST(n AS BIGINT) AS n, array_to_string(detail, ' | ') AS detail FROM found WHERE code IN ('E_EMPTY', {wanted})"""


for _check in _PLAIN:
    _checks_query(f"lint_{_check}", _check)
_checks_query("lint_checks", *_PLAIN)


@query(f"""{CHECKS_SQL}, per AS (SELECT e.doc_id, e.chunk_no, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w
        FROM {EVERY} e LEFT JOIN found f ON f.doc_id = e.doc_id AND f.chunk_no = e.chunk_no GROUP BY e.doc_id, e.chunk_no)
    SELECT doc_id, count(*) AS chunks, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings,
           coalesce(string_agg(CAST(chunk_no AS VARCHAR), ',' ORDER BY chunk_no) FILTER (e > 0), '') AS chunks_with_errors, sum(e) > 0 OR sum(w) > 0 AS failed
    FROM per GROUP BY doc_id""")
def lint_checks_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = lint.summary(lint.lint(every_pair(spark, d), HONORIFICS, checks=_PLAIN), strict=True)
    return rolled.withColumn("chunks_with_errors", F.array_join(F.col("chunks_with_errors").cast("array<string>"), ","))


def _linted(both: DataFrame) -> DataFrame:
    """Pairs linted in full: with the shipped spelling rules."""
    return lint.lint(both, HONORIFICS, rewrite.spelling_matches(F.coalesce("out", F.lit("")), rewrite.load_rules()))


@query()
def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    return _shown(lint.findings(_linted(every_pair(spark, d))))


@query()
def lint_rollup(spark: SparkSession, d: str) -> DataFrame:
    return lint.summary(_linted(every_pair(spark, d)))


@query()
def spelling_fixes(spark: SparkSession, d: str) -> DataFrame:
    fixed = turns(spark, d).select("doc_id", "chunk_no", rewrite.apply_fixes("text", rewrite.load_rules()).alias("f"))
    return fixed.select("doc_id", "chunk_no", F.sha2("f.text", 256).alias("sha256"), F.size("f.fixes").alias("rules_used"))


@query()
def arabic_wrap(spark: SparkSession, d: str) -> DataFrame:
    return every_pair(spark, d).select("doc_id", "chunk_no", rewrite.wrap_arabic("src").alias("text"))


@query(f"SELECT doc_id, chunk_no FROM {EVERY} WHERE regexp_matches(src, '[{ARABIC}]') AND regexp_full_match(src, '[\\s{ARABIC}()\\[\\]{{}}«»\"''.,;:!?\\-–—*]+')")
def arabic_only(spark: SparkSession, d: str) -> DataFrame:
    src = F.col("src")
    return every_pair(spark, d).where(src.rlike("[\\x{0600}-\\x{06FF}]") & T.is_arabic_only(src)).select("doc_id", "chunk_no")
