"""The registered queries of text expressions and small relations, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assemble, integrity, lint, segment
from quire.plans import fixtures as X
from quire.plans.lint_queries import CHECKS_SQL, EVERY, HONORIFICS, every_pair
from quire.plans.queries import ARABIC, PAIRS_SQL, SPACE, pairs, query, squash, strip, turns
from quire.sources import readers, writers


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _digest(c: Column) -> Column:
    return F.sha2(c, 256).alias("sha256")


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, ', ', '-' || chr(10)), '(\p{L})-\n(\p{Ll})', '\1\2', 'g')) AS sha256 FROM documents")
def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose commas have been turned into line breaks after a hyphen."""
    broken = F.replace("text", F.lit(", "), F.lit("-\n"))
    return _documents(spark, d).select("doc_id", _digest(T.dehyphenate(broken)))


@query(r"""
    SELECT doc_id, sha256('"' || replace(replace(text, '\', '\\'), '"', '\"') || '"') AS yaml, sha256(replace(replace(text, '|', '\|'), chr(10), ' ')) AS cell
    FROM documents""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2(T.yaml_string("text"), 256).alias("yaml"), F.sha2(T.table_cell("text"), 256).alias("cell"))


@query(rf"""
    SELECT doc_id, chunk_no, count(*) AS lines, count(*) FILTER (letters > 0 AND arabic * 10 >= letters * 6) AS arabic_lines FROM (
        SELECT doc_id, chunk_no, len(regexp_extract_all(line, '\p{{L}}')) AS letters,
               len(list_filter(regexp_extract_all(line, '\p{{L}}'), lambda c: regexp_matches(c, '[{ARABIC}]'))) AS arabic
        FROM (SELECT doc_id, chunk_no, unnest(string_split(src, chr(10))) AS line FROM {EVERY})) GROUP BY doc_id, chunk_no""")
def arabic_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(T.lines("src"), T.is_arabic_line)).cast("long")
    return every_pair(spark, d).select("doc_id", "chunk_no", F.size(T.lines("src")).cast("long").alias("lines"), n.alias("arabic_lines"))


@query(rf"""
    SELECT doc_id, count(*) FILTER (regexp_full_match({strip("line")}, '[A-Z][A-Za-z''’-]{{2,29}}')) AS headings
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT conv_id + 1000000, regexp_extract(text, '^\S*') FROM conversations) GROUP BY doc_id""")
def word_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lone capitalised words: lines of documents, and the first words of turns."""
    lines = segment.line_table(_documents(spark, d)).select("doc_id", "line")
    first = turns(spark, d).select((F.col("doc_id") + 1000000).alias("doc_id"), F.regexp_extract("text", r"^\S*", 0).alias("line"))
    return lines.union(first).groupBy("doc_id").agg(F.count_if(T.is_word_heading("line")).alias("headings"))


_RUNNING = rf"""
    WITH lines AS (SELECT DISTINCT conv_id AS doc_id, turn, {squash("line")} AS norm FROM (SELECT conv_id, turn, unnest(string_split('Head of ' || role || chr(10) || text, chr(10))) AS line FROM conversations)),
    n AS (SELECT conv_id AS doc_id, count(*) AS n_pages FROM conversations GROUP BY conv_id),
    running AS (SELECT doc_id, norm, count(*) AS pages FROM lines JOIN n USING (doc_id) WHERE norm <> '' AND NOT regexp_full_match(norm, '\p{{Nd}}+') AND length(norm) < 120
                GROUP BY doc_id, norm, n_pages HAVING n_pages >= 4 AND count(*) >= greatest(2.0, n_pages * 0.3))"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages, each with a running head."""
    return turns(spark, d).select("doc_id", F.col("chunk_no").alias("page_no"), F.concat(F.lit("Head of "), "role", F.lit("\n"), "text").alias("text"))


@query(f"{_RUNNING} SELECT doc_id, norm, pages FROM running")
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    return segment.running_lines(_pages(spark, d))


@query(rf"""{_RUNNING}
    SELECT conv_id AS doc_id, turn AS page_no, i - 1 AS line_no, line FROM (
        SELECT conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT conv_id, turn, string_split('Head of ' || role || chr(10) || text, chr(10)) AS lines FROM conversations))
    WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = conv_id AND r.norm = {squash("line")})""")
def running_lines_dropped(spark: SparkSession, d: str) -> DataFrame:
    return segment.drop_running_lines(_pages(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"""
    SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match({strip("x")}, '\p{{Nd}}+')), chr(10))) AS sha256
    FROM (SELECT doc_id, '12' || chr(10) || text || chr(10) || ' 13 ' AS text FROM documents)""")
def digit_lines_dropped(spark: SparkSession, d: str) -> DataFrame:
    numbered = F.concat(F.lit("12\n"), "text", F.lit("\n 13 "))
    return _documents(spark, d).select("doc_id", _digest(segment.strip_page_numbers(numbered, aggressive=True)))


def _heading_sql(s: str) -> str:
    words = f"list_filter(regexp_split_to_array({s}, '{SPACE}+'), lambda w: w <> '')"
    capital = rf"len(list_filter({words}, lambda w: regexp_matches(w, '^\p{{Lu}}')))"
    return rf"""(length({s}) BETWEEN 3 AND 80 AND NOT regexp_matches({s}, '[.!?:;"”’)\]۔؟]\d{{0,2}}{SPACE}*$') AND NOT {s} LIKE '%,' AND len({words}) <= 12
        AND NOT (regexp_matches({s}, '^\p{{Nd}}') AND len({words}) = 1)
        AND ((regexp_matches({s}, '\p{{Lu}}') AND NOT regexp_matches({s}, '\p{{Ll}}')) OR ({capital} >= greatest(1, floor(len({words}) * 0.8)) AND len({words}) >= 2)))"""


@query(rf"""
    SELECT doc_id, sha256(coalesce(string_agg(CASE WHEN len(kept) = 1 AND {_heading_sql("joined")} THEN '## ' || joined ELSE joined END, chr(10) || chr(10) ORDER BY i) FILTER (joined <> ''), '') || chr(10)) AS sha256
    FROM (SELECT doc_id, i, kept, array_to_string(kept, ' ') AS joined FROM (
        SELECT doc_id, i, list_filter(list_transform(string_split(p, chr(10)), lambda l: {strip("l")}), lambda l: l <> '') AS kept FROM (
            SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
                SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n') AS parts FROM (
                    SELECT doc_id, 'The Great Book' || chr(10) || chr(10) || text || chr(10) || ' ' || chr(10) || 'INTRODUCTION' AS text FROM documents)))))
    GROUP BY doc_id""")
def text_as_markdown(spark: SparkSession, d: str) -> DataFrame:
    titled = F.concat(F.lit("The Great Book\n\n"), "text", F.lit("\n \nINTRODUCTION"))
    return _documents(spark, d).select("doc_id", _digest(segment.txt_to_markdown(titled)))


_MARKDOWN = X.sql_values([(-i, t) for i, t in X.MARKDOWN], "doc_id, text")


@query(rf"""
    SELECT doc_id, coalesce(nullif({strip("regexp_extract(text, '(?m)^# +(.+)$', 1)")}, ''), translate('my_book-' || doc_id, '_-', '  ')) AS title
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {_MARKDOWN})""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    inline = spark.createDataFrame([(-i, t) for i, t in X.MARKDOWN], "doc_id long, text string")
    return _documents(spark, d).select("doc_id", "text").unionByName(inline).select("doc_id", T.first_title("text", F.concat(F.lit("my_book-"), "doc_id")).alias("title"))


@query(r"""
    SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'book') || '.epub' AS name
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '***' ELSE source || ': ' || left(text, 20) || '!' END AS name FROM documents)""")
def alias_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, "***").otherwise(F.concat("source", F.lit(": "), F.left("text", F.lit(20)), F.lit("!")))
    return _documents(spark, d).select("doc_id", writers.alias_name(name, "epub").alias("name"))


@query(r"""
    SELECT doc_id, chunk_no, CASE WHEN length(f) > 1 AND regexp_full_match(f, '[A-Z]+') THEN upper(role) WHEN regexp_matches(f, '^\p{Lu}') THEN upper(left(role, 1)) || substr(role, 2) ELSE role END AS word
    FROM (SELECT conv_id AS doc_id, turn AS chunk_no, role, CASE turn % 3 WHEN 0 THEN upper(w) ELSE w END AS f
          FROM (SELECT conv_id, turn, role, regexp_extract(text, '[A-Za-z]+') AS w FROM conversations))""")
def matched_case(spark: SparkSession, d: str) -> DataFrame:
    """A turn's role in the case of its first word."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    found = F.when(F.col("chunk_no") % 3 == 0, F.upper(word)).otherwise(word)
    return turns(spark, d).select("doc_id", "chunk_no", T.match_case(found, "role").alias("word"))


# --- integrity and assembly ---


@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents""")
def source_states(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the fingerprints of a run that saw two thirds of them, a seventh with another text."""
    docs = _documents(spark, d).select("doc_id", "text")
    before = integrity.fingerprints(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return integrity.check_fingerprints(docs, before.where("doc_id % 3 <> 0"))


@query(rf"""
    SELECT u.conv_id AS doc_id, u.turn AS chunk_no, p.out AS text, CASE WHEN p.out IS NULL THEN 'missing' WHEN NOT regexp_matches(p.out, '\S') THEN 'blank' END AS problem
    FROM conversations u LEFT JOIN ({PAIRS_SQL}) p ON p.doc_id = u.conv_id AND p.chunk_no = u.turn WHERE u.role = 'user'""")
def ordered_outputs(spark: SparkSession, d: str) -> DataFrame:
    listed = turns(spark, d).where("role = 'user'")
    return assemble.ordered_outputs(listed, pairs(spark, d).withColumnRenamed("out", "out_text"))


@query("""
    WITH l AS (SELECT conv_id AS doc_id, turn AS chunk_no FROM conversations WHERE conv_id % 2 = 0 AND role = 'user')
    SELECT doc_id, chunk_no FROM l UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM l)""")
def listed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the manifest; for documents without one, those found."""
    every = turns(spark, d)
    return readers.chunk_listing(every.where("doc_id % 2 = 0 and role = 'user'"), every)


def _images(side: str) -> str:
    return rf"regexp_extract_all(regexp_replace({side}, '\\!\[', chr(2), 'g'), '!\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)', 1)"


@query(rf"""
    WITH a AS (SELECT doc_id, chunk_no, item, count(*) AS n FROM (SELECT doc_id, chunk_no, unnest({_images("src")}) AS item FROM {EVERY}) GROUP BY ALL),
    b AS (SELECT doc_id, chunk_no, item, count(*) AS n FROM (SELECT doc_id, chunk_no, unnest({_images("out")}) AS item FROM {EVERY}) GROUP BY ALL)
    SELECT doc_id, chunk_no, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'missing' ELSE 'extra' END AS problem, item, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
    FROM a FULL JOIN b USING (doc_id, chunk_no, item) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def image_parity(spark: SparkSession, d: str) -> DataFrame:
    return assemble.image_parity(every_pair(spark, d))


@query(r"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\{([A-Z_]{3,})\}', 1))), ',') AS names
    FROM (SELECT doc_id, text || ' {OUT_DIR} {AB} {' || upper(lang) || '_NAME} {OUT_DIR} {lower}' AS x FROM documents)""")
def unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("text", F.lit(" {OUT_DIR} {AB} {"), F.upper("lang"), F.lit("_NAME} {OUT_DIR} {lower}"))
    return _documents(spark, d).select("doc_id", F.array_join(assemble.unresolved(x), ",").alias("names"))


@query(r"""
    SELECT doc_id, concat_ws(chr(10), '---', 'title: "Doc \"' || doc_id || '\""', 'subtitle: "Roman Urdu Tarjuma"', CASE WHEN doc_id % 2 = 0 THEN 'author: "' || lang || '"' END,
        CASE WHEN doc_id % 3 = 0 THEN 'publisher: "' || source || '"' END, 'lang: ur-Latn', 'date: "2020"', '---', '',
        CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN concat_ws(chr(10), '::: {.front-matter}', CASE WHEN doc_id % 2 = 0 THEN '**Taleef:** ' || lang || '  ' END,
             CASE WHEN doc_id % 3 = 0 THEN source || '  ' END, ':::') || chr(10) END) AS front_matter
    FROM documents""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    meta = _documents(spark, d).select(
        "doc_id", F.concat(F.lit('Doc "'), "doc_id", F.lit('"')).alias("title"), none.alias("subtitle"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("author"),
        none.alias("translator"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("publisher"), none.alias("cover_image"), F.lit("2020").alias("date"),
    )
    return assemble.front_matter(meta).select("doc_id", "front_matter")


@query(f"""{CHECKS_SQL}
    SELECT e.doc_id, e.chunk_no, coalesce('Linter findings:' || chr(10) || string_agg('- ' || CASE severity WHEN 'error' THEN 'ERROR' ELSE 'warning' END || ' ' || code || ': ' || test || ' (' || n || ')'
        || CASE WHEN len(detail) > 0 THEN ' [' || array_to_string(detail, '; ') || ']' ELSE '' END, chr(10) ORDER BY severity, code, test), '') AS feedback
    FROM {EVERY} e LEFT JOIN found f ON f.doc_id = e.doc_id AND f.chunk_no = e.chunk_no GROUP BY e.doc_id, e.chunk_no""")
def lint_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The findings of a pair as the text of a retry prompt, '' without any."""
    linted = lint.lint(every_pair(spark, d), HONORIFICS)
    return linted.select("doc_id", "chunk_no", assemble.format_findings(F.col("findings")).alias("feedback"))
