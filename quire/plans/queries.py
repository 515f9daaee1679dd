"""The registered queries: operators over whole tables, each with its SQL where SQL has words for it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as T
from quire.operators import assemble, context, dictionary, integrity, lint, phrases, segment
from quire.plans import fixtures as X
from quire.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as the chunks of a document."""
    c = _table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), "role", "text")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn and the assistant's next one as source and output."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    c = turns(spark, d).withColumns({"no2": F.lead("chunk_no").over(w), "role2": F.lead("role").over(w), "out": F.lead("text").over(w)})
    return c.where("role = 'user' AND role2 = 'assistant' AND no2 = chunk_no + 1").select("doc_id", "chunk_no", F.col("text").alias("src"), "out")


def _terms(spark: SparkSession) -> DataFrame:
    return dictionary.load_terms(spark, X.TERMS)


def _all_terms(spark: SparkSession, d: str) -> DataFrame:
    """The inline terms, and one for each nation that also answers to the name of its region."""
    named = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    nations = named.select(
        (k + 1000).cast("int").alias("term_id"), F.col("n_name").alias("source"), F.array("r_name").alias("aliases"), F.col("n_name").alias("target"),
        F.lit("place").alias("category"), F.when(k % 2 == 0, "h1").otherwise("none").alias("honorific"), F.when(k % 3 == 0, "f").alias("gender"),
        (k % 5 == 0).alias("plural"), F.lit(None).cast("string").alias("note"), F.lit(0).cast("long").alias("frequency"),
    )
    return _terms(spark).unionByName(nations)


_ALL_TERMS_SQL = f"""(
    SELECT CAST(term_id AS INT) AS term_id, source, aliases, category, honorific, gender, CAST(plural AS BOOLEAN) AS plural
    FROM {X.sql_values([(t[0], t[1], t[2], t[4], t[5], t[6], t[7]) for t in X.TERMS], "term_id, source, aliases, category, honorific, gender, plural")}
    UNION ALL
    SELECT CAST(n_nationkey + 1000 AS INT), n_name, [r_name], 'place', CASE WHEN n_nationkey % 2 = 0 THEN 'h1' ELSE 'none' END,
           CASE WHEN n_nationkey % 3 = 0 THEN 'f' END, n_nationkey % 5 = 0
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_ALL_SURFACES_SQL = f"(SELECT DISTINCT term_id, surface FROM (SELECT term_id, unnest(list_prepend(source, aliases)) AS surface FROM {_ALL_TERMS_SQL}))"


def _honorifics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.HONORIFICS, "id string, target string, female_target string, plural_target string")


SURFACES = [(t[0], s) for t in X.TERMS for s in dict.fromkeys([t[1], *t[2]])]
_W = r"[^\p{L}\p{N}_'']"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"
PAIRS_SQL = """
    SELECT a.conv_id AS doc_id, a.turn AS chunk_no, a.text AS src, b.text AS out
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    WHERE a.role = 'user' AND b.role = 'assistant'"""
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squash(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def _hits_of(pos: int, term: int, surface: str) -> str:
    """Matches of one surface; every character that ends a word is doubled, in the text and here, so that one
    between two words can end both.  The pattern is constant, so it is compiled once."""
    twice = re.sub(r"([^\w'])", r"\1\1", surface).replace("'", "''")
    return f"SELECT doc_id, {pos} AS pos, {term} AS term_id, '{surface.replace(chr(39), chr(39) * 2)}' AS surface, len(regexp_extract_all(twice, '(?i)(?:^|{_W}){twice}(?:$|{_W})')) AS n FROM d"


_SURFACE_ROWS = X.sql_values([(i, t, s) for i, (t, s) in enumerate(SURFACES)], "pos, term_id, surface")
_HITS_SQL = rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '({_W})', '\1\1', 'g') AS twice FROM documents)
    {" UNION ALL ".join(_hits_of(i, t, s) for i, (t, s) in enumerate(SURFACES))}"""


@query(r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[A-Za-z\x{0600}-\x{06FF}'']+'))) AS words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.word_count("text").alias("words"))


@query(f"SELECT doc_id, term_id, surface, n FROM ({_HITS_SQL}) WHERE n > 0")
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.term_hits(_documents(spark, d), SURFACES)


@query(f"SELECT term_id, CAST(sum(n) AS BIGINT) AS frequency FROM ({_HITS_SQL}) GROUP BY term_id HAVING sum(n) > 0")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.term_frequency(_documents(spark, d), SURFACES)


@query(f"SELECT DISTINCT doc_id FROM ({_HITS_SQL}) WHERE n > 0 AND term_id IN (3, 4)")
def term_occurs_semi(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.documents_with_terms(_documents(spark, d), [s for s in SURFACES if s[0] in (3, 4)]).select("doc_id")


@query(f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank, surface, n
    FROM ({_HITS_SQL}) WHERE n > 0 QUALIFY rank <= 5""")
def top_terms_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.top_terms(_documents(spark, d), SURFACES, 5)


_STATS_SQL = rf"""
    SELECT doc_id, any_value(words) AS word_count, CAST(count(DISTINCT lower(surface)) FILTER (n > 0) AS BIGINT) AS distinct_terms,
           CAST(sum(n) AS BIGINT) AS total_hits, round(sum(n) * 1000 / any_value(words), 3) AS hits_per_1000_words,
           CAST(coalesce(sum(n) FILTER (surface IN ('der', 'Is and')), 0) AS BIGINT) AS strong_term_hits,
           round(coalesce(sum(n) FILTER (surface IN ('der', 'Is and')), 0) * 1000 / any_value(words), 3) AS strong_hits_per_1000_words
    FROM ({_HITS_SQL}) JOIN (
        SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[A-Za-z\x{{0600}}-\x{{06FF}}'']+'))) AS words FROM documents
    ) USING (doc_id) GROUP BY doc_id"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.domain_stats(_documents(spark, d), SURFACES, ("der", "Is and"))


@query(_STATS_SQL)
def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).drop("top_terms")


@query(f"""
    SELECT doc_id, distinct_terms, hits_per_1000_words, strong_hits_per_1000_words,
        CASE WHEN special THEN 'islamic' ELSE 'general' END AS domain,
        CASE WHEN special AND ((distinct_terms >= 6 AND hits_per_1000_words >= 300) OR strong_hits_per_1000_words >= 100) THEN 'high'
             WHEN NOT special AND distinct_terms = 0 AND strong_hits_per_1000_words = 0 THEN 'high'
             WHEN abs(distinct_terms - 4) <= 1 OR abs(hits_per_1000_words - 200) <= 40 OR abs(strong_hits_per_1000_words - 50) <= 10 THEN 'low'
             ELSE 'medium' END AS confidence
    FROM (SELECT *, (distinct_terms >= 4 AND hits_per_1000_words >= 200) OR strong_hits_per_1000_words >= 50 AS special FROM ({_STATS_SQL}))""")
def domain_decision(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.decide_domain(_stats(spark, d), 4, 200.0, 50.0).select(
        "doc_id", "distinct_terms", "hits_per_1000_words", "strong_hits_per_1000_words", "domain", "confidence"
    )


@query(f"""
    WITH found AS (
        SELECT doc_id, term_id, min(pos) AS pos FROM ({_HITS_SQL}) WHERE n > 0 GROUP BY doc_id, term_id
    ), terms AS (SELECT * FROM {X.sql_values([(t[0], t[1], t[9]) for t in X.TERMS], "term_id, source, frequency")}),
    most AS (SELECT term_id, row_number() OVER (ORDER BY frequency DESC, term_id) + 1000 AS pos FROM terms WHERE frequency > 0
             QUALIFY row_number() OVER (ORDER BY frequency DESC, term_id) <= 3),
    every AS (SELECT doc_id, term_id, pos FROM found UNION ALL SELECT doc_id, term_id, pos FROM documents, most),
    firsts AS (SELECT doc_id, term_id, pos FROM every JOIN terms USING (term_id)
               QUALIFY row_number() OVER (PARTITION BY doc_id, lower(source) ORDER BY pos) = 1)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS position, term_id FROM firsts
    QUALIFY position <= 5""")
def select_terms_for_chunk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _documents(spark, d).withColumn("chunk_no", F.lit(1))
    return dictionary.select_terms(chunks, _terms(spark), top_n=3, most=5).select("doc_id", "position", "term_id")


@query(f"""
    SELECT term_id, source, category, CAST(sum(n) AS BIGINT) AS frequency
    FROM ({_HITS_SQL}) JOIN {X.sql_values([(t[0], t[1], t[4]) for t in X.TERMS], "term_id, source, category")} USING (term_id)
    WHERE category IN ('place', 'book', 'phrase') GROUP BY ALL HAVING sum(n) > 0""")
def glossary_seed(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.seed(_documents(spark, d), _terms(spark), "general").select("term_id", "source", "category", "frequency")


@query(f"""
    SELECT key, CAST(count(DISTINCT term_id) AS BIGINT) AS n_terms
    FROM (SELECT term_id, lower(surface) AS key FROM {_ALL_SURFACES_SQL}) GROUP BY key HAVING count(DISTINCT term_id) > 1""")
def surface_collisions(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.surface_collisions(_all_terms(spark, d))


@query(f"""
    WITH t AS (SELECT * FROM {_ALL_TERMS_SQL})
    SELECT term_id, 'unknown honorific ' || honorific AS problem FROM t WHERE honorific NOT IN ('', 'h1', 'h2', 'h3')
    UNION ALL SELECT term_id, 'unknown category ' || category FROM t WHERE category = 'odd'
    UNION ALL SELECT DISTINCT term_id, 'surface already used: ' || key
    FROM (SELECT term_id, lower(surface) AS key, min(term_id) OVER (PARTITION BY lower(surface)) AS owner FROM {_ALL_SURFACES_SQL}) WHERE owner <> term_id""")
def glossary_validate(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.validate(_all_terms(spark, d), _honorifics(spark))


@query(f"SELECT key, max(term_id) AS term_id FROM (SELECT term_id, lower(surface) AS key FROM {_ALL_SURFACES_SQL}) GROUP BY key")
def surface_index(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.surface_index(_all_terms(spark, d))


@query(f"""
    SELECT term_id, coalesce(CASE WHEN plural THEN plural_target END, CASE WHEN gender = 'f' THEN female_target END, h.target, '') AS honorific_text
    FROM {_ALL_TERMS_SQL} t
    LEFT JOIN (SELECT * FROM {X.sql_values(X.HONORIFICS, "id, target, female_target, plural_target")}) h ON h.id = t.honorific""")
def honorific_resolve(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.resolve_honorifics(_all_terms(spark, d), _honorifics(spark)).select("term_id", "honorific_text")


@query(f"SELECT term_id, source FROM {_ALL_TERMS_SQL} WHERE category = 'place'")
def glossary_list(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.by_category(_all_terms(spark, d), "place").select("term_id", "source")


@query(f"""
    SELECT t.term_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS frequency
    FROM (SELECT DISTINCT term_id FROM {_SURFACE_ROWS}) t LEFT JOIN ({_HITS_SQL}) h USING (term_id) GROUP BY t.term_id""")
def glossary_recount(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.recount(_documents(spark, d), _terms(spark)).select("term_id", "frequency")


def _cell(c: str) -> str:
    return f"replace(replace(coalesce({c}, ''), '|', '\\|'), chr(10), ' ')"


_TERM_ROWS = X.sql_values([(t[0], t[1], ", ".join(t[2]), *t[3:]) for t in X.TERMS], "term_id, source, aliases, target, category, honorific, gender, plural, note, frequency")


@query(f"""
    WITH found AS (SELECT doc_id, term_id, min(pos) AS pos FROM ({_HITS_SQL}) WHERE n > 0 GROUP BY doc_id, term_id),
    terms AS (SELECT * FROM {_TERM_ROWS}),
    most AS (SELECT term_id, row_number() OVER (ORDER BY frequency DESC, term_id) + 1000 AS pos FROM terms WHERE frequency > 0),
    every AS (SELECT doc_id, term_id, pos FROM found UNION ALL SELECT doc_id, term_id, pos FROM documents, most),
    firsts AS (SELECT doc_id, term_id, pos FROM every JOIN terms USING (term_id) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(source) ORDER BY pos) = 1),
    named AS (SELECT t.term_id, source, aliases, t.target, note, category,
                     coalesce(CASE WHEN plural THEN plural_target END, CASE WHEN gender = 'f' THEN female_target END, h.target, '') AS honorific_text
              FROM terms t LEFT JOIN (SELECT * FROM {X.sql_values(X.HONORIFICS, "id, target, female_target, plural_target")}) h ON h.id = t.honorific)
    SELECT doc_id, CAST(1 AS INT) AS chunk_no, '| English | Aliases | Roman Urdu | Honorific | Note |' || chr(10) || '|---|---|---|---|---|' || chr(10) ||
           string_agg('| ' || {_cell("source")} || ' | ' || {_cell("aliases")} || ' | ' || {_cell("target")} || ' | ' || {_cell("honorific_text")} || ' | '
                      || {_cell("coalesce(nullif(note, ''), category)")} || ' |', chr(10) ORDER BY pos) AS term_table
    FROM firsts JOIN named USING (term_id) GROUP BY doc_id""")
def term_tables(spark: SparkSession, d: str) -> DataFrame:
    chunks = _documents(spark, d).withColumn("chunk_no", F.lit(1))
    named = dictionary.resolve_honorifics(_terms(spark), _honorifics(spark))
    return assemble.term_table(dictionary.select_terms(chunks, _terms(spark)).join(named, "term_id"))


# --- lines and sentences ---


@query(rf"""
    WITH l AS (SELECT doc_id, {strip("line")} AS s FROM ({_LINES})),
    w AS (SELECT *, list_filter(regexp_split_to_array(s, '{SPACE}+'), lambda x: x <> '') AS words FROM l),
    c AS (SELECT *, len(words) AS n, len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}'))) AS caps FROM w)
    SELECT doc_id, count(*) FILTER (length(s) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '[.!?:;"”’)\]۔؟]\d{{0,2}}{SPACE}*$') AND NOT s LIKE '%,' AND n <= 12
      AND NOT (regexp_matches(s, '^\p{{Nd}}') AND n = 1)
      AND ((regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '\p{{Ll}}')) OR (caps >= greatest(1, floor(n * 0.8)) AND n >= 2))) AS headings
    FROM c GROUP BY doc_id""")
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(T.lines("text"), T.is_heading_candidate)).cast("long")
    return _documents(spark, d).select("doc_id", n.alias("headings"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in P.ENGLISH) + "]"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
CITED = r"[(\[][^()\[\]\n]*?:\s*[^()\[\]\n]*?\d[^()\[\]\n]*[)\]]"
ENGLISH_WORDS = r"""list_filter(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace(line, '`[^`\n]+`', ' ', 'g'), '\]\([^)]*\)', ']', 'g')),
    '[a-z'']+'), lambda x: trim(x, '''')), lambda x: x <> '')"""
UNTRANSLATED = rf"""len(words) >= 8 AND len(list_filter(words, lambda x: list_contains({_STOP_SQL}, x))) * 10 >= len(words) * 3
    AND NOT regexp_matches(line, '(https?://|www\.)\S+') AND NOT regexp_matches({strip("line")}, '^(!\[|\|)')
    AND NOT regexp_matches(line, '[{ARABIC}]') AND NOT regexp_full_match({strip("line")}, '{CITED}')"""


@query(f"""
    SELECT doc_id, count(*) FILTER ({UNTRANSLATED}) AS lines
    FROM (SELECT doc_id, line, {ENGLISH_WORDS} AS words FROM ({_LINES})) GROUP BY doc_id""")
def untranslated_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(T.lines("text"), T.looks_untranslated)).cast("long")
    return _documents(spark, d).select("doc_id", n.alias("lines"))


@query(rf"""
    SELECT line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {squash("line")} AS line FROM ({_LINES}))
    WHERE line <> '' AND length(line) < 120 AND NOT regexp_full_match(line, '\p{{Nd}}+') GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return segment.repeated_lines(_documents(spark, d))


@query(rf"""
    SELECT doc_id, CAST(CASE WHEN len(s) = 0 THEN 80 ELSE greatest(40, s[least(len(s) - 1, CAST(floor(len(s) * 0.9) AS INT)) + 1]) END AS BIGINT) AS width
    FROM (SELECT doc_id, list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: length({strip("x")})), lambda n: n > 0)) AS s FROM documents)""")
def line_width_p90(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.filter(F.transform(T.lines("text"), lambda x: F.length(T.strip(x))), lambda n: n > 0)
    return _documents(spark, d).select("doc_id", T.typical_width(sizes).alias("width"))


@query(r"""
    SELECT doc_id, len(s) AS sentences, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars
    FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+') AS s FROM documents)""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _documents(spark, d).withColumn("s", T.sentences("text"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\-]*|[.!?,;:()\[\]"“”]')) AS tokens FROM documents""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.size(T.tokens("text")).cast("long").alias("tokens"))


@query("""
    WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    f(doc_id, i, chunk_no, size) AS (
        SELECT doc_id, 1, 1, length(lines[1]) + 1 FROM l
        UNION ALL
        SELECT f.doc_id, i + 1,
               CASE WHEN size + length(lines[i + 1]) + 1 > 1000 THEN chunk_no + 1 ELSE chunk_no END,
               CASE WHEN size + length(lines[i + 1]) + 1 > 1000 THEN length(lines[i + 1]) + 1 ELSE size + length(lines[i + 1]) + 1 END
        FROM f JOIN l USING (doc_id) WHERE i < len(lines)
    )
    SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n_lines, string_agg(lines[i], chr(10) ORDER BY i) AS text
    FROM f JOIN l USING (doc_id) GROUP BY doc_id, chunk_no""")
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.pack_lines(_documents(spark, d), 1000)


def _with_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).unionByName(spark.createDataFrame([(-i, t) for i, t in X.MARKDOWN], "doc_id long, text string"))


_MARKDOWN = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {X.sql_values(X.MARKDOWN, 'doc_id, text')})"


# a scan line by line: the block a line belongs to, from the state that the line before leaves behind
_BLOCK_CTES = rf"""
    WITH RECURSIVE l AS MATERIALIZED (
        SELECT doc_id, i, lines[i] AS line, NOT regexp_matches(lines[i], '\S') AS blank,
               CASE WHEN regexp_matches(lines[i], '^\s*(```|~~~)') THEN 'code_block' WHEN regexp_matches(lines[i], '^#{{1,6}}\s') THEN 'heading' WHEN lines[i] LIKE '>%' THEN 'blockquote'
                    WHEN lines[i] LIKE '|%' THEN 'table' WHEN regexp_matches(lines[i], '^([-*+]|\d+[.)])\s') THEN 'list' WHEN lines[i] LIKE '![%' THEN 'image' ELSE '' END AS kind
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {_MARKDOWN}))),
    n AS MATERIALIZED (SELECT *, kind = 'list' OR (line LIKE '  %' AND NOT blank) AS inside,
               coalesce(lead(kind = 'list' OR (line LIKE '  %' AND NOT blank)) OVER (PARTITION BY doc_id ORDER BY i), false) AS next_inside FROM l),
    f(doc_id, i, block_no, state, type) AS (
        SELECT doc_id, 0, -1, '', '' FROM {_MARKDOWN}
        UNION ALL
        SELECT n.doc_id, n.i, CASE WHEN goes_on THEN block_no ELSE block_no + 1 END,
               CASE WHEN goes_on AND f.type = 'code_block' AND starts_with(ltrim(line), f.state) THEN 'closed' WHEN goes_on THEN f.state
                    WHEN kind = 'code_block' THEN left(ltrim(line), 3) WHEN blank OR kind IN ('heading', 'image') THEN 'closed' ELSE 'open' END,
               CASE WHEN goes_on THEN f.type WHEN kind <> '' THEN kind ELSE 'paragraph' END
        FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1,
        LATERAL (SELECT f.state NOT IN ('', 'closed') AND CASE f.type WHEN 'code_block' THEN true WHEN 'list' THEN inside OR (blank AND next_inside)
                        WHEN 'paragraph' THEN kind = '' AND NOT blank ELSE kind = f.type END AS goes_on)),
    b AS MATERIALIZED (
        SELECT f.doc_id, block_no, any_value(f.type) AS type, CASE WHEN bool_and(blank AND f.type = 'paragraph') THEN '' ELSE string_agg(line, chr(10) ORDER BY f.i) END AS text
        FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i GROUP BY f.doc_id, block_no)"""


@query(f"{_BLOCK_CTES} SELECT doc_id, type, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM b GROUP BY doc_id, type")
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return segment.block_table(_with_markdown(spark, d)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


# three more scans: where chunks begin, how a block of more than two targets is cut (by paragraphs, else by lines; no fenced
# block is as long here), and which small pieces join the one before
@query(rf"""{_BLOCK_CTES},
    sized AS MATERIALIZED (SELECT *, length(text) AS size, CASE WHEN type = 'heading' THEN length(text) - length(ltrim(text, '#')) ELSE 0 END AS level FROM b),
    g(doc_id, block_no, seg, held, alone) AS (
        SELECT doc_id, block_no, 0, size, size > 9000 FROM sized WHERE block_no = 0
        UNION ALL
        SELECT s.doc_id, s.block_no, CASE WHEN cut THEN seg + 1 ELSE seg END, CASE WHEN cut THEN s.size ELSE held + s.size END, s.size > 9000
        FROM g JOIN sized s ON s.doc_id = g.doc_id AND s.block_no = g.block_no + 1,
        LATERAL (SELECT alone OR s.size > 9000 OR held > least(4500 - s.size, CASE WHEN level = 0 THEN 1e9 WHEN level <= 2 THEN 1125 ELSE 2250 END) AS cut)),
    segs AS MATERIALIZED (SELECT g.doc_id, seg, bool_or(alone) AS alone, string_agg(text, chr(10) ORDER BY g.block_no) AS text FROM g JOIN sized s ON s.doc_id = g.doc_id AND s.block_no = g.block_no GROUP BY g.doc_id, seg),
    wide AS (SELECT doc_id, seg, text, list_filter(regexp_split_to_array(text, '\n\n+'), lambda p: regexp_matches(p, '\S')) AS paragraphs FROM segs WHERE alone),
    items AS MATERIALIZED (SELECT doc_id, seg, unnest(list) AS item, generate_subscripts(list, 1) AS i, gap
              FROM (SELECT doc_id, seg, CASE WHEN len(paragraphs) > 1 THEN paragraphs ELSE string_split(text, chr(10)) END AS list, CASE WHEN len(paragraphs) > 1 THEN 0 ELSE 1 END AS gap FROM wide)),
    w(doc_id, seg, i, part, held) AS (
        SELECT doc_id, seg, 1, 0, length(item) + gap FROM items WHERE i = 1
        UNION ALL
        SELECT x.doc_id, x.seg, x.i, CASE WHEN held + length(item) + gap > 4500 THEN part + 1 ELSE part END, CASE WHEN held + length(item) + gap > 4500 THEN length(item) + gap ELSE held + length(item) + gap END
        FROM w JOIN items x ON x.doc_id = w.doc_id AND x.seg = w.seg AND x.i = w.i + 1),
    parts AS (
        SELECT doc_id, seg, 0 AS part, text FROM segs WHERE NOT alone
        UNION ALL SELECT w.doc_id, w.seg, part, CASE WHEN gap = 0 THEN string_agg(item, chr(10) || chr(10) ORDER BY w.i) ELSE string_agg(item, chr(10) ORDER BY w.i) END
        FROM w JOIN items x ON x.doc_id = w.doc_id AND x.seg = w.seg AND x.i = w.i GROUP BY w.doc_id, w.seg, part, gap),
    pieces AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg, part) AS k, trim(text, chr(10)) AS text, length(trim(text, chr(10))) + 1 AS size FROM parts WHERE regexp_matches(text, '\S')),
    j(doc_id, k, chunk_no, held) AS (
        SELECT doc_id, k, CAST(1 AS BIGINT), size FROM pieces WHERE k = 1
        UNION ALL
        SELECT p.doc_id, p.k, CASE WHEN fits THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN fits THEN held + 1 + p.size ELSE p.size END
        FROM j JOIN pieces p ON p.doc_id = j.doc_id AND p.k = j.k + 1, LATERAL (SELECT p.size < 1350 AND held + p.size <= 5850 AS fits))
    SELECT j.doc_id, CAST(chunk_no AS INT) AS chunk_no, 'chunk' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no AS VARCHAR))) AS INT), '0') AS chunk_id,
           sha256(string_agg(text, chr(10) || chr(10) ORDER BY j.k) || chr(10)) AS source_hash
    FROM j JOIN pieces p ON p.doc_id = j.doc_id AND p.k = j.k GROUP BY j.doc_id, chunk_no""")
def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunk_table(_with_markdown(spark, d)).select("doc_id", "chunk_no", "chunk_id", F.sha2("text", 256).alias("source_hash"))


@query()
def reflowed(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2(segment.reflow("text"), 256).alias("sha256"))


@query()
def page_spine(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2(segment.strip_page_numbers("text"), 256).alias("sha256"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", readers.html_to_markdown("html").alias("p")).select("page_id", "p.title", "p.text")


_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(P.STOP)) + "]"
_CONNECT = "[" + ", ".join(f"'{w}'" for w in sorted(P.CONNECTORS)) + "]"
_SUBJECTS = "[" + ", ".join(f"'{w}'" for w in [*P.SUBJECT_WORDS, "pbuh"]) + "]"
_CAP = r"regexp_full_match({}, '[A-Z][A-Za-z''’\-]*')"


# tokens are spelled with a letter of their kind before them, so that one pattern finds phrases over words;
# the first word of a longer phrase is a row of its own
@query(rf"""
    WITH plain AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```|https?://\S+', ' ', 'g'), '(?m)^#{{1,6}}\s+', '', 'g') AS x FROM documents),
    said AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+')) AS s,
                    generate_subscripts(regexp_split_to_array(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), 1) AS no FROM plain),
    words AS (SELECT doc_id, no, s, regexp_extract_all(s, '[A-Za-z][A-Za-z''’\-]*|[.!?,;:()\[\]"“”]') AS w FROM said),
    kinds AS (SELECT doc_id, no, s, array_to_string(list_transform(w, lambda t, i: CASE
        WHEN {_CAP.format("t")} AND NOT list_contains({_STOPS}, lower(t)) THEN 'N:'
        WHEN list_contains({_CONNECT}, lower(t)) AND i < len(w) AND {_CAP.format("w[i + 1]")} THEN 'j:' ELSE '.:' END || t), ' ') AS k FROM words),
    found AS (SELECT doc_id, no, s, k, regexp_extract_all(k, 'N:[^ ]+(?:(?: [Nj]:[^ ]+){{0,4}} N:[^ ]+)?') AS runs FROM kinds),
    each AS (SELECT doc_id, no, s, i, regexp_replace(runs[i], '(^| )[Nj]:', '\1', 'g') AS phrase, i = 1 AND starts_with(k, runs[1]) AS initial
             FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM found)),
    every AS (SELECT doc_id, no, 2 * i AS nth, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS s, phrase, initial FROM each
              UNION ALL SELECT doc_id, no, 2 * i + 1, trim(s, ' ' || chr(9) || chr(10) || chr(13)), split_part(phrase, ' ', 1), initial FROM each WHERE contains(phrase, ' ')),
    placed AS (SELECT *, left(regexp_replace(CASE WHEN instr(s, phrase) = 0 THEN s ELSE substr(s, greatest(1, instr(s, phrase) - 60), length(phrase) + 60 + least(60, instr(s, phrase) - 1)) END, '\s+', ' ', 'g'), 160) AS context FROM every),
    per AS (SELECT phrase AS source, count(*) AS frequency, count(*) FILTER (NOT initial) AS inner_uses, list(context ORDER BY doc_id, no, nth)[1:2] AS contexts FROM placed GROUP BY phrase)
    SELECT source, frequency, array_to_string(contexts, ' | ') AS contexts FROM per
    WHERE frequency >= 2 AND NOT (NOT contains(source, ' ') AND inner_uses = 0) AND NOT list_contains({_SUBJECTS}, lower(source))
      AND len(list_filter(string_split(lower(source), ' '), lambda t: NOT list_contains({_STOPS}, t) AND NOT list_contains({_CONNECT}, t))) > 0
      AND lower(source) NOT IN (SELECT lower(surface) FROM {_SURFACE_ROWS})
    ORDER BY frequency DESC, source LIMIT 400""")
def phrase_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The report of the 400 most frequent candidates."""
    known = dictionary.surface_index(_terms(spark))
    return phrases.candidates(_documents(spark, d), known, triggers=("PBUH",)).withColumn("contexts", F.array_join("contexts", " | "))


_MESSY = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {X.sql_values(X.MESSY, 'doc_id, text')})"


@query(rf"""
    WITH a AS (SELECT doc_id, regexp_replace(replace(replace(regexp_replace(text, '↩︎?|\x{{FEFF}}', '', 'g'), ' ', ' '), chr(13) || chr(10), chr(10)), '\r', chr(10), 'g') AS x FROM {_MESSY}),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?m)^:::+.*$', '', 'g'), '(?m)^\s*</?div[^>]*>\s*$', '', 'g') AS x FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\(#calibre_link-\d+\)', '', 'g'), '\[\*\*([^*]+)\*\*\]', '**\1**', 'g') AS x FROM b),
    e AS (SELECT doc_id, array_to_string(list_transform(string_split(x, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\s*```') THEN l
          ELSE regexp_replace(l, '[ \t]*\{{[#.][^}}\n]*\}}', '', 'g') END), chr(10)) AS x FROM c),
    f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?m)[ \t]*\\$', '', 'g'), '\[\]\([^)]*\)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM e)
    SELECT doc_id, trim(x, chr(10)) || chr(10) AS text FROM f""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    messy = spark.createDataFrame([(-i, t) for i, t in X.MESSY], "doc_id long, text string")
    return _documents(spark, d).unionByName(messy).select("doc_id", T.clean_markdown("text").alias("text"))


@query(f"""
    SELECT id, CAST(nullif(regexp_extract(name, '^chunk(\\d+)\\.md$', 1), '') AS BIGINT) AS chunk_no
    FROM (SELECT id, name FROM {X.sql_values([(-i, n) for i, n in X.NAMES], "id, name")} UNION ALL SELECT page_id, 'chunk' || page_id || '.md' FROM pages)""")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([(-i, n) for i, n in X.NAMES], "id long, name string")
    pages = _table(spark, d, "pages").select(F.col("page_id").cast("long").alias("id"), F.concat(F.lit("chunk"), "page_id", F.lit(".md")).alias("name"))
    return named.unionByName(pages).select("id", T.chunk_number("name").alias("chunk_no"))


# --- neighbours, queues, samples ---


@query(rf"""
    SELECT conv_id AS doc_id, turn AS chunk_no,
        coalesce(CASE WHEN lag(turn) OVER w = turn - 1 THEN {strip("right(lag(text) OVER w, 300)")} END, '') AS prev_excerpt,
        coalesce(CASE WHEN lead(turn) OVER w = turn + 1 THEN {strip("left(lead(text) OVER w, 300)")} END, '') AS next_excerpt
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    return context.neighbour_context(turns(spark, d)).select("doc_id", "chunk_no", "prev_excerpt", "next_excerpt")


@query("""
    WITH n AS (SELECT conv_id AS doc_id, turn AS chunk_no, count(*) OVER (PARTITION BY conv_id) AS n,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
    k AS (SELECT *, least(n, greatest(3, CAST(ceil(n * 0.10) AS BIGINT))) AS k FROM n)
    SELECT DISTINCT doc_id, chunk_no FROM k, unnest(range(k)) AS u(i)
    WHERE p = CASE WHEN k = 1 THEN 0 ELSE floor(i * (n - 1) / (k - 1) + 0.5) END""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return context.review_sample(turns(spark, d)).select("doc_id", "chunk_no")


@query("SELECT conv_id AS doc_id, turn AS chunk_no, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 6) AS BIGINT) AS batch FROM conversations")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return context.batches(turns(spark, d)).select("doc_id", "chunk_no", "batch")


@query("""
    SELECT conv_id AS doc_id, turn AS chunk_no FROM conversations c
    WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 1 AND o.role = 'assistant' AND regexp_matches(o.text, '\\S'))""")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    both = turns(spark, d)
    done = both.where("role = 'assistant'").select("doc_id", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("text").alias("out_text"))
    return context.work_queue(both.where("role = 'user'"), done).select("doc_id", "chunk_no")


_REVIEWS = f"""(
    SELECT CAST(-doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, score, type FROM {X.sql_values(X.REVIEWS, "doc_id, chunk_no, score, type")}
    UNION ALL SELECT conv_id, turn, 1 + length(text) % 5, CASE length(text) % 4 WHEN 0 THEN 'style' WHEN 1 THEN 'terms' WHEN 2 THEN 'missing' END FROM conversations)"""


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Inline reviews, and one for each turn that goes by the turn's length."""
    inline = spark.createDataFrame([(-r[0], *r[1:]) for r in X.REVIEWS], "doc_id long, chunk_no long, score int, type string")
    n = F.length("text")
    kind = F.when(n % 4 == 0, "style").when(n % 4 == 1, "terms").when(n % 4 == 2, "missing")
    each = turns(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), (1 + n % 5).cast("int").alias("score"), kind.alias("type"))
    return inline.unionByName(each)


@query(f"""
    SELECT doc_id, type, count(DISTINCT chunk_no) AS chunks, any_value(sampled) AS sampled
    FROM {_REVIEWS} f JOIN (SELECT doc_id, count(DISTINCT chunk_no) AS sampled FROM {_REVIEWS} GROUP BY doc_id) s USING (doc_id)
    WHERE type IS NOT NULL GROUP BY doc_id, type HAVING count(DISTINCT chunk_no) >= any_value(sampled) * 0.5""")
def systematic_issues(spark: SparkSession, d: str) -> DataFrame:
    return context.systematic_issues(_reviews(spark, d))


@query(f"""
    SELECT DISTINCT doc_id, chunk_no FROM {_REVIEWS} WHERE score <= 3
    UNION SELECT doc_id, chunk_no FROM ({PAIRS_SQL}) WHERE length(src) > 2 * length(out) AND chunk_no % 4 < 2""")
def retry_selection(spark: SparkSession, d: str) -> DataFrame:
    short = pairs(spark, d).where("length(src) > 2 * length(out)").select("doc_id", "chunk_no", F.lit("error").alias("severity"))
    tried = short.where("chunk_no % 4 > 0").select("doc_id", "chunk_no", (F.col("chunk_no") % 4).alias("attempts"))
    return context.retry_selection(short, tried, _reviews(spark, d))


# --- paired checks ---

@query(f"""
    SELECT doc_id, chunk_no, round(CASE WHEN s > 0 THEN o / s ELSE 0 END, 3) AS ratio,
           s > 0 AND CASE WHEN s < 200 THEN o / s < 0.5 OR o / s > 4.0 ELSE o / s < 0.9 OR o / s > 2.3 END AS outside
    FROM (SELECT doc_id, chunk_no, CAST(length({strip("src")}) AS DOUBLE) AS s, length({strip("out")}) AS o FROM ({PAIRS_SQL}))""")
def length_check(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(
        "doc_id", "chunk_no", T.rounded(lint.length_ratio(F.col("src"), F.col("out"))).alias("ratio"), lint.length_outside(F.col("src"), F.col("out")).alias("outside")
    )


# --- integrity, merge, prompts ---


@query("SELECT conv_id AS doc_id, turn AS chunk_no, 'chunk' || lpad(CAST(turn AS VARCHAR), 4, '0') AS chunk_id, sha256(text) AS source_hash FROM conversations")
def sha_manifest(spark: SparkSession, d: str) -> DataFrame:
    return integrity.manifest(turns(spark, d)).select("doc_id", "chunk_no", "chunk_id", "source_hash")


@query(f"""
    WITH u AS (SELECT conv_id AS doc_id, turn AS chunk_no, text FROM conversations WHERE role = 'user'),
    o AS (SELECT doc_id, chunk_no, out FROM ({PAIRS_SQL}))
    SELECT doc_id, chunk_no, CASE WHEN out IS NULL THEN 'output missing' WHEN strlen(out) = 0 THEN 'output empty'
           WHEN NOT regexp_matches(out, '\\S') THEN 'output blank' ELSE 'output suspiciously short' END AS reason
    FROM u LEFT JOIN o USING (doc_id, chunk_no) WHERE out IS NULL OR strlen(out) = 0 OR NOT regexp_matches(out, '\\S') OR strlen(out) * 10 < strlen(text)""")
def merge_validation(spark: SparkSession, d: str) -> DataFrame:
    users = turns(spark, d).where("role = 'user'")
    outputs = pairs(spark, d).select("doc_id", "chunk_no", F.col("out").cast("binary").alias("content"))
    return integrity.validate_for_merge(integrity.manifest(users), users, outputs).select("doc_id", "chunk_no", "reason")


@query("""
    SELECT conv_id AS doc_id, string_agg(trim(text, chr(10)), chr(10) || chr(10) ORDER BY turn) || chr(10) AS text
    FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id""")
def ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    return assemble.merge(turns(spark, d))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return integrity.fingerprints(_documents(spark, d))


@query("""
    SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def to_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Documents to chunk again after a run that built two thirds of them, a fifth with another chunk size."""
    docs = _documents(spark, d)
    size = F.when(F.col("doc_id") % 5 == 0, 100).otherwise(segment.TARGET)
    built = integrity.fingerprints(docs).where("doc_id % 3 <> 0").withColumns({"chunk_size": size, "chunk_count": F.lit(1)})
    return integrity.to_rebuild(docs, built, segment.TARGET).select("doc_id")


_TEMPLATE = "Chunk {CHUNK_ID} ({DOMAIN})\n<!-- IF:NEIGHBOR_CONTEXT -->\nContext:\n{NEIGHBOR_CONTEXT}\n<!-- ENDIF:NEIGHBOR_CONTEXT -->\nWrite {OUTPUT_PATH}\n"


@query(rf"""
    WITH near AS (
        SELECT conv_id AS doc_id, turn AS chunk_no,
            coalesce(CASE WHEN lag(turn) OVER w = turn - 1 THEN {strip("right(lag(text) OVER w, 300)")} END, '') AS prev,
            coalesce(CASE WHEN lead(turn) OVER w = turn + 1 THEN {strip("left(lead(text) OVER w, 300)")} END, '') AS next
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    shown AS (SELECT *, concat_ws(chr(10) || chr(10),
        CASE WHEN prev <> '' THEN 'Previous chunk excerpt (chunk' || lpad(CAST(chunk_no - 1 AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no - 1 AS VARCHAR))) AS INT), '0') || ', read-only):' || chr(10) || '```text' || chr(10) || prev || chr(10) || '```' END,
        CASE WHEN next <> '' THEN 'Next chunk excerpt (chunk' || lpad(CAST(chunk_no + 1 AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no + 1 AS VARCHAR))) AS INT), '0') || ', read-only):' || chr(10) || '```text' || chr(10) || next || chr(10) || '```' END) AS near,
        'chunk' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no AS VARCHAR))) AS INT), '0') AS id FROM near)
    SELECT doc_id, chunk_no, trim(regexp_replace('Chunk ' || id || ' (islamic)' || chr(10)
        || CASE WHEN regexp_matches(near, '\S') THEN 'Context:' || chr(10) || near || chr(10) ELSE '' END
        || 'Write ./work/output_' || id || '.md' || chr(10), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS prompt
    FROM shown""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    near = context.neighbour_prompt(context.neighbour_context(turns(spark, d)))
    return assemble.prompts(turns(spark, d), _TEMPLATE, context=near)
