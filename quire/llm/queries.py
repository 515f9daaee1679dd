"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chat import format_chats
from quire.llm.common import read_table
from quire.llm.crf_quality import quality_scores
from quire.llm.exact_dedup import exact_groups
from quire.llm.gif import decode_media, gif_features, store_as_gif
from quire.llm.packing import pack
from quire.llm.passage_dedup import passage_dedup
from quire.llm.sentencepiece_scan import encode_pieces
from quire.llm.simhash import near_groups
from quire.llm.suffix_dedup import suffix_dedup
from quire.llm.token_codes import read_token_files, write_token_files


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_features(decode_media(store_as_gif(read_table(spark, sf_dir, "documents"))))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read_table(spark, sf_dir, "documents"), summary=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_crf_quality": op1_crf_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_gif_media": op4_gif_media,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_codes": op6_token_codes,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_packing": op9_packing,
    "op10_passage_dedup": op10_passage_dedup,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WHERE doc_id IS NOT NULL
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_chat_format": """
        WITH turns AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), logged AS (
            SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn, role, text) AS said
            FROM turns GROUP BY conv_id
        ), heads AS (
            SELECT conv_id, n, k, list_slice(said, 1, k) AS head
            FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM logged)
        ), best AS (
            SELECT k, head, max(n) AS best_n,
                   max({'n': n, 'neg': -conv_id})['neg'] AS best_neg
            FROM heads GROUP BY k, head
        ), kept AS (
            SELECT logged.conv_id, logged.n FROM logged
            JOIN best ON best.k = logged.n AND best.head = logged.said
            WHERE best_n = logged.n AND best_neg = -logged.conv_id
        )
        SELECT t.conv_id, CAST((place - 1) // 4096 AS BIGINT) AS part,
               any_value(kept.n) AS n_turns, count(*) AS part_turns,
               string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
                          || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM turns) t JOIN kept USING (conv_id)
        GROUP BY t.conv_id, part
    """,
    "op5_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL
        ), n AS (
            SELECT doc_id, h, length(h) // 2 AS n FROM d
        ), s AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win
            FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)
        ), dup AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM s) WHERE low < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS p FROM dup, range(50) AS r(k)
        ), runs AS (
            SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev < p - 1) AS n_spans
            FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM gone) GROUP BY doc_id
        ), kept AS (
            SELECT b.doc_id, sha256(unhex(string_agg(x, '' ORDER BY b.p))) AS kept_sha256
            FROM (SELECT doc_id, i AS p, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM n)) b
            ANTI JOIN gone ON gone.doc_id = b.doc_id AND gone.p = b.p GROUP BY b.doc_id
        )
        SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM n LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op10_passage_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
        ), s AS (
            SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
        ), dup AS (
            SELECT doc_id, i FROM s JOIN (SELECT win FROM s GROUP BY win HAVING count(*) > 1) USING (win)
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS p FROM dup, range(35) AS r(k)
        ), kept AS (
            SELECT b.doc_id, count(*) AS n, sha256(string_agg(x, ' ' ORDER BY b.p)) AS kept_sha256
            FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d) b
            ANTI JOIN gone ON gone.doc_id = b.doc_id AND gone.p = b.p GROUP BY b.doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}
