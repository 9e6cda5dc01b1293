"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, packing
from .chat import op7_chat
from .common import spread, table
from .exact_dedup import exact_duplicates
from .fingerprint import neighbour_fingerprints, op8_fingerprints
from .html_wrapper import op3_html_extraction
from .langid import op1_language_id
from .minhash import near_duplicates
from .quality import op5_quality
from .url_rules import op9_url_filter, url_fixed_rules


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spread(table(spark, sf_dir, "documents", "doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(spread(table(spark, sf_dir, "documents", "doc_id", "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can say."""
    return neighbour_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_html_extraction": op3_html_extraction,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_quality": op5_quality,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_chat": op7_chat,
        "op8_fingerprints": op8_fingerprints,
        "op9_url_filter": op9_url_filter,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "edited_texts": edited_texts,
        "url_fixed_rules": url_fixed_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
            e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM c)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   sum(length('<|im_start|>') + length(replace(r, chr(10), '\n')) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id
        """,
        "edited_texts": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t)
            SELECT doc_id, n AS n_chars, sha256(left(text, n - n // 4) || left(following, n // 4)) AS edited_sha256 FROM n
        """,
        "url_fixed_rules": r"""
            WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
            r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
            SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS fixed_verdict FROM r
        """,
        "op4_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)
        """,
        "op10_minhash_near_dedup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            s AS (
                SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END) AS g FROM w),
            n AS (SELECT w.doc_id, count(s.g) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
            sets AS (SELECT doc_id, md5(string_agg(g, chr(31) ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY doc_id),
            reps AS (SELECT k, min(doc_id) AS rep, min(n) AS n FROM sets GROUP BY k),
            rs AS (SELECT r.rep, r.n, s.g FROM reps r JOIN s ON s.doc_id = r.rep),
            pairs AS (
                SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
                FROM rs x JOIN rs y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
                GROUP BY x.rep, y.rep),
            links AS (SELECT a, b FROM pairs WHERE 100 * common >= 75 * (na + nb - common)),
            edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
            comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
            SELECT n.doc_id, n.n_shingles, coalesce(comp.component_id, n.doc_id) AS component_id,
                   coalesce(comp.component_id, n.doc_id) = n.doc_id AS kept
            FROM n LEFT JOIN sets ON sets.doc_id = n.doc_id LEFT JOIN reps ON reps.k = sets.k LEFT JOIN comp ON comp.rep = reps.rep
        """,
    }
