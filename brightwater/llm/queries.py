"""The queries `opN_<name>`, each over its whole table, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm import (
    decontamination,
    language,
    license_scan,
    mixing,
    quality,
    refinement,
    secret_scan,
    simhash_pivots,
    spelling_variants,
    url_filter,
    vector_codes,
    warc,
    window_dedup,
)
from brightwater.llm.common import table
from brightwater.llm.url_filter_sql import SQL as URL_FILTER_SQL
from brightwater.llm.vector_codes_sql import compress_sql


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return refinement.mark_copies(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_license_scan": op8_license_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
    SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
           min(page_id) OVER (PARTITION BY h) AS least
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least AND least IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM q
""",
    "op4_substring_dedup": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), w AS (
    SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g
    FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)
), gone AS (
    SELECT DISTINCT r, unnest(range(p, p + 13)) AS i
    FROM (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w)
    WHERE doc_id > least
), kept AS (
    SELECT a.r, string_agg(x, ' ' ORDER BY a.i) AS t, count(*) AS n
    FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d) a
    LEFT JOIN gone b ON a.r = b.r AND a.i = b.i
    WHERE b.r IS NULL
    GROUP BY a.r
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
""",
    "op7_url_filters": URL_FILTER_SQL,
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, true) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op13_vector_codes": compress_sql(),
}
