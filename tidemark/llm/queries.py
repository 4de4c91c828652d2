"""Registered queries over the corpus tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, mixing, packing, pii, quality_model, quality_rules, simhash, substring_dedup, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=50)


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_GAPS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP8_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), windows AS (
    SELECT row_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8
), keyed AS (
    SELECT row_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS key FROM windows
), twice AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, key) AS n FROM keyed
), covered AS (
    SELECT row_id, count(DISTINCT p) AS n
    FROM (SELECT row_id, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY row_id
), m AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(translate(t, {_GAPS}, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        length(t) - length(translate(t, '!', '')) AS n_shouts,
        length(t) - length(translate(t, '{quality_rules.UPPER}', '')) AS n_upper,
        len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop,
        len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•', '|'))) AS n_bullets, len(ls) AS n_lines
    FROM w LEFT JOIN covered USING (row_id)
), j AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1
        AND n_shouts / n_words <= 0.3 AND n_upper / word_chars <= 0.5
        AND (n_words < 100 OR n_stop / n_words >= 0.01) AND n_dup_lines / n_lines <= 0.5
        AND n_bullets / n_lines <= 0.9 AS kept
FROM j
"""


#: Base 32 of a digest: five hexadecimal digits are four letters.
OP10_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), f AS (
    SELECT *, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": OP8_SQL, "op10_archive_round_trip": OP10_SQL}
