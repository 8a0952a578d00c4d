"""The training-data queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, licenses, line_dedup, mixing, near_dedup, ogg, packing, perplexity, secrets, suffix_dedup
from .common import per_row


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("text")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "copy")


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def _line_digest(doc_id, text, bitmap):
    n, dropped, left = line_dedup.kept_lines(text, bitmap)
    return doc_id, n, dropped, hashlib.sha256(left).hexdigest()


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_row(line_dedup.with_bitmaps(documents(spark, sf_dir)), _line_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.store_media(documents(spark, sf_dir)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_row(secrets.scan_secrets(documents(spark, sf_dir)), secrets.secret_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    base, own = F.col("places.label"), F.col("templates.label")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_perplexity": op4_perplexity,
    "op5_main_text": op5_main_text,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_ogg": op8_ogg,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "[\\x20\\x09-\\x0D]"

#: DuckDB SQL for the queries that SQL can express; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
        ), each AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
        FROM sets LEFT JOIN least ON doc_id = a""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^{_SPACES}+|{_SPACES}+$', '', 'g'), {_LOWER}) AS key FROM lines
        ), frequent AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT doc_id, i, line, coalesce(doc_id <> keeper, FALSE) AS dropped FROM keyed LEFT JOIN frequent USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
