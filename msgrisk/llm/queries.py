"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.llm import (
    alignment,
    dedup,
    extraction,
    packing,
    quality,
    quotes,
    resampling,
    sharding,
    simhash,
    tokens,
    topk,
    toxicity,
    urlfilter,
)

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    encoded = tokens.encode(table(spark, sf_dir, "documents"), path)
    return tokens.digests(encoded, path).withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return quality.quality(docs, labels).withColumnRenamed("id", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judged(pages, urlfilter.rules_table(spark)).withColumnRenamed("id", "page_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("row")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    rows = packing.pieces(table(spark, sf_dir, "documents"), path)
    return packing.packed(rows).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return toxicity.toxicity(docs, labels).withColumnRenamed("id", "doc_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extracted(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").alias("page_id"), "url", "text",
        F.length("text").cast("long").alias("n_chars"), "n_shared", "n_frame",
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    return resampling.resampled(docs, target).withColumnRenamed("id", "doc_id").drop("digest")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in (BYTE_VOCABULARY, PIECE_VOCABULARY))
    found, _ = alignment.align(table(spark, sf_dir, "documents"), *paths)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_quality, op3_url_filter, op4_simhash, op5_top_k,
        op6_exact_dedup, op7_packing, op8_quotes, op9_toxicity, op10_html,
        op11_sharding, op12_resampling, op13_alignment,
    )
}



def _crc32_sql(hexed: str) -> str:
    """SQL for the CRC-32 of bytes in hexadecimal digits, four bits at a time."""
    table = []
    for start in range(16):
        value = start
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(f"{value}::BIGINT")
    # Of each byte the lower four bits come first.
    digit = f"{hexed}[(i // 2) * 2 + 2 - i % 2]"
    digits = f"list_transform(range(length({hexed})), lambda i: (instr('0123456789ABCDEF', {digit}) - 1)::BIGINT)"
    step = f"xor(c >> 4, [{', '.join(table)}][(xor(c, n) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, n: {step}), 4294967295)"


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN translate(
                       regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                   ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN
                       regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)
                   ELSE '' END AS path
            FROM pages
        ), rules(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
                   ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
                   ('block', 'com', '/de/')
        ), best AS (
            SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM (SELECT DISTINCT host, path FROM parts) urls
            JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                      AND starts_with(path, rule_path)
            GROUP BY host, path
        )
        SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
    """,
    "op5_top_k": """
        WITH numbers AS (
            SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
            FROM numbers q JOIN numbers c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
              FROM scores)
        WHERE rank <= 5
    """,
    "op6_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM texts
    """,
    "op12_resampling": f"""
        WITH words AS (
            SELECT doc_id, true AS own, {_WORDS} AS w FROM documents
            UNION ALL SELECT NULL, false, {_WORDS} FROM benchmark
        ), spans AS (
            SELECT doc_id, own, unnest(list_concat(w,
                list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
        ), counted AS (SELECT doc_id, own, f, count(*) AS n FROM spans GROUP BY ALL
        ), bucketed AS (
            SELECT f, {_crc32_sql("h")} % 10000 AS b FROM (SELECT DISTINCT f, hex(f) AS h FROM counted)
        ), features AS (SELECT doc_id, own, b, n FROM counted JOIN bucketed USING (f)
        ), totals AS (
            SELECT coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s_all,
                   coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t_all FROM features
        ), gains AS (
            SELECT b, floor(1000 * ln((coalesce(sum(n) FILTER (NOT own), 0) + 1)::DOUBLE * (s_all + 10000)
                              / ((coalesce(sum(n) FILTER (own), 0) + 1)::DOUBLE * (t_all + 10000)))) AS gain
            FROM features, totals GROUP BY b, s_all, t_all
        ), weights AS (
            SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight
            FROM features JOIN gains USING (b) WHERE own GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
                   coalesce(weight, 0)::BIGINT AS weight,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT
                       AS score
            FROM words LEFT JOIN weights USING (doc_id) WHERE own
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able
            FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}
