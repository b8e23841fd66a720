"""The queries on whole tables, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vexel.llm import ann, exact_dedup, lm_scoring, mixing, near_dedup, packing, sharding, token_counts, toxicity, warc
from vexel.plans.storage import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_key(read_table(spark, sf_dir, "documents"), 8)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_token_counts": op1_token_counts, "op2_ann": op2_ann, "op3_toxicity": op3_toxicity, "op4_warc": op4_warc, "op5_packing": op5_packing, "op6_near_dedup": op6_near_dedup, "op7_lm_scoring": op7_lm_scoring, "op8_sharding": op8_sharding, "op9_exact_dedup": op9_exact_dedup, "op10_mixing": op10_mixing, "pipeline": corpus_pipeline.run}


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
      (strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
      min(page_id) OVER (PARTITION BY hex) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP9_SQL = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op9_exact_dedup": OP9_SQL}
