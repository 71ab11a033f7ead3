"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgauge.llm import (
    classifier, cover_tree, cross_polytope, embeddings, line_dedup, mixing, packing, page_text, permuterm, quality_rules, secret_scan, sharding, simhash)

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), shingle=4, distance=4)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line of the corpus repeats."""
    return line_dedup.dedup(_table(spark, folder, "documents")).select("doc_id", "text", "n_lines_dropped")


def op3_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(_table(spark, folder, "pages"))


def op4_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"), threshold=0.98)


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``bytes``: equal texts stay together, the largest shard is as small as contiguous cutting allows."""
    return sharding.shard_documents(_table(spark, folder, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(_table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents"))


def op9_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = classifier.fit_outside_fold(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", classifier.score_column(docs, model).alias("score"))
    return scored.select("doc_id", classifier.fold().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return permuterm.spelling_variants(_table(spark, folder, "documents"))


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = cover_tree.whole_numbers(_table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash, op2_line_dedup, op3_page_text, op4_embeddings, op5_sharding, op6_mixing, op7_secrets, op8_quality_rules, op9_classifier, op10_packing,
    op11_spelling, op12_nearest, op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op13_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
