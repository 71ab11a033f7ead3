"""From raw documents to packed training sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgauge.llm import classifier, line_dedup, mixing, packing, simhash
from plumbgauge.llm.common import ensure_checkpoint_dir
from plumbgauge.llm.queries import VOCABULARY


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Labels are learnt from outside the held-out fold only."""
    model = classifier.fit_outside_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(classifier.score_column(docs, model) >= 0.7)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so does a document that this leaves without any text, for all of it stands elsewhere."""
    return line_dedup.dedup(docs).where((F.col("n_lines_dropped") == 0) | (F.length(F.btrim("text", F.lit(" \t\r\n"))) > 0)).withColumn(
        "n_chars", F.length("text").cast("long")).drop("n_lines_dropped")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target: documents repeated, whole or in part, as the mix takes them."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality classifier", classifier_stage), ("line dedup", line_dedup_stage), ("SimHash near-dedup", simhash_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL: the classifier, the fingerprints and the tokens have no counterpart there.
ORACLE_SQL = None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: the next stage starts from files, not from this one's plan."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
