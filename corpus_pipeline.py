"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common, copies, mixing, pieces, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field, fitted on labelled documents, doesn't reject."""
    field = quality.learn(docs, common.read(spark, sf_dir, "labels"))
    score = common.unused(docs.columns, "quality_score")
    return quality.with_score(docs, field, name=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Candidates are SimHash fingerprints within two bits and MinHash bands; a link is a Jaccard similarity of 0.8 of
    five-word shingles.
    """
    return copies.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by their kind; n_chars follows the text."""
    before = common.unused(docs.columns, "before")
    clean = secrets.redacted(docs.withColumn(before, F.col("text")))
    changed = ~F.col(before).eqNullSafe(F.col("text"))
    chars = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).drop(before)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut or left out."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the text's piece ids, their decoded text and whether it equals the text."""
    return pieces.encoded(docs)


STAGES = [("quality", keep_good), ("near duplicates", keep_one_of_each), ("secrets", redact), ("mixing", mix),
          ("pieces", encode)]
# Trained scores, fingerprint components and encodings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
