"""The corpus pipeline: each stage calls one training-data operator on all that the stage before kept.

quality   documents that the calibrated quality score puts below one half go
near      one document of each group of near duplicates stays
secrets   secrets are replaced in the texts
mixing    documents are repeated or left out so that domain shares come near their targets; those of the clean domain set the total
packing   the texts are packed into sequences; this stage returns the pieces

All stages but the last return the columns of documents, and keep further ones whatever their names. Null and empty texts are scored and
packed like any other, and are no copies of each other; null ids stay null. Of rows that repeat in id and text one stays, by a hash of all
columns; of a group of near duplicates the row of the smallest id stays. An empty table gives no rows. An id with several labels has the
smallest quality of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, quality_classifier, secret_scan
from tessera.llm.common import materialize, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (score,) = unused(docs.columns, "score")
    scored = quality_classifier.with_score(docs, table(spark, sf_dir, "labels"), quality_classifier.third(), score)
    return scored.where(F.col(score) >= 0.5).drop(score)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), anchor="clean")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near", near), ("secrets", secrets), ("mixing", mixed), ("packing", packed)]

#: SQL has neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
