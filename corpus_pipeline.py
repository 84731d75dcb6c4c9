"""Corpus pipeline: from raw documents to token ids, in five stages.

Quality rules and toxicity drop rows, near-dedup keeps one document of each
group, mixing drops and repeats rows so that sources come near their target
weights, and SentencePiece encodes what is left.  Every stage is written as
Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointspan.llm.mixing import mixed
from pointspan.llm.quality_rules import keep_good
from pointspan.llm.sentencepiece_codec import sentencepiece
from pointspan.llm.simhash import keep_one
from pointspan.llm.toxicity import keep_clean
from pointspan.shared import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece(docs, keep=("source",))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", encoding_stage),
]

#: Stages with fitted models and hashes can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
