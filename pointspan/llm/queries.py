"""Queries of the operators in this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointspan.llm.ann_forest import ann_forest
from pointspan.llm.maxent_lm import maxent_lm
from pointspan.llm.mixing import mixing
from pointspan.llm.quality_rules import quality_rules
from pointspan.llm.sentencepiece_codec import sentencepiece
from pointspan.llm.sharding import sharding
from pointspan.llm.simhash import simhash
from pointspan.llm.toxicity import toxicity
from pointspan.llm.url_filter import learning, page_labels, url_filter
from pointspan.llm.warc import warc
from pointspan.shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    known = page_labels(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_filter(pages, learning(known))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_ann_forest": op3_ann_forest,
    "op4_sharding": op4_sharding,
    "op8_simhash": op8_simhash,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_maxent_lm": op10_maxent_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.head < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.head < p.page_id THEN f.head END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
}
