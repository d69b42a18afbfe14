"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import contamination, lines, mixing, ngram_join, oracle, passages, secrets, sharding, topk, toxicity, url_filter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove(table(spark, sf_dir, "documents")).drop("spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_repeated_passages, op3_secret_scan, op4_ngram_join, op5_line_dedup, op6_sharding, op7_decontamination, op8_url_filter, op9_topk_search, op10_source_mixing, pipeline)
}

ORACLE: dict[str, str] = {
    "op4_ngram_join": oracle.NGRAM_JOIN,
    "op5_line_dedup": oracle.LINE_DEDUP,
    "op7_decontamination": oracle.DECONTAMINATION,
    "op8_url_filter": oracle.url_filter_sql(),
    "op9_topk_search": oracle.TOPK,
    "op10_source_mixing": oracle.mixing_sql(),
}
