"""The registered corpus queries, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import (
    decontaminate,
    fertility,
    licenses,
    lm_score,
    merkle,
    negatives,
    packing,
    quality,
    repeats,
    secrets,
    simhash,
    token_count,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_licenses(documents(spark, sf_dir)).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.with_quality(docs, quality.fit(docs)).drop("text")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_secrets(documents(spark, sf_dir)).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(documents(spark, sf_dir))
    return classes.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return fertility.with_quality(table).drop("text", "lang")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.leaks(documents(spark, sf_dir), items)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the conversations as target."""
    target = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    return lm_score.with_scores(documents(spark, sf_dir), target).drop("text")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.with_token_counts(documents(spark, sf_dir))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row is an anchor; every seventh has another label than the table says."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.col("label").cast("bigint")
    rows = table.where(negatives.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        negatives.whole_numbers(F.col("embedding")).alias("vector"),
    )
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_pack,
        op2_licenses,
        op3_quality,
        op4_secrets,
        op5_simhash,
        op6_fertility,
        op7_url_filter,
        op8_decontaminate,
        op9_lm_score,
        op10_token_count,
        op11_hard_negatives,
        op12_merkle,
        op13_repeats,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.oracle(),
        "op7_url_filter": url_filter.oracle(),
        "op11_hard_negatives": negatives.oracle(),
        "op12_merkle": merkle.oracle(),
    }
