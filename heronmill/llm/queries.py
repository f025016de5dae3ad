"""Queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from heronmill.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    fill_middle,
    importance,
    jaccard_join,
    language_id,
    line_dedup,
    pii,
    quality,
    sql,
    suffix_dedup,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocab = byte_bpe.Vocabulary.load(path, public_tokenizers.PATTERN)
    return byte_bpe.digest(_table(spark, sf_dir, "documents"), vocab)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.digest(_table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


QUERIES["op1_byte_bpe"] = op1_byte_bpe
QUERIES["op2_jaccard_join"] = op2_jaccard_join
QUERIES["op3_embedding_dedup"] = op3_embedding_dedup
QUERIES["op4_url_filter"] = op4_url_filter
QUERIES["op5_decontaminate"] = op5_decontaminate
QUERIES["op6_toxicity"] = op6_toxicity
QUERIES["op8_language_id"] = op8_language_id
QUERIES["op7_line_dedup"] = op7_line_dedup
QUERIES["op9_suffix_dedup"] = op9_suffix_dedup
QUERIES["op10_quality"] = op10_quality
QUERIES["op11_importance"] = op11_importance
QUERIES["op12_fill_middle"] = op12_fill_middle
QUERIES["op13_pii"] = op13_pii
ORACLES["op2_jaccard_join"] = sql.JACCARD_JOIN
ORACLES["op3_embedding_dedup"] = sql.EMBEDDING_DEDUP
ORACLES["op5_decontaminate"] = sql.DECONTAMINATE
ORACLES["op7_line_dedup"] = sql.LINE_DEDUP
ORACLES["op11_importance"] = sql.IMPORTANCE
ORACLES["op12_fill_middle"] = sql.FILL_MIDDLE
