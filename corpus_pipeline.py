"""The corpus pipeline: five stages over ``documents``, each written and read again.

All stages take any columns besides ``doc_id`` and ``text``, and every stage but the last returns
the columns it got. Defined cases of every stage: an empty table gives an empty table; rows with a
null id stay, since no decision names them; null and empty texts are texts without words; rows that
repeat an id share its decisions, and ties go to the smallest id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronmill.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from heronmill.llm.shared import stored

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all stay where no label can be learned from."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go from the text; ``n_chars``, if there, follows it."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest id."""
    return jaccard_join.keep_first(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with its token ids, their number, and whether they decode to it again.

    Columns of ``docs`` that have one of the three names give way.
    """
    vocab = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.encode(docs.drop("n_tokens", "ids", "round_trip"), vocab)
    same = byte_bpe.decode(F.col("ids"), vocab) == F.coalesce("text", F.lit("")).cast("binary")
    out = out.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same})
    return out.drop("text")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
