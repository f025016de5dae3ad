"""Ingest: from document rows to chunks and vectors, with the checks before each write."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from heronmill.functions import text as X
from heronmill.operators import chunks as C
from heronmill.operators import code_units as U
from heronmill.operators import tables
from heronmill.sources.storage import stored

DIMENSIONS = 64


@pandas_udf(ArrayType(FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """The offline default of an embedding service: hashed character trigrams, of length one."""
    lower = texts.fillna("").str.lower().tolist()
    sizes = np.array([len(t) for t in lower])
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros((len(lower), DIMENSIONS))
    if len(codes) >= 3:
        row = np.repeat(np.arange(len(lower)), sizes)
        h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        own = row[:-2] == row[2:]  # no trigram goes from a text to the next one
        slot = row[:-2] * DIMENSIONS + ((h >> np.uint64(40)) % np.uint64(DIMENSIONS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(33)) & np.uint64(1))
        out += np.bincount(slot[own], sign[own], out.size).reshape(out.shape)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return pd.Series(list((out / np.where(norm == 0, 1, norm)).astype(np.float32)))


def register(existing: DataFrame, files: DataFrame) -> DataFrame:
    """New documents, those whose owner has no file of the same digest, as pending."""
    fresh = tables.first_per_group(files, ["owner_id", "digest"], F.asc("doc_id"))
    fresh = fresh.join(existing.select("owner_id", "digest"), ["owner_id", "digest"], "left_anti")
    return fresh.withColumn("status", F.lit("pending")).withColumn("attempt", F.lit(0))


def claim(docs: DataFrame) -> DataFrame:
    """Pending documents become processing, with one more attempt."""
    pending = F.col("status") == "pending"
    return tables.update_where(docs, pending, attempt=F.col("attempt") + 1, status=F.lit("processing"))


def recovery_stage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where an interrupted document goes on: embed, chunk, parse or nowhere."""
    have = chunks.select(F.col("document_id").alias("_doc")).distinct()
    stage = (
        F.when(F.col("_doc").isNotNull(), "embed")
        .when(F.trim(F.coalesce("text", F.lit(""))) != "", "chunk")
        .when(F.col("source").isNotNull(), "parse")
        .otherwise("error")
    )
    return docs.join(have, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", stage.alias("stage"))


def ingest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their state, their chunks, and the chunks' vectors."""
    # What a text is, is told once for its chunks and its state.
    docs = U.classified(docs.select("doc_id", "text", "source", F.lit("").alias("path")), "text", "path")
    chunks = stored(U.split_classified(docs.withColumnRenamed("doc_id", "id")), "chunks")
    counts = chunks.groupBy("document_id").count()
    state = (
        docs.join(counts, F.col("doc_id") == F.col("document_id"), "left")
        .withColumn("n_chunks", F.coalesce("count", F.lit(0)))
        .withColumn(
            "error",
            F.when(F.col("n_chunks") == 0, "empty").when(F.col("n_chunks") > C.MOST_CHUNKS, "too many chunks"),
        )
        .select(
            "doc_id",
            F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"),
            "error",
            "n_chunks",
            X.document_title(F.col("text"), F.col("source")).alias("title"),
            "class",
        )
    )
    vectors = chunks.select("document_id", "chunk_index", hash_embedding("content").alias("embedding"))
    return state, chunks, vectors


def vector_violations(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """What must be empty before documents become ready: chunks and vectors that do not match."""
    keys = ["document_id", "chunk_index"]
    both = tables.key_counts(chunks, vectors, keys)
    matched = (F.col("n_left") > 0) & (F.col("n_right") > 0) & F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
    told = lambda n, problem: F.array_repeat(F.lit(problem), F.col(n).cast("int"))
    problems = F.concat(told("n_left", "no vector"), told("n_right", "no chunk"))
    return both.where(~matched).select(*keys, F.explode(problems).alias("problem"))


def write_chunks(spark: SparkSession, chunks: DataFrame, path: str) -> None:
    """Replace the buckets of the documents at hand and no others."""
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(256)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
