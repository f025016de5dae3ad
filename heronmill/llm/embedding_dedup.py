"""Embedding near-dedup by spherical-cap filters of structured random product codes.

1. Identical vectors of a label become one class with a number of its own, its smallest id
   and its size. Vectors of different lengths never link; each length is done by itself.
2. A filter is a direction made of one code vector for each part of the rotated
   space, so ``codes ** PARTS`` directions cost ``codes * PARTS`` products. A vector
   is list-decoded to its ``best`` directions: its cap is as wide as it takes, so
   none is left without filters. (Under one threshold for all, most vectors exceed
   no filter and few exceed thousands.) The number of directions follows the largest
   label, so buckets stay small as rows grow. In a random rotation all pairs at the
   same cosine meet with the same probability, however isolated they are; it is
   measured for these codes, and as many independent rotations are used as bring a
   pair at the least cosine together with probability ``recall``.
3. Vectors of one label that share a filter are compared in blocks of a fixed size,
   exactly, in double precision; links become edges of components.
4. Inside each component all pairs of classes are compared again in blocks, which
   counts links exactly, also those that filters alone would have missed.

Defined cases: vectors that are null, empty, zero, or with null or non-finite
components, and rows with a null label or id, link with nothing; rows that repeat an
id and its vector count once as a partner; different vectors under one id are rows by
themselves, each with the links of its own vector. Every input row gives one output
row. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronmill.llm.shared import (
    arrow_pass,
    block_tasks,
    components,
    group_starts,
    linked,
    pairs_within,
    stored,
    whole_groups,
)

PARTS = 4


def usable(vector: str) -> Column:
    """Whether a vector may link at all."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(v, lambda x: x != 0)


class Filters:
    """Cap filters of one random rotation and product code."""

    def __init__(self, dims: int, codes: int, best: int, seed: int):
        rng = np.random.default_rng(seed)
        self.width = -(-dims // PARTS)
        size = self.width * PARTS
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        self.rotation = (q * np.where(np.diag(r) < 0, -1, 1))[:, :dims]  # so that every rotation is as likely
        books = rng.standard_normal((PARTS, codes, self.width))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        self.codes, self.best = codes, best

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """For each unit vector the numbers of its best filters, a row each."""
        parts = (unit @ self.rotation.T).reshape(len(unit), PARTS, self.width)
        scores = np.einsum("npw,pcw->npc", parts, self.books)
        order = np.argsort(-scores, axis=2, kind="stable")[:, :, : self.best]
        falling = np.take_along_axis(scores, order, 2)
        halves = [self.sums(falling[:, p], order[:, p], falling[:, p + 1], order[:, p + 1], self.codes) for p in (0, 2)]
        return self.sums(*halves[0], *halves[1], self.codes**2)[1]

    def sums(self, a, a_at, b, b_at, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The best sums of two falling lists of scores, falling, and their numbers."""
        # Places i and j have (i + 1) * (j + 1) sums that are no smaller, their own included.
        i, j = np.indices((a.shape[1], b.shape[1])).reshape(2, -1)
        some = (i + 1) * (j + 1) <= self.best
        i, j = i[some], j[some]
        sums = a[:, i] + b[:, j]
        order = np.argsort(-sums, axis=1, kind="stable")[:, : self.best]
        return np.take_along_axis(sums, order, 1), np.take_along_axis(a_at[:, i] * base + b_at[:, j], order, 1)


def code_size(largest: int, directions: int) -> int:
    """Codes of a part for ``directions`` filters a class of the largest label."""
    return max(8, int(np.ceil((directions * largest) ** (1 / PARTS))))


def meeting(dims: int, codes: int, best: int, cosine: float, trials: int = 32, pairs: int = 64) -> float:
    """A low estimate, by three deviations, of how often a pair at ``cosine`` shares a filter of one rotation."""
    met = []
    for trial in range(trials):
        filters = Filters(dims, codes, best, 1_000_000 + trial)
        rng = np.random.default_rng(2_000_000 + trial)
        x = unit_rows(rng.standard_normal((pairs, dims)))
        z = rng.standard_normal((pairs, dims))
        z = unit_rows(z - (z * x).sum(1, keepdims=True) * x)
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * z
        met.append((filters(x)[:, :, None] == filters(y)[:, None, :]).any((1, 2)).mean())
    return float(np.mean(met) - 3 * max(np.std(met), 0.01) / np.sqrt(trials))


def rotations_for(dims: int, codes: int, best: int, cosine: float, recall: float, least: int) -> int:
    """Rotations, ``least`` or more, after which a pair at ``cosine`` has met with probability ``recall``."""
    if dims == 1:
        return least  # parallel vectors have the same filters
    p = meeting(dims, codes, best, cosine)
    if p <= 0:
        raise ValueError(f"pairs at cosine {cosine} in {dims} dimensions do not share filters")
    return max(least, int(np.ceil(np.log(1 - recall) / np.log1p(-p))))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> DataFrame:
    """(rep, least, label, v, copies) of the classes of usable rows (vec, label, v); ``rep`` is the class's number."""
    same = rows.groupBy("label", "v").agg(F.min("vec").alias("least"), F.count_distinct("vec").alias("copies"))
    return stored(same.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")


def memberships(reps: DataFrame, dims: int, codes: int, rotations: int, best: int) -> DataFrame:
    """(bucket, rep): the label and filters of every class."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        filters = [Filters(dims, codes, best, seed) for seed in range(rotations)]
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                unit = unit_rows(matrix(part.column("v"), dims))
                found = np.concatenate([f(unit) * rotations + k for k, f in enumerate(filters)], axis=1)
                label = [str(x) for x in part.column("label").to_pylist() for _ in range(found.shape[1])]
                yield {"label": label, "filter": found.ravel(), "rep": np.repeat(part.column("rep").to_numpy(), found.shape[1])}

    found = arrow_pass(reps.select("rep", "label", "v"), "label string, filter long, rep long", decode)
    return found.select(F.xxhash64("label", "filter").alias("bucket"), "rep")


def compared(tasks: DataFrame, reps: DataFrame, key: str, dims: int, cosine: float, count: bool) -> DataFrame:
    """Edges (a, b) of verified links, or with ``count`` (rep, n), the sums of linked copies."""
    payload = reps.select(F.col("rep").alias("_rep"), "label", "v", "copies")
    rows = tasks.join(payload, F.col("rep") == F.col("_rep")).select(
        F.col(key).alias("key"), "lo", "hi", "own", "rep", F.xxhash64("label").alias("label"), "copies", "v"
    )
    keys = ["key", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in whole_groups(batches, keys):
            unit = unit_rows(matrix(table.column("v"), dims))
            rep, own, label, copies, lo, hi = (
                table.column(c).to_numpy() for c in ("rep", "own", "label", "copies", "lo", "hi")
            )
            inner = lo == hi
            got_a, got_b = [], []
            for a, b in pairs_within(group_starts(table, keys)):
                ok = (inner[a] | (own[a] != own[b])) & (label[a] == label[b]) & (rep[a] != rep[b])
                a, b = a[ok], b[ok]
                for s in range(0, len(a), 200_000):
                    x, y = a[s : s + 200_000], b[s : s + 200_000]
                    near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    got_a.append(x[near])
                    got_b.append(y[near])
            a, b = (np.concatenate(g) if g else np.empty(0, int) for g in (got_a, got_b))
            if count:
                n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
                some = n > 0
                yield {"rep": rep[some], "n": n[some].astype(np.int64)}
            elif len(a):
                x, y = linked(rep[a], rep[b])
                yield {"a": x, "b": y}

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return arrow_pass(dealt, "rep long, n long" if count else "a long, b long", verify)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    rotations: int = 6,
    best: int = 8,
    directions: int = 128,
    recall: float = 0.9999,
    block: int = 256,
) -> DataFrame:
    """(vec, n_links, component, kept) for every row of ``vectors``.

    ``rotations`` is the least number of them; more are used where ``recall`` needs more.
    """
    own = F.when(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col), F.col(vector_col))
    every = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), own.alias("v"))
    lengths = every.where("v IS NOT NULL").groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect()
    found = every.sparkSession.createDataFrame(
        [], StructType([every.schema["label"], every.schema["v"]]).add("n_links", "long").add("component", "long")
    )
    for row in lengths:  # as many rounds as there are different lengths
        part = every.where(F.size("v") == row.dims)
        found = found.unionByName(linked_classes(part, row.dims, cosine, rotations, best, directions, recall, block))
    known = found.select(F.col("label").alias("_label"), F.col("v").alias("_v"), "n_links", "component")
    return every.join(known, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left").select(
        "vec",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec").alias("component"),
        F.coalesce(F.col("vec") == F.coalesce("component", "vec"), F.lit(False)).alias("kept"),
    )


def linked_classes(rows: DataFrame, dims: int, cosine, rotations, best, directions, recall, block) -> DataFrame:
    """(label, v, n_links, component) of the classes of vectors of one length."""
    reps = classes(rows)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    codes = code_size(largest, directions)
    rotations = rotations_for(dims, codes, best, cosine, recall, rotations)
    buckets = stored(memberships(reps, dims, codes, rotations, best), "cap-filters")
    edges = compared(block_tasks(buckets, "bucket", "rep", block), reps, "bucket", dims, cosine, count=False)
    roots = stored(components(edges), "vector-components")
    tasks = block_tasks(roots.select(F.col("root"), F.col("id").alias("rep")), "root", "rep", block)
    links = compared(tasks, reps, "root", dims, cosine, count=True).groupBy("rep").agg(F.sum("n").alias("n"))
    member = roots.withColumnRenamed("id", "rep").join(reps.select("rep", "least"), "rep")
    smallest = member.groupBy("root").agg(F.min("least").alias("component"))
    per_class = (
        reps.select("rep", "least", "label", "v", "copies")
        .join(links, "rep", "left")
        .join(member.join(smallest, "root").select("rep", "component"), "rep", "left")
        .select(
            "label",
            "v",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "least").alias("component"),
        )
    )
    return stored(per_class, "vector-links")


def digest(vectors: DataFrame) -> DataFrame:
    """Rows of query op3."""
    return near_duplicates(vectors).select(
        F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )
