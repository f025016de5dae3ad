"""Hybrid retrieval as DataFrame plans: vector and lexical recall, fusion, rerank, folding, assembly.

Every function takes and returns DataFrames, and ranks many queries at once where
a ``query_id`` column is present. Top-k uses ``row_number`` under a filter, which
Spark turns into a group limit before the shuffle, so a query's candidates are cut
in every partition first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.functions.folds import let
from heronmill.operators.tables import running_sum

RRF_K = 60
DEFAULT_K, MOST_K = 5, 50
RERANK_DEPTH = 30


def clamp_k(k: int) -> int:
    """Requested result count: 5 where none is asked for, 50 at most."""
    return DEFAULT_K if k <= 0 else min(k, MOST_K)


def recall_limit(k: int) -> int:
    """Candidates to take from each route for ``k`` results."""
    return max(4 * clamp_k(k), 10)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def top(df: DataFrame, k: int, *order: Column, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first ``k`` rows in this order for each group, numbered from 1."""
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    if not by:  # one global list: a top-k sort first, so the window sees k rows
        df = df.orderBy(*order).limit(k)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def vector_recall(chunks: DataFrame, vector: Column, query: Column, k: int, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact k-nearest rows by cosine, ties by id."""
    scored = chunks.withColumn("similarity", F.round(cosine(vector, query), 9)).where("similarity IS NOT NULL")
    return top(scored, k, F.desc("similarity"), F.asc(id_col), by=by)


def presence(lower: Column, weighted: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of the distinct patterns that occur in a text in lower case."""
    total = F.lit(0.0)
    for text, weight in weighted:
        total = total + F.when(F.contains(lower, F.lower(F.lit(text))), F.lit(float(weight))).otherwise(0.0)
    return total


def like_pattern(text: str) -> str:
    """``text`` as a literal infix for LIKE with ``\\`` as the escape."""
    for special in ("\\", "%", "_"):
        text = text.replace(special, "\\" + special)
    return f"%{text}%"


def clean_terms(terms: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    """Trimmed terms without blanks; a weight of zero or less is an error."""
    if any(weight <= 0 for _, weight in terms):
        raise ValueError("a lexical term needs a positive weight")
    return [(text.strip(), weight) for text, weight in terms if text.strip()]


def lexical_recall(
    chunks: DataFrame,
    content: Column,
    title: Column,
    terms: Sequence[tuple[str, float]],
    phrases: Sequence[tuple[str, float]],
    k: int,
    *order: Column,
) -> DataFrame:
    """Weighted substring ranking over content and title.

    A surface counts only if a term occurs in it; phrases add to it. The two
    surfaces' lists merged by the larger score equal one ranking by ``greatest``.
    """
    terms, phrases = clean_terms(terms), clean_terms(phrases)

    def score(surface: Column) -> Column:
        # A text is made lower once, and each pattern is sought in it once.
        def of(lower: Column) -> Column:
            return let(presence(lower, terms), lambda own: F.when(own > 0, own + presence(lower, phrases)).otherwise(0.0))

        return let(F.lower(surface), of)

    scored = chunks.withColumn("raw_score", F.greatest(score(content), score(title))).where("raw_score > 0")
    return top(scored, k, F.desc("raw_score"), *order)


def fuse(vector: DataFrame, lexical: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists with ``keys`` as identity and ties."""
    both = [*by, *keys]
    lists = vector.select(*both, F.col("rank").alias("v_rank"), "similarity").unionByName(
        lexical.select(*both, F.col("rank").alias("l_rank")), allowMissingColumns=True
    )
    merged = lists.groupBy(*both).agg(
        F.max("v_rank").alias("v_rank"), F.max("l_rank").alias("l_rank"), F.max("similarity").alias("similarity")
    )
    return ranked_fusion(merged, keys, k, by)


def ranked_fusion(merged: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))

    method = (
        F.when(F.col("v_rank").isNotNull() & F.col("l_rank").isNotNull(), "hybrid")
        .when(F.col("v_rank").isNotNull(), "vector")
        .otherwise("lexical")
    )
    scored = merged.withColumn("score", F.round(part("v_rank") + part("l_rank"), 9)).withColumn("method", method)
    return top(scored, k, F.desc("score"), *(F.asc(c) for c in keys), by=by)


def fuse_variants(lists: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Fusion over query variants: lists of (variant, rank, method, similarity) rows."""
    merged = lists.groupBy(*keys).agg(
        F.round(F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"),
        F.max("similarity").alias("similarity"),
        F.bool_or(F.col("method").isin("vector", "hybrid")).alias("by_vector"),
        F.bool_or(F.col("method").isin("lexical", "hybrid")).alias("by_words"),
    )
    method = F.when(F.col("by_vector") & F.col("by_words"), "hybrid").when(F.col("by_vector"), "vector").otherwise("lexical")
    rows = merged.withColumn("method", method).drop("by_vector", "by_words")
    return top(rows, k, F.desc("score"), *(F.asc(c) for c in keys))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The best 30 hits in a new order; equal and missing scores keep the old one."""
    head = hits.where(F.col("rank") <= max(RERANK_DEPTH, k)).withColumnRenamed("rank", "fused_rank")
    return top(head.withColumn("rerank_score", score), k, F.desc_nulls_last("rerank_score"), F.asc("fused_rank"))


def group_key(document: Column, chunk: Column, section: Column, symbol: Column) -> Column:
    """Identity of a hit's group: its section, else its symbol, else the chunk."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return (
        F.when(has(section), F.concat_ws(":", F.lit("s"), document, section))
        .when(has(symbol), F.concat_ws(":", F.lit("y"), document, symbol))
        .otherwise(F.concat_ws(":", F.lit("c"), chunk))
    )


def fold(hits: DataFrame, key: Column, k: int) -> DataFrame:
    """The best hit of each group, then the first ``k`` of them."""
    keyed = hits.withColumn("group_key", key)
    best = Window.partitionBy("group_key").orderBy("rank")
    rows = keyed.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
    return top(rows.withColumnRenamed("rank", "hit_rank"), k, F.asc("hit_rank"))


def neighbours(hits: DataFrame, chunks: DataFrame, document: str, index: str, reach: int = 1) -> DataFrame:
    """For each hit the chunks of its document at most ``reach`` places away.

    The hit is expanded to the places it wants, so the join has equal keys only.
    """
    wanted = hits.select(
        F.col(document).alias("hit_document"),
        F.col(index).alias("hit_index"),
        F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias("at"),
    )
    return wanted.join(chunks, (F.col("hit_document") == chunks[document]) & (F.col("at") == chunks[index]))


def windowed_text(rows: list[tuple[int, str]], anchor: int, budget: int, separator: str = "\n") -> list[int]:
    """Places of the rows around ``anchor`` that fit: all, or grown right then left."""
    sizes = {i: len(text) for i, text in rows}
    order = sorted(sizes)
    if sum(sizes.values()) + len(separator) * (len(order) - 1) <= budget:
        return order
    at = order.index(anchor)
    low = high = at
    used = sizes[anchor]
    while True:
        grown = False
        for step, place in ((1, high + 1), (-1, low - 1)):
            if 0 <= place < len(order) and used + sizes[order[place]] + len(separator) <= budget:
                used += sizes[order[place]] + len(separator)
                low, high = min(low, place), max(high, place)
                grown = True
        if not grown:
            return order[low : high + 1]


def trim_overlap(before: str, after: str, least: int = 4, most: int = 200) -> str:
    """``after`` without the longest prefix that ends ``before``."""
    for n in range(min(most, len(before), len(after)), least - 1, -1):
        if before.endswith(after[:n]):
            return after[n:]
    return after


def assemble(hits: DataFrame, groups: DataFrame, per_hit: int = 2000, total: int = 8000) -> DataFrame:
    """Contexts under character budgets, in rank order.

    ``hits`` has (query_id, rank, hit_id, content); ``groups`` has (query_id,
    hit_id, at, anchor, content), the rows that may surround a hit. A query's hits are at most 50, so
    one query's rows are one small group.
    """

    def build(pdf):
        import pandas as pd

        out, used = [], 0
        for (rank, hit), own in pdf.groupby(["rank", "hit_id"], sort=True):
            anchor = int(own["anchor"].iloc[0])
            rows = [(int(a), t) for a, t in zip(own["at"], own["content"])]
            picked = windowed_text(rows, anchor, per_hit)
            texts = dict(rows)
            text = texts[picked[0]]
            for a in picked[1:]:
                text += trim_overlap(text, texts[a])
            text = text[:per_hit]
            if used + len(text) > total:
                text = texts[anchor][: max(0, total - used)]
            used += len(text)
            out.append((own["query_id"].iloc[0], rank, hit, text, len(text)))
        return pd.DataFrame(out, columns=["query_id", "rank", "hit_id", "context", "n_chars"])

    rows = hits.select("query_id", "rank", "hit_id").join(groups, ["query_id", "hit_id"])
    return rows.groupBy("query_id").applyInPandas(
        build, "query_id long, rank int, hit_id long, context string, n_chars long"
    )


def running_budget(df: DataFrame, size: Column, budget: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order up to the first whose running size passes the budget."""
    return running_sum(df, size, "running", *order, by=by).where(F.col("running") <= budget)
