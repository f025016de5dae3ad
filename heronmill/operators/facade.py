"""One call that retrieves for many questions, goes on when a route fails, and assembles contexts.

A question has an id, a vector and weighted terms. Either route may fail for a question and leaves the other one's hits;
what failed is told in columns of a status row, and nothing is raised (L01). Vectors of another size than the
model's, without length or with components that are null or not finite, are refused before the search (L02).

Questions are a stated set that is asked against all rows. ``PASS`` vectors at a time go to all tasks, where ``BLOCK`` of them
are one matrix product with a batch; of its scores only those move on that may be among a question's best. Texts are lowered once
and tested once for each distinct term. Rows with the same terms have the same score in every question, so the first ones of each
such class stand for all of it, and questions that ask for the same terms are answered once.

Defined cases: questions without an id are not asked, and of those that repeat an id the one with the largest vector is;
null contents and titles are empty; rows without a vector are found by words only, rows without an id not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from heronmill.operators.retrieval import fuse, recall_limit, top, trim_overlap, windowed_text
from heronmill.sources.storage import stored

BLOCK, PASS = 512, 4096
PER_HIT, TOTAL, REACH = 2000, 8000, 1


def vector_fault(vector: Column, dimensions: int) -> Column:
    """Why a question's vector cannot be searched for, or null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.size(vector)
    told = F.concat(F.lit("vector has "), size.cast("string"), F.lit(f" of {dimensions} dimensions"))
    return (
        F.when(vector.isNull(), "no vector").when(size != dimensions, told).when(bad, "vector is not finite")
        .when(~F.exists(vector, lambda x: x != 0), "vector has no length")
    )


def blocks_of(questions: DataFrame, *columns: str, size: int = BLOCK) -> Iterator[list]:
    """The questions by blocks; one block at a time is on the driver."""
    held: list = []
    for row in questions.select(*columns).toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def vector_route(
    questions: DataFrame, chunks: DataFrame, id_col: str, vector_col: str, k: int, by: str | None = None
) -> DataFrame | None:
    """(query_id, id, similarity, rank): the ``k`` rows of each question with the highest cosine, ties by id.

    With ``by``, a column of both, only rows that agree in it are compared; a null agrees with nothing.
    """
    kind = chunks.schema[id_col].dataType
    schema = StructType.fromDDL("query_id long, id long, similarity double")
    schema["id"].dataType = kind
    arrow = to_arrow_schema(schema)
    found = None
    columns = [F.col(id_col), F.col(vector_col), *([F.col(by)] if by else [])]
    for rows in blocks_of(questions, "query_id", "vector", *([by] if by else []), size=PASS):
        ids = np.array([r.query_id for r in rows], np.int64)
        of = np.array([r[by] for r in rows], object) if by else None
        asked = np.array([r.vector for r in rows], float)
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)

        def search(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked, of=of) -> Iterator[pa.RecordBatch]:
            blocks = range(0, len(ids), BLOCK)
            best = dict.fromkeys(blocks)  # (question, id, similarity) of the partition so far
            least = np.full(len(ids), -np.inf)  # what a question's k-th best row has so far
            for batch in batches:
                lists = batch.column(1)
                keep = np.flatnonzero(np.diff(np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) == asked.shape[1])
                if not len(keep):
                    continue
                own = lists.take(pa.array(keep))
                x = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(keep), -1)
                norms = np.linalg.norm(x, axis=1)
                fine = np.isfinite(norms) & (norms > 0)
                x, kept = x[fine] / norms[fine, None], pa.array(keep[fine])
                row_ids = batch.column(0).take(kept)
                if of is not None:
                    own_of = np.array(batch.column(2).take(kept).to_pylist(), object)
                for at in blocks:
                    part = slice(at, at + BLOCK)
                    score = np.round(asked[part] @ x.T, 9)
                    if of is not None:
                        score[(of[part, None] != own_of) | np.equal(of[part], None)[:, None]] = -np.inf
                    if score.shape[1] > k:
                        least[part] = np.maximum(least[part], np.partition(score, -k, axis=1)[:, -k])
                    q, row = np.nonzero((score >= least[part, None]) & (score > -np.inf))
                    if not len(q):
                        continue
                    new = pa.table({"q": q + at, "id": row_ids.take(pa.array(row)), "s": score[q, row]})
                    new = pa.concat_tables([best[at], new]) if best[at] is not None else new
                    new = new.sort_by([("q", "ascending"), ("s", "descending"), ("id", "ascending")])
                    group = new.column("q").to_numpy()
                    place = np.arange(len(group)) - np.searchsorted(group, group, "left")
                    best[at] = new.filter(pa.array(place < k))
                    last = np.flatnonzero(place == k - 1)
                    least[group[last]] = new.column("s").to_numpy()[last]
            for found in best.values():
                if found is not None:
                    out = [ids[found.column("q").to_numpy()], found.column("id").combine_chunks(), found.column("s").combine_chunks()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow)], schema=arrow)

        own = chunks.select(*columns).where(F.col(id_col).isNotNull()).mapInArrow(search, schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return None
    return top(found, k, F.desc("similarity"), F.asc("id"), by=["query_id"])


def lexical_route(questions: DataFrame, chunks: DataFrame, id_col: str, content: Column, title: Column, k: int) -> DataFrame | None:
    """(query_id, id, raw_score, rank): rows by the weights of the terms that the content or the title has, the larger sum."""
    spark = chunks.sparkSession
    keyed = questions.select("query_id", "terms", F.sha2(F.to_json(F.struct("terms")), 256).alias("set"))
    lower = chunks.select(
        F.col(id_col).alias("id"), *(F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((content, "content"), (title, "title")))
    ).where("id IS NOT NULL")
    found = None
    for sets in blocks_of(keyed.groupBy("set").agg(F.first("terms").alias("terms")), "set", "terms"):
        asked = [(r["set"], t.text.strip().lower(), float(t.weight)) for r in sets for t in r.terms if t.text and t.text.strip() and t.weight > 0]
        listed = F.array(*map(F.lit, sorted({w for _, w, _ in asked}))).cast("array<string>")
        weights = spark.createDataFrame(sorted(set(asked)), "set string, term string, weight double")
        has = F.filter(
            F.transform(listed, lambda w: F.struct(w.alias("term"), F.contains("content", w).alias("in_content"), F.contains("title", w).alias("in_title"))),
            lambda h: h["in_content"] | h["in_title"],
        )
        # An id has the terms of all its rows; those with the same ones are a class, of which no more than ``k`` can be asked for.
        classes = lower.select("id", has.alias("has")).where(F.size("has") > 0).groupBy("id").agg(
            F.array_sort(F.flatten(F.collect_list("has"))).alias("has")
        )
        first = top(classes, k, F.asc("id"), by=["has"]).select("id", F.explode("has").alias("h")).select("id", "h.*")
        # Some terms of one block of sets.
        own = first.join(F.broadcast(weights), "term").groupBy("set", "id").agg(
            F.greatest(*(F.sum(F.when(F.col(c), F.col("weight")).otherwise(0.0)) for c in ("in_content", "in_title"))).alias("raw_score")
        )
        found = own if found is None else found.unionByName(own)
    if found is None:
        return None
    ranked = top(found.withColumn("raw_score", F.round("raw_score", 9)), k, F.desc("raw_score"), F.asc("id"), by=["set"])
    return keyed.join(ranked, "set").select("query_id", "id", "raw_score", "rank")


def retrieve(
    questions: DataFrame, chunks: DataFrame, dimensions: int, k: int, id_col: str, vector_col: str, content: Column, title: Column
) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, id, score, similarity, method, rank) and one status row for each question.

    ``questions`` has (query_id, vector, terms), with terms of (text, weight).
    """
    limit = recall_limit(k)
    usable = F.filter("terms", lambda t: (F.trim(t["text"]) != "") & (t["weight"] > 0))
    one = F.max(F.struct("vector", "terms")).alias("q")
    asked = questions.where("query_id IS NOT NULL").groupBy("query_id").agg(one).select("query_id", "q.*").withColumns(
        {
            "vector_error": vector_fault(F.col("vector"), dimensions),
            "lexical_error": F.when(F.coalesce(F.size(usable), F.lit(0)) <= 0, "no terms"),
        }
    )
    # The questions and what the routes found, some rows of each question, are read several times.
    asked = stored(asked, "questions")
    vectors = vector_route(asked.where("vector_error IS NULL"), chunks, id_col, vector_col, limit)
    words = lexical_route(asked.where("lexical_error IS NULL"), chunks, id_col, content, title, limit)
    empty = chunks.select(F.col(id_col).alias("id")).where(F.lit(False)).withColumns(
        {"query_id": F.lit(0).cast("long"), "rank": F.lit(0), "similarity": F.lit(0.0), "raw_score": F.lit(0.0)}
    )
    vectors = empty.drop("raw_score") if vectors is None else stored(vectors, "vector-hits")
    words = empty.drop("similarity") if words is None else stored(words, "lexical-hits")
    hits = fuse(vectors, words, ["id"], k, by=["query_id"])
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    by_vector = vectors.groupBy("query_id").agg(F.count("*").alias("n_vectors"))
    status = asked.select("query_id", "vector_error", "lexical_error").join(counts, "query_id", "left").join(by_vector, "query_id", "left")
    n_hits, n_vectors = (F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hits", "n_vectors"))
    both = F.concat_ws("; ", "vector_error", "lexical_error")
    failed = F.when((F.coalesce("n_hits", F.lit(0)) == 0) & (both != ""), both)
    # A search that went well and found nothing tells of a corpus without vectors of the model.
    hint = F.when(F.col("vector_error").isNull() & (F.coalesce("n_vectors", F.lit(0)) == 0), "no vectors of this model")
    return hits, status.select("query_id", "vector_error", "lexical_error", n_hits, n_vectors, failed.alias("error"), hint.alias("hint"))


def context_rows(hits: DataFrame, chunks: DataFrame, reach: int = REACH) -> DataFrame:
    """(query_id, rank, at, content, joins): rows around each hit: of its section, else of its symbol, else its neighbours (F16).

    ``hits`` has (query_id, rank, document_id, chunk_index, section_path, symbol), ``chunks`` all but the first two and ``content``.
    """
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = chunks.select(
        F.col("document_id").alias("_doc"), F.col("chunk_index").alias("at"), F.col("section_path").alias("_section"),
        F.col("symbol").alias("_symbol"), "content",
    )
    mine = hits.select("query_id", "rank", "document_id", "chunk_index", "section_path", "symbol")
    same = F.col("document_id") == F.col("_doc")
    wide = mine.where(~has("section_path") & ~has("symbol")).withColumn(
        "_want", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach))
    )
    found = [
        mine.where(has("section_path")).join(rows, same & (F.col("section_path") == F.col("_section"))).withColumn("joins", F.lit("trim")),
        mine.where(~has("section_path") & has("symbol")).join(rows, same & (F.col("symbol") == F.col("_symbol"))).withColumn("joins", F.lit("line")),
        wide.join(rows, same & (F.col("_want") == F.col("at"))).withColumn("joins", F.lit("trim")).drop("_want"),
    ]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("query_id", "rank", "chunk_index", "at", "content", "joins")


def within_reach(rows: DataFrame, per_hit: int) -> DataFrame:
    """Rows that a context may hold: on either side of the hit no more than ``per_hit`` characters lie between.

    So a hit has a bounded number of characters, whatever the size of its section.
    """
    size = F.char_length("content")
    left = F.when(F.col("at") <= F.col("chunk_index"), size).otherwise(0)
    right = F.when(F.col("at") >= F.col("chunk_index"), size).otherwise(0)
    order = Window.partitionBy("query_id", "rank")
    sums = rows.withColumns(
        {
            "_left": F.sum(left).over(order.orderBy(F.desc("at"))) - left,
            "_right": F.sum(right).over(order.orderBy("at")) - right,
            "_all": F.sum(size).over(order),
        }
    )
    near = F.when(F.col("at") < F.col("chunk_index"), F.col("_left")).otherwise(F.col("_right"))
    return sums.where((F.col("at") == F.col("chunk_index")) | (near <= per_hit)).drop("_left", "_right", "_all")


def joined_context(rows: list[tuple[int, str]], anchor: int, budget: int, joins: str) -> str:
    """Selected rows in order: overlaps cut and texts put together, else an empty line; code by lines."""
    texts, out, before = dict(rows), "", None
    for at in windowed_text(rows, anchor, budget):
        own = texts[at]
        if before is not None:
            cut = trim_overlap(before, own) if joins == "trim" else own
            out += "" if cut != own else "\n\n" if joins == "trim" else "\n"
            out += cut
        else:
            out = own
        before = own
    text = out.strip()
    return "" if text == texts[anchor].strip() else text


def contexts(hits: DataFrame, chunks: DataFrame, per_hit: int = PER_HIT, total: int = TOTAL) -> DataFrame:
    """(query_id, rank, context): texts around the hits in order of rank while the total lasts.

    A question has at most 50 hits with a bounded text each, so its rows are one small group. A hit that its rows lack gets no context.
    """

    def build(pdf):
        import pandas as pd

        out, left = [], total
        for rank, own in pdf.groupby("rank", sort=True):
            text, anchor = "", int(own["chunk_index"].iloc[0])
            rows = [(int(a), t or "") for a, t in zip(own["at"], own["content"])]
            if left > 0 and any(a == anchor for a, _ in rows):
                text = joined_context(rows, anchor, min(per_hit, left), own["joins"].iloc[0])
                left -= len(text)
            out.append((int(own["query_id"].iloc[0]), int(rank), text))
        return pd.DataFrame(out, columns=["query_id", "rank", "context"])

    rows = within_reach(context_rows(hits, chunks), per_hit)
    return rows.groupBy("query_id").applyInPandas(build, "query_id long, rank int, context string")
