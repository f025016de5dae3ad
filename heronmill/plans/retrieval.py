"""Retrieval queries over documents and embeddings."""

from pyspark.sql import functions as F

from heronmill.operators import facade as A
from heronmill.operators import retrieval as R
from heronmill.plans.registry import query, table

#: The query vector of the examples, and weighted terms and phrases.
PROBE = 7
TERMS = (("the", 1.0), ("ation", 2.0), ("100%", 3.0), ("queue_", 2.0))
PHRASES = (("of the", 4.0),)

_TERM_SQL = " + ".join(
    f"CASE WHEN {{s}} ILIKE '{R.like_pattern(t)}' ESCAPE '\\' THEN {w} ELSE 0 END" for t, w in TERMS
)
_PHRASE_SQL = " + ".join(
    f"CASE WHEN {{s}} ILIKE '{R.like_pattern(t)}' ESCAPE '\\' THEN {w} ELSE 0 END" for t, w in PHRASES
)


def _score_sql(surface: str) -> str:
    own = _TERM_SQL.format(s=surface)
    return f"CASE WHEN ({own}) > 0 THEN ({own}) + ({_PHRASE_SQL.format(s=surface)}) ELSE 0 END"


_PROBE_SQL = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {PROBE})"
_VECTOR_SQL = f"""
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}), 9) AS similarity
FROM embeddings
"""
_LEXICAL_SQL = f"""
SELECT doc_id, source, greatest({_score_sql("text")}, {_score_sql("source")})::DOUBLE AS raw_score FROM documents
"""


def probe(spark, sf_dir):
    """The probe row's vector as a literal: one row of 64 numbers."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").head(1)
    return R.vector_literal(rows[0][0])


def vector_list(spark, sf_dir, k):
    found = R.vector_recall(table(spark, sf_dir, "embeddings"), F.col("embedding"), probe(spark, sf_dir), k, "vec_id")
    return found.select("vec_id", "label", "similarity", "rank")


def lexical_list(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return R.lexical_recall(docs, F.col("text"), F.col("source"), TERMS, PHRASES, k, F.asc("doc_id"))


@query(
    "c01_vector_topk",
    f"SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM ({_VECTOR_SQL}) QUALIFY rank <= 20",
)
def vector_topk(spark, sf_dir):
    return vector_list(spark, sf_dir, 20)


@query(
    "b02_vector_filtered_topk",
    f"""SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM ({_VECTOR_SQL})
    WHERE label IN (1, 3) QUALIFY rank <= 20""",
)
def vector_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3))
    found = R.vector_recall(rows, F.col("embedding"), probe(spark, sf_dir), 20, "vec_id")
    return found.select("vec_id", "label", "similarity", "rank")


@query(
    "c01_vector_join_documents",
    f"""SELECT vec_id, similarity, d.lang, d.source, left(d.text, 40) AS head,
      row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank
    FROM ({_VECTOR_SQL}) v JOIN documents d ON v.vec_id = d.doc_id WHERE d.lang <> 'fr' QUALIFY rank <= 20""",
)
def vector_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang <> 'fr'").select("doc_id", "lang", "source", "text")
    rows = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    found = R.vector_recall(rows, F.col("embedding"), probe(spark, sf_dir), 20, "vec_id")
    return found.select("vec_id", "similarity", "lang", "source", F.left("text", F.lit(40)).alias("head"), "rank")


@query(
    "c01_vector_batch_topk",
    """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id,
      round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[],
        q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def vector_batch(spark, sf_dir):
    """A stated set of queries, those whose id 20 divides, against the rows of their label."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").cast("long").alias("query_id"), "label", F.col("embedding").alias("vector"))
    found = A.vector_route(asked, rows, "vec_id", "embedding", 5, "label")
    return found.select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


@query(
    "f01_lexical_weighted",
    f"""SELECT doc_id, raw_score, row_number() OVER (ORDER BY raw_score DESC, doc_id) AS rank FROM ({_LEXICAL_SQL})
    WHERE raw_score > 0 QUALIFY rank <= 20""",
)
def lexical(spark, sf_dir):
    return lexical_list(spark, sf_dir, 20).select("doc_id", "raw_score", "rank")


@query(
    "g01_lexical_title_max",
    """SELECT doc_id, greatest(CASE WHEN text ILIKE '%tion%' THEN 1 ELSE 0 END,
      CASE WHEN source ILIKE '%c1%' THEN 3 ELSE 0 END)::DOUBLE AS raw_score,
      row_number() OVER (ORDER BY raw_score DESC, doc_id) AS rank
    FROM documents WHERE text ILIKE '%tion%' OR source ILIKE '%c1%' QUALIFY rank <= 40""",
)
def title_max(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = R.presence(F.lower("text"), [("tion", 1)])
    title = R.presence(F.lower("source"), [("c1", 3)])
    rows = docs.withColumn("raw_score", F.greatest(content, title)).where("raw_score > 0")
    return R.top(rows, 40, F.desc("raw_score"), F.asc("doc_id")).select("doc_id", "raw_score", "rank")


@query(
    "b05_wildcard_literal",
    r"""SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\' OR text ILIKE '%\_%' ESCAPE '\'""",
)
def wildcard(spark, sf_dir):
    text = F.col("text")
    hit = text.ilike(R.like_pattern("%%%")) | text.ilike(R.like_pattern("_"))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id")


_FUSED_SQL = f"""
v AS (SELECT vec_id AS doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS v_rank
  FROM ({_VECTOR_SQL}) QUALIFY v_rank <= 40),
l AS (SELECT doc_id, row_number() OVER (ORDER BY raw_score DESC, doc_id) AS l_rank FROM ({_LEXICAL_SQL})
  WHERE raw_score > 0 QUALIFY l_rank <= 40),
fused AS (SELECT doc_id, similarity,
    round(coalesce(cast(1.0 as double) / (60 + v_rank), 0) + coalesce(cast(1.0 as double) / (60 + l_rank), 0), 9) AS score,
    CASE WHEN v_rank IS NOT NULL AND l_rank IS NOT NULL THEN 'hybrid' WHEN v_rank IS NOT NULL THEN 'vector' ELSE 'lexical' END AS method
  FROM v FULL JOIN l USING (doc_id)),
hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 30)
"""


def hybrid_list(spark, sf_dir, k):
    n = R.recall_limit(10)
    vectors = vector_list(spark, sf_dir, n).withColumnRenamed("vec_id", "doc_id")
    return R.fuse(vectors, lexical_list(spark, sf_dir, n), ["doc_id"], k)


@query("e01_hybrid_fusion", f"WITH {_FUSED_SQL} SELECT doc_id, score, similarity, method, rank FROM hits WHERE rank <= 10")
def hybrid(spark, sf_dir):
    return hybrid_list(spark, sf_dir, 10).select("doc_id", "score", "similarity", "method", "rank")


@query(
    "e06_fold_by_group",
    f"""WITH {_FUSED_SQL}, keyed AS (SELECT h.doc_id, h.rank AS hit_rank, d.lang,
      row_number() OVER (PARTITION BY d.lang, d.source ORDER BY h.rank) AS place
      FROM hits h JOIN documents d USING (doc_id))
    SELECT doc_id, hit_rank, row_number() OVER (ORDER BY hit_rank) AS rank FROM keyed WHERE place = 1 QUALIFY rank <= 5""",
)
def folded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    hits = hybrid_list(spark, sf_dir, 30).join(docs, "doc_id")
    key = R.group_key(F.col("lang"), F.col("doc_id"), F.col("source"), F.lit(""))
    return R.fold(hits, key, 5).select("doc_id", "hit_rank", "rank")


@query(
    "f04_rerank",
    f"""WITH {_FUSED_SQL}, scored AS (SELECT h.doc_id, h.rank AS fused_rank,
      length(d.text) - length(replace(d.text, 'the', '')) AS rerank_score FROM hits h JOIN documents d USING (doc_id))
    SELECT doc_id, fused_rank, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, fused_rank) AS rank
    FROM scored QUALIFY rank <= 5""",
)
def reranked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = hybrid_list(spark, sf_dir, 30).join(docs, "doc_id")
    score = (F.char_length("text") - F.char_length(F.replace("text", F.lit("the"), F.lit("")))).cast("long")
    return R.rerank(hits, score, 5).select("doc_id", "fused_rank", "rerank_score", "rank")


@query(
    "e03_multi_query_fusion",
    """WITH q AS (SELECT vec_id AS variant, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (7, 20, 40)),
    s AS (SELECT q.variant, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 9) AS similarity
      FROM q, embeddings v),
    r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 20),
    f AS (SELECT vec_id, round(sum(cast(1.0 as double) / (60 + rank)), 9) AS score, max(similarity) AS similarity
      FROM r GROUP BY vec_id)
    SELECT vec_id, score, similarity, 'vector' AS method, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
    FROM f QUALIFY rank <= 10""",
)
def multi_query(spark, sf_dir):
    """Three variants of a question, ranked in one pass over the corpus, fused by rank."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id").isin(7, 20, 40)).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    found = A.vector_route(asked, rows, "vec_id", "embedding", 20)
    lists = found.select(F.col("id").alias("vec_id"), "similarity", "rank", F.lit("vector").alias("method"))
    return R.fuse_variants(lists, ["vec_id"], 10).select("vec_id", "score", "similarity", "method", "rank")


@query(
    "c18_neighbour_window",
    """SELECT h.conv_id, h.turn AS hit_turn, c.turn, c.text FROM conversations h JOIN conversations c
    ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.text ILIKE '%ation%'""",
)
def neighbour_window(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    hits = rows.where(F.col("text").ilike("%ation%"))
    found = R.neighbours(hits, rows, "conv_id", "turn")
    return found.select("conv_id", F.col("hit_index").alias("hit_turn"), "turn", "text")


@query(
    "e13_running_budget",
    """SELECT doc_id, lang, running FROM (SELECT doc_id, lang, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id
    ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 12000""",
)
def budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.char_length("text").cast("long")
    return R.running_budget(docs, size, 12_000, F.asc("doc_id"), by=["lang"]).select("doc_id", "lang", "running")


@query("e09_assemble_context")
def assembled(spark, sf_dir):
    """Contexts for the best vectors' conversations: neighbours within one turn, under budgets."""
    rows = table(spark, sf_dir, "conversations")
    hits = rows.where("turn = 1").orderBy(F.desc(F.char_length("text")), "conv_id").limit(20)
    hits = hits.withColumn("query_id", F.col("conv_id") % 4)
    ranked = R.top(hits, 5, F.desc(F.char_length("text")), F.asc("conv_id"), by=["query_id"])
    near = R.neighbours(ranked, rows, "conv_id", "turn")
    groups = near.select(
        (F.col("hit_document") % 4).alias("query_id"),
        F.col("hit_document").alias("hit_id"),
        F.col("turn").alias("at"),
        F.col("hit_index").alias("anchor"),
        F.col("text").alias("content"),
    )
    return R.assemble(ranked.select("query_id", "rank", F.col("conv_id").alias("hit_id")), groups)
