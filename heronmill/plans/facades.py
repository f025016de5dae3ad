"""Questions asked in one call, some of which lack a route."""

from pyspark.sql import functions as F

from heronmill.operators import facade as A
from heronmill.plans.registry import query, table

_ASKED = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 4 = 1 THEN NULL WHEN vec_id % 4 = 3 THEN e[1:3] ELSE e END AS e,
    CASE WHEN vec_id % 3 = 0 THEN [] ELSE [['tion', 'heit', 'mente', 'cion'][vec_id % 4 + 1], 'ing', 'zzqq'] END AS terms FROM v WHERE vec_id % 37 = 5),
c AS (SELECT d.doc_id AS id, lower(d.text) AS content, lower(d.source) AS title, v.e FROM documents d LEFT JOIN v ON v.vec_id = d.doc_id),
n AS (SELECT max(len(e)) AS n FROM v),
vs AS (SELECT query_id, id, round(list_cosine_similarity(c.e, q.e), 9) AS similarity FROM q, c, n WHERE len(q.e) = n.n AND c.e IS NOT NULL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS v_rank FROM vs QUALIFY v_rank <= 20),
t AS (SELECT query_id, unnest(terms) AS term, unnest([1.0, 0.5, 0.25]) AS weight FROM q WHERE len(terms) > 0),
ls AS (SELECT query_id, id, greatest(sum(CASE WHEN contains(content, term) THEN weight ELSE 0 END), sum(CASE WHEN contains(title, term) THEN weight ELSE 0 END)) AS raw
  FROM t, c WHERE contains(content, term) OR contains(title, term) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS l_rank FROM ls QUALIFY l_rank <= 20),
f AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + l_rank), 0), 9) AS score, similarity,
    CASE WHEN v_rank IS NOT NULL AND l_rank IS NOT NULL THEN 'hybrid' WHEN v_rank IS NOT NULL THEN 'vector' ELSE 'lexical' END AS method
  FROM vr FULL JOIN lr USING (query_id, id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5)"""


def _retrieved(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dimensions = vectors.agg(F.max(F.size("embedding"))).first()[0]
    key, own = F.col("vec_id"), F.col("embedding").cast("array<double>")
    first = F.element_at(F.array(*map(F.lit, ("tion", "heit", "mente", "cion"))), (key % 4 + 1).cast("int"))
    terms = F.array(
        *(F.struct(t.alias("text"), F.lit(w).alias("weight")) for t, w in ((first, 1.0), (F.lit("ing"), 0.5), (F.lit("zzqq"), 0.25)))
    )
    none = F.array().cast("array<struct<text: string, weight: double>>")
    asked = vectors.where(key % 37 == 5).select(
        key.cast("long").alias("query_id"),
        F.when(key % 4 == 3, F.slice(own, 1, 3)).when(key % 4 != 1, own).alias("vector"),
        F.when(key % 3 == 0, none).otherwise(terms).alias("terms"),
    )
    docs = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == key, "left")
    return A.retrieve(asked, docs, int(dimensions), 5, "doc_id", "embedding", F.col("text"), F.col("source"))


@query("l01_retrieve", f"WITH {_ASKED} SELECT query_id, id, score, similarity, method, rank FROM h")
def retrieved(spark, sf_dir):
    return _retrieved(spark, sf_dir)[0].select("query_id", "id", "score", "similarity", "method", "rank")


@query(
    "l01_retrieve_status",
    f"""WITH {_ASKED}, s AS (SELECT query_id, CASE WHEN e IS NULL THEN 'no vector' WHEN len(e) <> n THEN 'vector has ' || len(e) || ' of ' || n || ' dimensions' END AS vector_error,
      CASE WHEN len(terms) = 0 THEN 'no terms' END AS lexical_error,
      (SELECT count(*) FROM h WHERE h.query_id = q.query_id) AS n_hits, (SELECT count(*) FROM vr WHERE vr.query_id = q.query_id) AS n_vectors FROM q, n)
    SELECT *, CASE WHEN n_hits = 0 AND (vector_error IS NOT NULL OR lexical_error IS NOT NULL) THEN concat_ws('; ', vector_error, lexical_error) END AS error,
      CASE WHEN vector_error IS NULL AND n_vectors = 0 THEN 'no vectors of this model' END AS hint FROM s""",
)
def statuses(spark, sf_dir):
    return _retrieved(spark, sf_dir)[1]


@query("l03_contexts")
def contexts(spark, sf_dir):
    """Turns that speak of something as hits; roles are sections for some conversations and symbols for others."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"),
        F.when(F.col("conv_id") % 3 == 0, F.col("role")).otherwise("").alias("section_path"),
        F.when(F.col("conv_id") % 3 == 1, F.col("role")).otherwise("").alias("symbol"),
    )
    asked = rows.where(F.col("content").ilike("%ation%")).withColumn("query_id", F.col("document_id").cast("long"))
    return A.contexts(A.top(asked, 5, F.asc("chunk_index"), by=["query_id"]), rows)
