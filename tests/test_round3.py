"""What the review of round 3 found: odd rows and forms that grow with the input."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from heronmill.operators import checkpoints as K
from heronmill.operators import facade as A
from heronmill.operators import ingest as I
from heronmill.operators import material as M
from heronmill.operators import tables as T
from heronmill.plans import load_plans
from heronmill.plans.registry import ORACLES, QUERIES

load_plans()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_plans_with_too_many_pages_are_told_as_in_sql(spark, tmp_path):
    """Order 1 has 16 lines, order 50 has 17 and a page that needs itself, order 2 has 15."""
    lines = [(k, n, n, n) for k, size in ((1, 16), (50, 17), (2, 15), (100, 3)) for n in range(size)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(ORACLES["k26_plan_violations"]).fetchall(), key=repr)
    assert rows_of(QUERIES["k26_plan_violations"](spark, str(tmp_path)).select("plan_id", "broken")) == want
    assert (1, "too_many,") in want


def test_many_questions_are_asked_in_one_pass(spark):
    """1,100 questions by vectors with ties and by words, on rows of which some share an id; against brute force."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (300, 3)).astype(float)
    vectors[0] = 1, 1, 1
    words = ("ant", "bee", "cat")
    texts = [" ".join(w for j, w in enumerate(words) if (i * 7 + i // 5) >> j & 1) for i in range(300)]
    chunks = [(i - i % 50 // 49, vectors[i].tolist(), texts[i], words[i % 3] if i % 4 == 0 else "") for i in range(300)]
    terms = lambda q: [(w, 1.0 + j) for j, w in enumerate(words) if (q % 7 + 1) >> j & 1]
    asked = [(q, rng.integers(1, 4, 3).astype(float).tolist(), terms(q)) for q in range(1100)]
    schema = "query_id long, vector array<double>, terms array<struct<text: string, weight: double>>"
    questions = spark.createDataFrame(asked, schema)
    rows = spark.createDataFrame(chunks, "id long, vector array<double>, text string, title string")

    by_vector = A.vector_route(questions, rows, "id", "vector", 4)
    by_words = A.lexical_route(questions, rows, "id", F.col("text"), F.col("title"), 4)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (by_vector, by_words)]
    assert [p.count("Union") for p in plans] == [0, 0]

    want_vectors, want_words = [], []
    norms = np.linalg.norm(vectors, axis=1)
    for q, v, ts in asked:
        v = np.array(v) / np.linalg.norm(v)
        scored = sorted((-round(float(v @ (vectors[i] / norms[i])), 9) + 0.0, chunks[i][0]) for i in range(300) if norms[i] > 0)
        want_vectors += [(q, key, -s + 0.0) for s, key in scored[:4]]
        sums = {}
        for key, _, text, title in chunks:
            for w, weight in ts:
                own = sums.setdefault(key, [0.0, 0.0])
                own[0] += weight * (w in text)
                own[1] += weight * (w in title)
        ranked = sorted((-max(s), key) for key, s in sums.items() if max(s) > 0)
        want_words += [(q, key, -s) for s, key in ranked[:4]]
    got_vectors = [(r.query_id, r.id, r.similarity) for r in by_vector.collect()]
    assert sorted((q, round(s, 6)) for q, _, s in got_vectors) == sorted((q, round(s, 6)) for q, _, s in want_vectors)
    assert sorted((r.query_id, r.id, r.raw_score) for r in by_words.collect()) == sorted(want_words)


def test_keys_of_two_tables_meet_without_joins_or_joined_tasks(spark):
    """Repeated rows, rows of one side and nulls, as the joins of before gave them; as many tasks as are stated."""
    left = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 1)], "document_id long, chunk_index int")
    right = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (2, 1), (2, 1), (None, 1)], "document_id long, chunk_index int")
    lacking = [(None, 1, "no chunk"), (None, 1, "no vector"), (1, 2, "no vector"), (3, 1, "no chunk"), (3, 1, "no chunk")]
    found = I.vector_violations(left, right)
    assert rows_of(found) == sorted(lacking, key=repr)
    told = [(None, 1, "missing"), (None, 1, "unknown"), (1, 2, "missing"), (2, 1, "repeated"), (3, 1, "unknown")]
    problems = M.narration_problems(left, right, "document_id", "chunk_index")
    assert rows_of(problems) == sorted(told, key=repr)
    for df in (found, problems):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.rdd.getNumPartitions() >= T.LEAST_PARTS


def test_what_holds_is_asked_once_of_a_page(spark):
    """A plan of 17 pages, settled by rounds, beside small ones."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def looked_at(page):
        seen.add(1)
        return page != "p0"

    needs = lambda p: [] if p == 0 else [f"p{p - 1}" if p < 3 else f"p{p}"]
    rows = [(k, f"p{p}", needs(p)) for k, n in ((1, 17), *((k, 4) for k in range(2, 30))) for p in range(n)]
    pages = spark.createDataFrame(rows, "plan_id long, page_id string, prerequisites array<string>")
    got = rows_of(K.kept_pages(pages.withColumn("holds", looked_at("page_id"))))
    assert got == sorted(((k, f"p{p}") for k, n in ((1, 17), *((k, 4) for k in range(2, 30))) for p in range(3, n)), key=repr)
    assert seen.value == len(rows)
