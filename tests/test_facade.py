"""Retrieval of many questions whose routes fail one by one, and contexts, against loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from heronmill.operators import facade as A
from heronmill.operators.retrieval import recall_limit

WORDS = ["red", "blue", "Green", "sum", "50%", "a_b"]
QUESTIONS = "query_id long, vector array<double>, terms array<struct<text: string, weight: double>>"
CHUNKS = "doc long, emb array<float>, text string, title string"


def ranked(scores):
    return {i: n + 1 for n, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0])))}


def by_hand(questions, chunks, dims, k):
    hits, status = [], {}
    limit = recall_limit(k)
    for q, vector, terms in questions:
        fault = None
        if vector is None:
            fault = "no vector"
        elif len(vector) != dims:
            fault = f"vector has {len(vector)} of {dims} dimensions"
        elif any(x is None or not math.isfinite(x) for x in vector):
            fault = "vector is not finite"
        elif not any(vector):
            fault = "vector has no length"
        usable = sorted({(t.strip().lower(), w) for t, w in terms or [] if t and t.strip() and w > 0})
        no_terms = None if usable else "no terms"
        near, words = {}, {}
        for doc, emb, text, title in chunks:
            if doc is None:
                continue
            if fault is None and emb is not None and len(emb) == dims and any(emb):
                a, b = np.array(vector), np.array(emb, np.float32).astype(float)
                near[doc] = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
            surfaces = [sum(w for t, w in usable if t in (s or "").lower()) for s in (text, title)]
            if max(surfaces) > 0:
                words[doc] = round(max(surfaces), 9)
        v, w = ({i: r for i, r in ranked(s).items() if r <= limit} for s in (near, words))
        score = {i: round((1 / (60 + v[i]) if i in v else 0) + (1 / (60 + w[i]) if i in w else 0), 9) for i in v.keys() | w.keys()}
        own = {i: r for i, r in ranked(score).items() if r <= k}
        hits += [(q, i, "hybrid" if i in v and i in w else "vector" if i in v else "lexical", r) for i, r in own.items()]
        told = "; ".join(x for x in (fault, no_terms) if x)
        status[q] = (fault, no_terms, len(own), len(v), told if told and not own else None, "no vectors of this model" if fault is None and not v else None)
    return sorted(hits), status


def test_every_route_may_fail(spark):
    rnd = random.Random(4)
    chunks = [
        (i, rnd.choice([None, [rnd.random() - 0.5 for _ in range(4)], [0.0] * 4, [1.0]]) if i % 3 else [rnd.random() for _ in range(4)],
         rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=4))]), rnd.choice([None, "Red", "x"]))
        for i in range(80)
    ] + [(None, [1.0] * 4, "red", "red")]
    questions = [
        (1, [1.0, 2.0, 0.0, 1.0], [("red", 1.0), (" SUM ", 0.5), ("", 1.0)]), (2, None, [("green", 1.0), ("50%", 2.0), ("a_b", 0.25)]),
        (3, [1.0, 1.0], [("blue", 1.0)]), (4, [1.0, 0.0, 0.0, 0.0], []), (5, None, None), (6, [math.nan] * 4, [("zz", 1.0)]),
        (7, [0.0] * 4, [("red", -1.0)]), (8, [1.0, math.inf, 0.0, 0.0], [("red", 1.0)]), (9, [1.0, None, 0.0, 0.0], [("red", 1.0)]),
    ]
    asked = spark.createDataFrame([*questions, (None, [1.0] * 4, [])], QUESTIONS)
    rows = spark.createDataFrame(chunks, CHUNKS).repartition(3)
    hits, status = A.retrieve(asked, rows, 4, 5, "doc", "emb", F.col("text"), F.col("title"))
    want_hits, want_status = by_hand(questions, chunks, 4, 5)
    assert sorted((r.query_id, r.id, r.method, r["rank"]) for r in hits.collect()) == want_hits
    assert {r.query_id: tuple(r)[1:] for r in status.collect()} == want_status
    # A corpus without vectors leaves the words, and is told of.
    hits, status = A.retrieve(asked, rows.withColumn("emb", F.lit(None).cast("array<float>")), 4, 5, "doc", "emb", F.col("text"), F.col("title"))
    assert {r.method for r in hits.collect()} == {"lexical"}
    assert {r.query_id for r in status.where("hint IS NOT NULL").collect()} == {1, 4}
    hits, status = A.retrieve(asked.limit(0), rows, 4, 5, "doc", "emb", F.col("text"), F.col("title"))
    assert hits.count() == 0 and status.count() == 0
    hits, _ = A.retrieve(asked, rows.limit(0), 4, 5, "doc", "emb", F.col("text"), F.col("title"))
    assert hits.count() == 0


def test_blocks_of_questions_give_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    chunks = spark.createDataFrame([(i, [rnd.random() for _ in range(3)], rnd.choice(WORDS), "") for i in range(40)], CHUNKS)
    asked = spark.createDataFrame([(q, [rnd.random() for _ in range(3)], [(rnd.choice(WORDS), 1.0)]) for q in range(7)], QUESTIONS)
    run = lambda: sorted(map(str, A.retrieve(asked, chunks, 3, 4, "doc", "emb", F.col("text"), F.col("title"))[0].collect()))
    want = run()
    monkeypatch.setattr(A, "BLOCK", 2)
    assert run() == want and len(want) == 28


def selected(rows, anchor, budget):
    """The whole group if it fits, else grown to the right and to the left in turn."""
    at = [i for i, _ in rows]
    size = dict((i, len(t)) for i, t in rows)
    if sum(size.values()) + len(at) - 1 <= budget:
        return at
    low = high = at.index(anchor)
    used = size[anchor]
    moved = True
    while moved:
        moved = False
        if high + 1 < len(at) and used + size[at[high + 1]] + 1 <= budget:
            high, moved = high + 1, True
            used += size[at[high]] + 1
        if low and used + size[at[low - 1]] + 1 <= budget:
            low, moved = low - 1, True
            used += size[at[low]] + 1
    return at[low : high + 1]


def test_contexts(spark):
    rnd = random.Random(6)
    chunks = []
    for doc in range(6):
        text = ""
        for i in range(12):
            text = text[-rnd.choice([0, 0, 12]) :] + "".join(rnd.choice("abc .") for _ in range(rnd.randint(5, 90)))
            chunks.append((doc, i, ["s1", "", ""][doc % 3] if i % 2 else ["s2", "", ""][doc % 3], ["", "f", ""][doc % 3], text))
    schema = "document_id long, chunk_index int, section_path string, symbol string, content string"
    hits = [(doc // 3, 1 + 4 * (doc % 3) + n, *chunks[doc * 12 + i][:4]) for doc in range(6) for n, i in enumerate((0, 5, 11, 7))]
    rows = spark.createDataFrame(chunks, schema).withColumn("at", F.lit("extra"))
    asked = spark.createDataFrame(hits, "query_id long, rank int, document_id long, chunk_index int, section_path string, symbol string")
    for per_hit, total in ((2000, 8000), (150, 700), (60, 8000)):
        got = {(r.query_id, r["rank"]): r.context for r in A.contexts(asked, rows, per_hit, total).collect()}
        left = {0: total, 1: total}
        for q, rank, doc, index, section, symbol in sorted(hits):
            own = [(c[1], c[4]) for c in chunks if c[0] == doc and (c[2] == section if section else c[3] == symbol if symbol else abs(c[1] - index) <= 1)]
            want = ""
            if left[q] > 0:
                texts, before = dict(own), None
                for at in selected(own, index, min(per_hit, left[q])):
                    if before is None:
                        want = texts[at]
                    else:
                        n = 0
                        if not symbol or section:
                            n = next((n for n in range(min(200, len(before), len(texts[at])), 3, -1) if before.endswith(texts[at][:n])), 0)
                        want += ("" if n else "\n" if symbol and not section else "\n\n") + texts[at][n:]
                    before = texts[at]
                want = "" if want.strip() == texts[index].strip() else want.strip()
                left[q] -= len(want)
            assert got[q, rank] == want
    assert A.contexts(asked, rows.where("chunk_index <> 5"), 2000, 8000).where("rank = 2").first().context == ""
    assert A.contexts(asked.limit(0), rows).count() == 0


def test_vectors_of_equal_labels(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), [rnd.random() for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id int, label string, vector array<double>").repartition(4)
    asked = df.where("vec_id % 10 = 0").withColumn("query_id", F.col("vec_id").cast("long"))
    got = sorted((r.query_id, r["rank"], r.id) for r in A.vector_route(asked, df, "vec_id", "vector", 3, "label").collect())
    want = []
    for i, label, v in rows[::10]:
        if label is not None:
            near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, other, w in rows if other == label)
            want += [(i, n + 1, j) for n, (_, j) in enumerate(near[:3])]
    assert got == sorted(want)
