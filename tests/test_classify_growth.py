"""What the review of round 3 found of classification: it was done twice, and by patterns that prose does not need."""

from pyspark.sql import functions as F

from heronmill.functions import classify as K
from heronmill.operators import ingest as I


def test_texts_are_classified_once_for_chunks_and_state(spark):
    docs = spark.createDataFrame([(1, "package a\n\nfunc f() {}", "s"), (1, "Text.", "s"), (None, "z", "s"), (3, None, "s")], "doc_id long, text string, source string")
    state = I.ingest(docs)[0]
    assert "function" not in state.select("class")._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r.doc_id), r["class"].kind, r.n_chunks, r.status) for r in state.collect())
    assert got == [("1", "code", 2, "ready"), ("1", "plain_text", 2, "ready"), ("3", "plain_text", 0, "failed"), ("None", "plain_text", 0, "failed")]


def test_signs_are_sought_only_in_texts_with_their_words(spark):
    """Prose needs no pattern of a language; each language is still known by its signs."""
    of = {
        "go": "package a\n\nfunc f() {\n}", "python": "import a\nclass B:\n    def f(self):\n        pass\ndef g():\n    pass",
        "javascript": "const a = () => 1;\n", "java": "public class A {\n}", "rust": "fn f() {\n  let x = 1;\n}",
        "shell": "#!/bin/sh\necho $A\n", "sql": "SeLeCt a FROM b WHERE c", None: "Then we echo the class; it is done.",
    }
    rows = spark.createDataFrame([(k, t) for k, t in of.items()], "language string, text string")
    got = rows.select("language", K.language_signs(F.col("text")).alias("found"))
    assert all(r.language == r.found for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") > 10
