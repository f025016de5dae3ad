"""What the review of round 3 found of chunking: work that grew with levels and sentences."""

import random

from pyspark.sql import functions as F

from heronmill.operators.chunks import ENDS, Limits, chunk_documents, split_block


def packed_by_hand(text, fill):
    """Sentences added one after another while they fit; longer ones are cut by size."""
    signs = "。！？；…\n.!?;"
    sentences, own = [], ""
    for c in text:
        own += c
        if c in signs:
            sentences.append(own)
            own = ""
    out, held = [], ""
    for s in [*sentences, own]:
        if len(held) + len(s) > fill:
            out.append(held)
            held = ""
        if len(s) > fill:
            bare = s.removesuffix("\n")
            out += [bare[k : k + fill] for k in range(0, len(bare), fill)]
        else:
            held += s
    return [t for t in [*out, held] if t.strip()]


def test_sentences_are_packed_without_a_fold(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab é甲😀\r\u2028\x85\n.。!…") * rnd.choice([1, 1, 3, 40]) for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    limits = Limits(60, 10, 12)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("block", F.struct("text", F.lit(False).alias("whole")))
    df = rows.select("id", split_block(F.col("block"), limits).alias("parts"))
    assert "aggregate(" not in df._jdf.queryExecution().analyzed().toString()
    for r in df.collect():
        text = texts[r.id]
        want = [text] if len(text) <= limits.fill else packed_by_hand(text, limits.fill)
        assert r.parts == [t for t in want if t.strip("\t\n\v\f\r \x85\xa0\u2028")], text
    assert ENDS.count("。") == 1


def test_levels_are_joined_inside_of_one_group(spark):
    """Three aggregations, for blocks, sections and texts, whatever the levels are."""
    docs = spark.createDataFrame([(1, "# a\n\n## b\n\n###### c\n\nx.")], "doc long, text string")
    chunks = chunk_documents(docs, "doc", "text")
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
    assert [(r.section_path, r.content) for r in chunks.collect()] == [("a", "x.")]
