"""The pipeline on planted documents, and the registration of all queries."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from heronmill.llm import byte_bpe, line_dedup
from heronmill.llm.queries import QUERIES

RND = random.Random(8)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rnd = random.Random(seed)
    return ". ".join(" ".join(rnd.choice(WORDS) for _ in range(8)) for _ in range(n // 8)) + "."


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    item = prose(32, 5000)
    texts = {i: prose(80, i) for i in range(300)}
    bad = set(range(0, 300, 6))
    for i in bad:
        texts[i] = " ".join(w.upper() + "!!" for w in texts[i].split())
    texts[301] = texts[1].replace(texts[1].split()[40], "changed", 1)  # a near copy of 1
    texts[302] = f"{prose(40, 700)} {item} {prose(40, 701)}"  # a leak
    line = "A line that two documents have in common"
    texts[303], texts[304] = f"{line}\n{prose(80, 702)}", f"{prose(80, 703)}\n{line.upper()}  "
    rows = [(i, t, "en", "src", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i not in bad), 0) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(texts) - bad - {301, 302}
    own = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        special_tokens={},
    )
    texts[304] = prose(80, 703)
    assert all(r.round_trip and r.ids == own.encode_ordinary(texts[i]) for i, r in out.items())


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert out.schema == docs.schema
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
