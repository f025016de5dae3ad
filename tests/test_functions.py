"""Unit cases of text functions, chunking, retrieval, sources and snapshots."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heronmill.functions import classify as C
from heronmill.functions import html as H
from heronmill.functions import json_values as J
from heronmill.functions import text as X
from heronmill.operators import retrieval as R
from heronmill.operators import tables as T
from heronmill.sources import text_files


def value(spark, column, **given):
    row = spark.range(1)
    for name, v in given.items():
        row = row.withColumn(name, F.lit(v))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "asked, plain",
    [("Ｗ38　和　８００ｍｓ", "W38 和 800ms"), ("ＡＢＣ，ＤＥＦ", "ABC,DEF"), ("  a \n b ", "a b")],
)
def test_half_width(spark, asked, plain):
    assert value(spark, X.half_width(F.col("t")), t=asked) == plain


@pytest.mark.parametrize(
    "asked, rest",
    [("什么是三色标记法", "三色标记法"), ("怎么优化检索速度？", "优化检索速度"), ("帮我找下", ""), ("how fast is C#", "how fast is C#")],
)
def test_strip_request(spark, asked, rest):
    assert value(spark, X.strip_request(F.col("t")), t=asked) == rest


def test_query_text_is_never_lost(spark):
    assert value(spark, X.query_text(F.col("t")), t="帮我找下") == "帮我找下"


def test_titles(spark):
    assert value(spark, X.front_title(F.col("t")), t='---\ntitle: "A b"\nx: 1\n---\n# C') == "A b"
    assert value(spark, X.document_title(F.col("t"), F.lit("f")), t="\n\n# C \ntext") == "C"
    assert value(spark, X.document_title(F.col("t"), F.lit("f")), t="text\n# C") == "f"
    assert value(spark, X.first_line(F.col("t")), t=" \n ") == "未命名文档"
    assert value(spark, X.without_front_matter(F.col("t")), t="---\nno end") == "no end"


def test_small_text_functions(spark):
    assert value(spark, X.sentences(F.col("t")), t="A. B!c") == ["A.", " B!", "c"]
    assert value(spark, X.page_numbers(F.array(*map(F.lit, range(1, 13))))) == "1, 2, 3, 4, 5, 6, 7, 8, 9, 10 … 12"
    assert value(spark, X.rewrite_line(F.col("t")), t='12. "find it"') == "find it"
    assert value(spark, X.unfenced(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert value(spark, X.tool_name(F.col("t")), t="é a-b_c") == "___a-b_c"
    assert value(spark, X.unit_price_text(F.array(F.lit(1.5), F.lit(-2.0)))) == "[1.5,-2.0]"
    assert value(spark, X.unit_price_text(F.array(F.lit(float("nan"))))) is None
    assert value(spark, X.importance(F.lit(0))) == 3 and value(spark, X.importance(F.lit(9))) == 5


def test_html(spark):
    page = "<html><head></head><body><button onclick='x()'>Go</button><script>let a</script>&lt;ok&gt;</body></html>"
    assert value(spark, H.document_reason(F.col("t")), t=page) is None
    assert value(spark, H.visible_text(F.col("t")), t=page) == "Go <ok>"
    assert value(spark, H.security_reason(F.col("t")), t="<svg xmlns='http://www.w3.org/2000/svg'>") is None
    assert value(spark, H.security_reason(F.col("t")), t="window . parent") == "访问 window.parent"
    assert value(spark, H.html_document(F.col("t")), t=f"x {page} y") == page
    assert value(spark, H.html_document(F.col("t")), t=page + page) is None


def test_json(spark):
    assert value(spark, J.merged(F.col("a"), F.col("b")), a='{"x":1,"y":[1]}', b='{"x":null,"z":"é\\""}') == '{"x":null,"y":[1],"z":"é\\""}'
    assert value(spark, J.merged(F.col("a"), F.col("b")), a="no", b='{"z":1}') == '{"z":1}'
    assert value(spark, J.without_keys(F.col("a"), "x"), a='{"x":1,"y":2}') == '{"y":2}'
    assert value(spark, J.is_container(F.col("a")), a="[1]") is True
    assert value(spark, J.is_container(F.col("a")), a="3") is False
    assert value(spark, J.is_json_lines(F.col("a")), a='{"a":1}\n\n[2]') is True


@pytest.mark.parametrize(
    "text, path, kind, language",
    [
        ("package main\n\nfunc main() {}\n", "notes.txt", "code", "go"),
        ('{"a": 1}', None, "code", "json"),
        ("# Title\n\ntext", None, "document", None),
        ("plain words", None, "plain_text", None),
        ("plain words", "a.py", "code", "python"),
        ("import os\ndef f(x):\n    return x\n", None, "code", "python"),
        ('{"a": 1}\n[2]\n', None, "code", "jsonl"),
        ('{"a": 1} and words', None, "plain_text", None),
        ('[1]] , [[2]', None, "plain_text", None),
        ('{"a":1}} , {"b":2', None, "plain_text", None),
        ('{"a":1}, 2', None, "plain_text", None),
        (' [1, {"a": null}] \n', None, "code", "json"),
        ("text\n```\nselect a from b where c\n```", None, "document", None),
        ("#include <stdio.h>\nint f(int a) {\n    if (a) {\n        return 1;\n    }\n    return 2;\n}\n", None, "code", None),
        ("if this\n    is so。\n    then that。\n    if not；\n    else；", None, "plain_text", None),
    ],
)
def test_classify(spark, text, path, kind, language):
    found = value(spark, C.classify(F.col("t"), F.lit(path).cast("string")), t=text)
    assert (found.kind, found.language) == (kind, language)


@pytest.mark.parametrize(
    "text, document, fault",
    [
        (None, None, "empty"), (" \n", None, "empty"), ("words", None, "no document"), ("<html><body>", None, "unfinished"), ("</html> <html>", None, "unfinished"),
        ("<!DOCTYPE html><html></html> <!doctype html></html>", None, "several doctypes"), ("<html></html><HTML></html>", None, "several roots"),
        ("```html\n<html>a</html>\n```", "<html>a</html>", None), ("so: <!doctype html>\n<html>É</HTML>\nend", "<!doctype html>\n<html>É</HTML>", None),
        ("```", None, "no document"), ("```<html>x</html>", None, "no document"),
    ],
)
def test_html_answers(spark, text, document, fault):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(H.html_answer(F.col("t")).alias("d")).first().d) == (document, fault)


def test_line_ratios_equal_a_loop(spark):
    rnd = random.Random(7)
    bits = ["if (x) {", "}", "  return a;", "# note", "// n", "text here", "", " ", "* x", "文。", "import b;", "#define y", "\tz", "} else {", "Func(a)"]
    texts = ["\n".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", C.line_ratios(F.col("t")).alias("r"), C.code_score(F.col("t")).alias("score")).collect():
        lines = [x for x in texts[r.i].split("\n") if x.strip()]
        words = [re.split(r"[ \t(]", x.strip())[0].lstrip("#").lower() for x in lines]
        counts = {
            "keyword": sum(w in C.KEYWORDS for w in words), "brace": sum(x.strip().endswith("{") or x.strip().startswith("}") for x in lines),
            "indent": sum(x[0] in " \t" for x in lines), "comment": sum(x.strip().startswith(("//", "#", "/*", "*")) for x in lines),
            "semicolon": sum(x.strip().endswith(";") for x in lines),
        }
        shares = {k: n / len(lines) if lines else 0.0 for k, n in counts.items()}
        assert r.r.asDict() == pytest.approx(shares)
        votes = sum(n for k, (least, n) in C.VOTES.items() if lines and shares[k] >= least)
        assert r.score == votes - 2 * (sum(texts[r.i].count(c) for c in "。！？；") >= 3)


def test_retrieval_rules(spark):
    with pytest.raises(ValueError):
        R.clean_terms([("a", 0)])
    assert R.like_pattern("5%_\\") == "%5\\%\\_\\\\%"
    assert (R.clamp_k(0), R.clamp_k(90), R.recall_limit(1)) == (5, 50, 10)
    assert R.trim_overlap("abc def.", " def. ghi") == " ghi"
    assert R.windowed_text([(0, "a" * 5), (1, "b" * 5), (2, "c" * 5)], 1, 11) == [1, 2]
    vectors = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "doc_id long, similarity double, rank int")
    words = spark.createDataFrame([(1, 1)], "doc_id long, rank int")
    fused = [(r.doc_id, r.method, r.score) for r in R.fuse(vectors, words, ["doc_id"], 5).orderBy("rank").collect()]
    assert fused[0] == (1, "hybrid", round(2 / 61, 9)) and fused[1][1] == "vector"


def test_cosine_of_nothing(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, R.cosine(zero, zero)) is None
    assert math.isclose(value(spark, R.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))), 0.5**0.5)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "b.txt").write_bytes("héé".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "d.txt").write_bytes(b"\xc3\x28")
    rows = {r.path[-5:]: r for r in text_files.read_text_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "one\ntwo" and rows["b.txt"].text == "héé"
    assert rows["c.txt"].error == "blank" and rows["d.txt"].error == "encoding"
    assert value(spark, text_files.parser_for(F.col("p")), p="x/y.PDF") == "document"
    table = F.array(F.array(F.lit("a|b"), F.lit("")), F.array(F.lit("1"), F.lit("2\n3")))
    assert value(spark, text_files.markdown_table(table)) == "| a\\|b | 列2 |\n| --- | --- |\n| 1 | 2<br>3 |"


def test_snapshots(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(45)], "id long, v string")
    assert [r.id for r in T.offset_page(rows, 2, 10, F.asc("id")).collect()] == list(range(10, 20))
    assert T.normalize_page(0, 1000) == (1, 100) and T.normalize_limit(0) == 50
    new = spark.createDataFrame([(1, "x"), (99, "y")], "id long, v string")
    after = {r.id: r.v for r in T.upsert(rows, new, ["id"]).collect()}
    assert len(after) == 46 and after[1] == "x" and after[99] == "y" and after[2] == "v2"
    assert T.insert_absent(rows, new, ["id"]).count() == 46


@pytest.mark.parametrize(
    "asked, texts, weights, more",
    [
        ("P99 800ms knowledge_embeddings 索引", ["P99", "800ms", "knowledge", "embeddings", "索引"], [3, 3, 3, 3, 2], []),
        ("龘靐齉爩", ["龘靐", "靐齉", "齉爩"], [1, 1, 1], ["龘靐齉爩"]),
        ("核", [], [], []),
        ("Go go GOLANG", ["Go", "GOLANG"], [3, 3], []),
    ],
)
def test_search_terms(spark, asked, texts, weights, more):
    from heronmill.functions import tokenize as K

    found = value(spark, K.terms(F.col("t")), t=asked)
    assert [t.text for t in found] == texts and [t.weight for t in found] == weights
    assert [t.text for t in value(spark, K.phrases(F.col("t")), t=asked)] == more
    words = value(spark, K.terms(F.col("t"), ("向量", "检索")), t="向量检索")
    assert [(t.text, t.weight) for t in words] == [("向量", 2), ("检索", 2)]


def test_tool_results_fit():
    import json

    from heronmill.functions.tool_results import MOST_BYTES, compact

    small = '{"a": 1}'
    assert compact(small) == small and compact(None) is None
    items = [{"url": f"u{i % 12}", "html": "x" * 9000, "text": "y" * 3000} for i in range(60)]
    out = compact(json.dumps({"items": items}))
    assert len(out.encode()) <= MOST_BYTES
    got = json.loads(out)["items"]
    assert [i["url"] for i in got] == [f"u{i}" for i in range(8)] and "html" not in got[0]
    assert json.loads(compact("z" * 40_000))["truncated"] is True


def test_small_values(spark):
    from heronmill.functions import values as V

    row = spark.range(1).select(
        V.ratio(F.lit(1), F.lit(0)).alias("ratio"),
        V.variants(F.lit(" Go "), F.array(*map(F.lit, ("go", " a ", "", "A", "b", "c", "d")))).alias("variants"),
        V.search_text([F.lit(" t "), F.lit(None).cast("string"), F.lit("o")]).alias("asked"),
        V.shown(F.lit("ab"), F.lit("abcd")).alias("one"),
        V.shown(F.lit(""), F.lit("x" * 300)).alias("eight"),
        V.shown(F.lit("abc"), F.lit("ab")).alias("back"),
        V.trivial(F.lit(None).cast("string")).alias("trivial"),
        V.safe(F.lit("x\nDial TCP 1.2.3.4")).alias("fault"),
        V.source_type(F.lit("other"), "manual").alias("kind"),
        V.detail(F.lit("not json"), "stage").alias("stage"),
        V.ended(F.lit(None).cast("string")).alias("ended"),
    ).first()
    assert row.ratio == 0 and row.variants == ["a", "b", "c"] and row.asked == "t o"
    assert (row.one, row.eight, row.back) == ("abc", "x" * 8, "ab")
    assert row.trivial is False and row.fault == "模型服务连接失败" and row.kind is None and row.stage == "" and row.ended is False
