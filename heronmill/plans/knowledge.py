"""Terms, tool results, blocks, reviews, code chunks and dialogue."""

from pyspark.sql import functions as F

from heronmill.functions import blocks as B
from heronmill.functions import tokenize as K
from heronmill.functions.tool_results import compact_results
from heronmill.operators import dialogue as D
from heronmill.plans.registry import query, table


@query(
    "h10_search_terms",
    r"""WITH w AS (SELECT page_id, regexp_extract_all(url, '[\p{L}\p{Nd}]+') AS t FROM pages),
    u AS (SELECT page_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM w),
    d AS (SELECT page_id, arg_min(term, i) AS term, min(i) AS i FROM u WHERE length(term) >= 2 GROUP BY page_id, lower(term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM d)
    SELECT page_id, string_agg(term, ' ' ORDER BY i) AS terms FROM r WHERE n <= 8 GROUP BY page_id""",
)
def search_terms(spark, sf_dir):
    terms = F.array_join(F.transform(K.terms(F.col("url")), lambda t: t["text"]), " ")
    return table(spark, sf_dir, "pages").select("page_id", terms.alias("terms"))


@query("i09_compact_tool_results")
def tool_results(spark, sf_dir):
    """Each conversation's messages as one tool result, made to fit."""
    rows = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("turn"), F.concat(F.lit("u"), (F.col("turn") % 7).cast("string")).alias("url"), F.repeat("text", F.lit(40)).alias("body"))
    made = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("result"))
    fit = compact_results("result")
    return made.select("conv_id", F.octet_length(fit).alias("n_bytes"), fit.alias("result"))


@query(
    "i30_quiz_checks",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no quiz' WHEN o_orderkey % 4 = 1 THEN 'options' WHEN o_orderkey % 4 = 2 THEN 'answer' END AS reason,
      CASE WHEN o_orderkey % 3 = 0 THEN 'repeated key' END AS block_reason FROM orders""",
)
def quiz_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "list").otherwise("quiz")
    options = F.when(k % 4 == 1, F.lit('["a"," a "]')).otherwise(F.lit('["a","b"]'))
    answer = F.when(k % 4 == 2, "c").otherwise("b")
    second = F.when(k % 3 == 0, "q").otherwise("r")
    json = F.format_string(
        '[{"key":"q","type":"%s","options":%s,"answer":"%s"},{"key":"%s","type":"text","content":"x"}]', kind, options, answer, second
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", B.quiz_reason(json).alias("reason"), B.block_reason(json).alias("block_reason"))


@query(
    "k28_reviews",
    """SELECT doc_id, doc_id % 7 = 0 OR doc_id % 3 = 0 AS approved, least(100, doc_id % 130)::INT AS score, CASE WHEN doc_id % 2 = 0 THEN 'plan' ELSE 'content' END AS target,
      CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS blockers FROM documents""",
)
def reviews(spark, sf_dir):
    d = F.col("doc_id")
    json = F.format_string(
        '{"approved":%s,"score":%d,"target":"%s","issues":[{"severity":"blocker","message":"%s"}]}',
        (d % 7 == 0).cast("string"), (d % 130).cast("int"), F.when(d % 2 == 0, "plan").otherwise("?"), F.when(d % 3 == 0, " ").otherwise("bad"),
    )
    r = B.review(json)
    return table(spark, sf_dir, "documents").select(
        "doc_id", r["approved"].alias("approved"), r["score"].alias("score"), r["target"].alias("target"), r["blockers"].alias("blockers")
    )


@query(
    "i35_confirmed_prices",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2.5 END AS input, CASE WHEN c_custkey % 2 = 0 THEN 'USD' END AS currency FROM customer""",
)
def prices(spark, sf_dir):
    source = F.when(F.col("c_custkey") % 2 == 0, "user").otherwise("search")
    json = F.format_string('{"m":{"source":"%s","input":2.5}}', source)
    p = B.confirmed_price(json, F.lit("m"))
    return table(spark, sf_dir, "customer").select("c_custkey", p["input"].alias("input"), p["currency"].alias("currency"))


@query(
    "e11_compactions",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, min(turn) AS covered_from, max(turn) AS covered_to, count(*) AS covered, sum(length(text))::BIGINT AS chars
    FROM r WHERE n > 2 GROUP BY conv_id""",
)
def compactions(spark, sf_dir):
    return D.compactions(table(spark, sf_dir, "conversations"), "conv_id", "turn", keep=2)


@query(
    "e20_after_compaction",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, turn, role FROM r WHERE n <= 2""",
)
def history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return D.after_compaction(rows, D.compactions(rows, "conv_id", "turn", keep=2), "conv_id", "turn").drop("text")


@query(
    "k32_next_speaker",
    """SELECT user_id, CASE WHEN NOT bool_or(event_type = 'click') THEN 'click' WHEN NOT bool_or(event_type = 'error') THEN 'error'
      WHEN NOT bool_or(event_type = 'signup') THEN 'signup' ELSE 'click' END AS speaker FROM events GROUP BY user_id""",
)
def speakers(spark, sf_dir):
    spoken = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("spoken"))
    people = F.array(F.lit("click"), F.lit("error"), F.lit("signup"))
    return spoken.select("user_id", D.next_speaker(people, F.col("spoken"), F.lit("nobody")).alias("speaker"))


@query(
    "c24_reconcile_runs",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status FROM orders""",
)
def reconciled(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_custkey").alias("message"))
    messages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("streaming").alias("status"))
    return D.reconcile(runs, messages, "o_orderkey", "message")[0].select("o_orderkey", "status")


@query(
    "c10_failed_messages",
    """SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'failed' ELSE 'streaming' END AS status FROM customer""",
)
def failed_messages(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_custkey").alias("message"))
    messages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("streaming").alias("status"))
    return D.reconcile(runs, messages, "o_orderkey", "message")[1]


@query(
    "e12_page_asked_for",
    """SELECT l_orderkey, l_linenumber, l_linenumber AS page FROM lineitem""",
)
def page_asked(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    numeral = F.substr(F.lit("一二三四五六七八九"), F.col("l_linenumber"), F.lit(1))
    asked = F.when(F.col("l_orderkey") % 20 == 0, F.format_string("第 %d 页讲了什么", "l_linenumber")).otherwise(F.concat(F.lit("第"), numeral, F.lit("页")))
    return rows.select("l_orderkey", "l_linenumber", D.page_asked_for(asked).alias("page"))
