"""Queries of guarded state changes, plain lists and small values, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronmill.functions import text as X
from heronmill.functions import values as V
from heronmill.operators import states as S
from heronmill.operators import tables as T
from heronmill.plans.registry import query, table

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'failed' END"
STAGED = "CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'P' THEN 'ready' ELSE 'failed' END"


def orders(spark, sf_dir, *columns):
    return table(spark, sf_dir, "orders").select(*(F.expr(c) for c in columns))


@query("b12_generating_ids", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT')")
def generating(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("error", F.when(F.col("o_orderpriority") == "1-URGENT", "late"))
    return rows.where("o_orderstatus = 'O' OR (o_orderstatus = 'P' AND error IS NULL)").select("o_orderkey")


@query("b13_unfinished_runs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderkey")
def unfinished(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return rows.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query("b14_available_by_owner", "SELECT user_id, event_id FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND value > 10")
def available(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'error' AND value > 10").select("user_id", "event_id")


@query("b15_expired_materials", "SELECT event_id FROM events WHERE event_type = 'view' AND ts IS NOT NULL AND ts < TIMESTAMP '2024-01-15'")
def expired(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id")


@query(
    "b16_find_by_digest",
    """SELECT d.source, min(d.doc_id) AS doc_id FROM documents d JOIN (SELECT source, sha256(text) AS digest FROM documents
    WHERE doc_id = (SELECT max(doc_id) FROM documents)) q ON d.source = q.source AND sha256(d.text) = q.digest GROUP BY d.source""",
)
def by_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    asked = docs.orderBy(F.desc("doc_id")).limit(1).select(F.col("source").alias("_source"), F.col("digest").alias("_digest"))
    found = docs.join(F.broadcast(asked), (F.col("source") == F.col("_source")) & (F.col("digest") == F.col("_digest")))
    return found.groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("b22_ended", f"SELECT o_orderkey, {STAGED} IN ('ready', 'failed') AS ended FROM orders")
def ended(spark, sf_dir):
    return orders(spark, sf_dir, "o_orderkey", f"{STAGED} AS status").select("o_orderkey", V.ended(F.col("status")).alias("ended"))


@query("b24_set_enabled", "SELECT s_suppkey, s_acctbal >= 0 AND NOT (s_nationkey = 3) AS enabled FROM supplier")
def enabled(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") >= 0).alias("enabled"))
    return T.update_where(rows, F.col("s_nationkey") == 3, enabled=F.lit(False)).drop("s_nationkey")


@query(
    "b30_expire_materials",
    """SELECT event_id, CASE WHEN user_id = 7 AND event_type = 'view' THEN TIMESTAMP '2024-06-01' ELSE ts END AS ts FROM events""",
)
def expire(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    own = (F.col("user_id") == 7) & (F.col("event_type") == "view")
    return T.update_where(rows, own, ts=F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")).select("event_id", "ts")


@query(
    "c11_assigned_folders",
    """SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN c_nationkey END AS folder FROM customer""",
)
def assigned(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"), F.lit(None).cast("int").alias("folder"))
    folders = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder"), F.col("s_nationkey").alias("owner"))
    return S.assigned(rows, folders, "folder", F.lit(True), F.col("owner")).drop("owner")


@query(
    "c22_detached_folders",
    """SELECT c_custkey, CASE WHEN c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN c_nationkey END AS folder FROM customer""",
)
def detached(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"), F.col("c_nationkey").alias("folder"))
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"), F.col("n_nationkey").alias("owner"), "n_regionkey")
    return S.detached(rows, folders, "folder", F.col("n_regionkey") == 1).drop("owner")


@query("d15_history_tokens", "SELECT conv_id, sum(length(role) + length(text)) AS tokens FROM conversations GROUP BY conv_id")
def history(spark, sf_dir):
    own = F.char_length("role") + F.char_length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(own).cast("long").alias("tokens"))


@query(
    "d16_batch_summary",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P') AS accepted, count(*) FILTER (o_orderstatus <> 'P') AS rejected
    FROM orders GROUP BY o_orderpriority""",
)
def batches(spark, sf_dir):
    rows = orders(spark, sf_dir, "o_orderpriority", "CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'failed' END AS status")
    return S.batch_summary(rows, "status", "o_orderpriority")


@query("d23_reported_tokens", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'none' ELSE 'reported' END AS source FROM lineitem")
def reported(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.token_source(F.col("l_discount"), F.col("l_tax")).alias("source"))


@query("d25_usage", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 17 ELSE length(text) END::INTEGER AS tokens FROM conversations")
def usage(spark, sf_dir):
    known = F.when(F.col("turn") % 2 == 0, F.lit(17))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.tokens(known, F.col("text")).alias("tokens"))


@query(
    "d28_ratio",
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(replace(text, ';', '')))::DOUBLE / length(text) END AS share FROM documents""",
)
def shares(spark, sf_dir):
    marks = F.char_length("text") - F.char_length(F.replace("text", F.lit(";"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", V.ratio(marks, F.char_length("text")).alias("share"))


@query("b39_failure_stage", "SELECT event_id, coalesce(props->>'$.k', '') AS stage, '' AS error FROM events")
def failures(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", V.detail(props, "k").alias("stage"), V.detail(props, "error").alias("error"))


@query(
    "g03_variants",
    """WITH w AS (SELECT doc_id, lower(trim(split_part(text, ' ', 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS q, string_split(text, ' ') AS a FROM documents),
    x AS (SELECT doc_id, q, i, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM (SELECT doc_id, q, unnest(a) AS x, unnest(range(len(a))) AS i FROM w)),
    f AS (SELECT doc_id, min(i) AS i, arg_min(x, i) AS x FROM x WHERE x <> '' AND lower(x) <> q GROUP BY doc_id, lower(x)),
    r AS (SELECT doc_id, x, i FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3)
    SELECT d.doc_id, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), []) AS variants FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
)
def variants(spark, sf_dir):
    """The words of a text stand for rewritten questions, its first word for the question."""
    return table(spark, sf_dir, "documents").select("doc_id", V.variants(F.split_part("text", F.lit(" "), F.lit(1)), F.split("text", " ")).alias("variants"))


@query(
    "h47_safe_text",
    """SELECT doc_id, CASE WHEN length(t) > 600 THEN left(t, 600) || '…' ELSE t END AS line FROM (SELECT doc_id,
      trim(translate(text, chr(13) || chr(10), '  '), chr(32) || chr(9) || chr(11) || chr(12)) AS t FROM documents)""",
)
def safe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.safe(F.col("text")).alias("line"))


@query("h54_importance", "SELECT p_partkey, CASE WHEN p_size - 3 < 1 THEN 3 ELSE least(p_size - 3, 5) END AS importance FROM part")
def importance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.importance(F.col("p_size") - 3).alias("importance"))


@query("h57_trivial_topics", "SELECT conv_id, turn, turn % 3 = 0 AS trivial FROM conversations")
def trivial(spark, sf_dir):
    topic = F.when(F.col("turn") % 3 == 0, "  谢谢\n").otherwise(F.concat("text", F.lit("谢谢")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.trivial(topic).alias("trivial"))


@query(
    "h59_typewriter",
    """SELECT doc_id, CASE WHEN n <= 40 THEN text ELSE left(text, (40 + least(n - 40, CASE WHEN n - 40 > 260 THEN 8 WHEN n - 40 > 120 THEN 4
      WHEN n - 40 > 60 THEN 2 ELSE 1 END))::INTEGER) END AS shown FROM (SELECT doc_id, text, length(text) AS n FROM documents)""",
)
def typewriter(spark, sf_dir):
    """Forty characters have been shown."""
    return table(spark, sf_dir, "documents").select("doc_id", V.shown(F.lit("x" * 40), F.col("text")).alias("shown"))


@query("h75_search_text", "SELECT p_partkey, left(concat_ws(' ', p_name, nullif(CASE WHEN p_size > 10 THEN p_type ELSE '' END, ''), p_brand), 300) AS asked FROM part")
def search_text(spark, sf_dir):
    middle = F.when(F.col("p_size") > 10, F.concat(F.lit("  "), "p_type")).otherwise(F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", V.search_text([F.col("p_name"), middle, F.col("p_brand")]).alias("asked"))


@query(
    "h79_needs_prices",
    """SELECT p_partkey, (p_size % 4 = 0) OR (p_size % 4 = 1) OR (p_size % 4 = 2 AND p_retailprice > 1200) AS needed FROM part""",
)
def prices(spark, sf_dir):
    kind = F.col("p_size") % 4
    source = F.when(kind == 1, "catalog").when(kind == 2, "search").when(kind == 3, "user")
    price = F.when(F.col("p_retailprice") <= 1200, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", V.needs_prices(source, F.lit(1.0), price).alias("needed"))


@query("h80_source_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'manual' WHEN 'click' THEN 'import' WHEN 'error' THEN 'manual' END AS source FROM events")
def source_types(spark, sf_dir):
    given = F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "click", " import ").when(F.col("event_type") == "error", "manual").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", V.source_type(given, "manual").alias("source"))


@query(
    "h66_review_text",
    """SELECT doc_id, CASE WHEN length(text) <= 2400 THEN text ELSE left(text, 2400) || chr(10) || '（可见文本过长，这里只给前 2400 个字符）' END AS review FROM documents""",
)
def review(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.review_text(F.split("text", "\n"), 2400).alias("review"))


@query(
    "k06_appended",
    """SELECT conv_id AS id, 'user' || string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id""",
)
def appended(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    messages = rows.select(F.col("conv_id").alias("id"), F.lit("user").alias("content")).distinct()
    return S.appended(messages, rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("delta")))


@query(
    "k39_marked_failed",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 1 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'done' END AS status,
    CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 1 THEN 'embed' ELSE 'parse' END AS stage,
    CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 1 THEN 'timeout' END AS error FROM orders""",
)
def marked_failed(spark, sf_dir):
    """Attempts 1 failed in embedding; those of other numbers lost the lease, and every other one was cancelled."""
    docs = orders(spark, sf_dir, "o_orderkey AS id", "CASE o_orderstatus WHEN 'O' THEN 'processing' ELSE 'done' END AS status",
                  "o_custkey % 3 AS attempt", "'parse' AS stage", "CAST(NULL AS STRING) AS error")
    attempts = orders(spark, sf_dir, "o_orderkey AS id", "CAST(1 AS BIGINT) AS attempt", "'embed' AS stage")
    return S.failed(docs, attempts, F.lit("timeout")).drop("attempt")


@query(
    "k38_retried",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'pending' ELSE {STAGED} END AS status,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'chunk' ELSE 'parse' END AS stage,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN NULL ELSE 'bad' END AS error FROM orders""",
)
def retried(spark, sf_dir):
    docs = orders(spark, sf_dir, "o_orderkey AS id", f"{STAGED} AS status", "'parse' AS stage", "'bad' AS error", "o_custkey")
    return S.requeued(docs, F.col("o_custkey") % 2 == 0, F.lit("chunk")).drop("o_custkey")


@query(
    "k22_failure_records",
    """SELECT o_orderkey AS id, CASE WHEN hit THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'done' END AS status,
    CASE WHEN hit THEN '{"stage":"' || CASE WHEN o_custkey % 5 = 0 THEN 'embed' ELSE 'parse' END || '","error":"' || CASE WHEN o_custkey % 2 = 0 THEN 'the parser failed' ELSE 'the service failed' END
      || '","error_detail":"exit ' || o_custkey || '","failed_at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"'
      || CASE WHEN o_custkey % 2 = 0 THEN ',"error_code":"E' || (o_custkey % 7) || '"' ELSE '' END || '}' ELSE '{}' END AS metadata
    FROM (SELECT *, o_orderstatus = 'O' AND o_custkey % 3 = 2 AND o_custkey % 4 <> 3 AS hit FROM orders)""",
)
def failure_records(spark, sf_dir):
    """Documents whose second attempt failed, told by attempts one and two; some were cancelled."""
    docs = orders(spark, sf_dir, "o_orderkey AS id", "CASE o_orderstatus WHEN 'O' THEN 'processing' ELSE 'done' END AS status",
                  "o_custkey % 3 AS attempt", "'{}' AS metadata")
    attempts = orders(
        spark, sf_dir, "o_orderkey AS id", "explode(array(1, 2)) AS attempt", "o_custkey", "o_orderdate AS failed_at",
        "concat('exit ', o_custkey) AS detail", "CASE WHEN o_custkey % 2 = 0 THEN concat('E', o_custkey % 7) ELSE '' END AS code",
    ).withColumn(
        "stage", F.when((F.col("attempt") == 2) & (F.col("o_custkey") % 4 == 3), None).when(F.col("o_custkey") % 5 == 0, "embed").otherwise("parse")
    )
    reason = F.when(F.col("_code") != "", "the parser failed").otherwise("the service failed")
    return S.failed_with_record(docs, attempts, reason).drop("attempt")


@query(
    "k38_retried_within",
    f"""WITH d AS (SELECT o_orderkey AS id, {STAGED} AS status, o_orderdate, o_custkey FROM orders),
    f AS (SELECT greatest(0, 500 - count(*)) AS free FROM d WHERE status <> 'failed' AND o_custkey % 40 = 0),
    p AS (SELECT id FROM d, f WHERE status = 'failed' AND o_custkey % 2 = 0 QUALIFY row_number() OVER (ORDER BY o_orderdate, id) <= free)
    SELECT id, CASE WHEN id IN (FROM p) THEN 'pending' ELSE status END AS status, CASE WHEN id IN (FROM p) THEN 'chunk' ELSE 'parse' END AS stage,
      CASE WHEN id NOT IN (FROM p) THEN 'bad' END AS error FROM d""",
)
def retried_within(spark, sf_dir):
    docs = orders(spark, sf_dir, "o_orderkey AS id", f"{STAGED} AS status", "'parse' AS stage", "'bad' AS error", "o_custkey", "o_orderdate")
    active = (F.col("status") != "failed") & (F.col("o_custkey") % 40 == 0)
    out = S.retried_within(docs, F.col("o_custkey") % 2 == 0, active, F.lit("chunk"), 500, "id", F.col("o_orderdate"), F.col("id"))
    return out.select("id", "status", "stage", "error")


@query(
    "k41_failed_runs",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P') THEN 'failed' ELSE {STATUS} END AS status,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P') THEN 'stopped' END AS error FROM orders""",
)
def failed_runs(spark, sf_dir):
    runs = orders(spark, sf_dir, "o_orderkey", "o_orderpriority", f"{STATUS} AS status", "CAST(NULL AS STRING) AS error")
    return S.fail_unfinished(runs, F.col("o_orderpriority") == "1-URGENT", "stopped").drop("o_orderpriority")


@query(
    "k44_reset_pages",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE {STAGED} END AS status, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'write' END AS phase,
    CASE WHEN o_orderstatus <> 'F' THEN 'bad' END AS error, CASE WHEN o_orderstatus <> 'F' THEN 'me' END AS lease_owner, o_custkey AS checkpoint FROM orders""",
)
def reset(spark, sf_dir):
    pages = orders(spark, sf_dir, "o_orderkey", f"{STAGED} AS status", "'write' AS phase", "'bad' AS error", "'me' AS lease_owner", "o_custkey AS checkpoint")
    return S.reset_pages(pages, F.lit(True))


@query("k11_expired_spans", "SELECT event_id FROM events WHERE NOT coalesce(ts < TIMESTAMP '2024-01-10', false)")
def expired_spans(spark, sf_dir):
    return T.delete_where(table(spark, sf_dir, "events"), F.expr("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("event_id")


@query("a41_deleted_by_owner", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey = 7)")
def deleted(spark, sf_dir):
    return T.delete_where(table(spark, sf_dir, "orders"), F.col("o_custkey") == 7).select("o_orderkey")
