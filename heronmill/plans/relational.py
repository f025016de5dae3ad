"""Filters, joins, counts, pages, sequences and snapshots."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronmill.operators import tables as T
from heronmill.plans.registry import query, table


@query(
    "f06_document_page",
    """SELECT d.doc_id, d.lang, d.n_chars, t.total FROM (SELECT * FROM documents WHERE lang IN ('en', 'de')
      AND (text ILIKE '%ation%' OR source ILIKE '%c1%') ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 20) d,
    (SELECT count(*) AS total FROM documents WHERE lang IN ('en', 'de') AND (text ILIKE '%ation%' OR source ILIKE '%c1%')) t""",
)
def document_page(spark, sf_dir):
    """A filtered page with the count of all its rows."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.where(F.col("lang").isin("en", "de") & (F.col("text").ilike("%ation%") | F.col("source").ilike("%c1%")))
    page = T.offset_page(rows.select("doc_id", "lang", "n_chars"), 2, 20, F.desc("n_chars"), F.desc("doc_id"))
    total = rows.agg(F.count("*").alias("total"))
    return page.withColumn("total", total.scalar())


@query("f11_keyset_messages", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn > 1 ORDER BY turn LIMIT 5")
def keyset(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("conv_id = 3").select("conv_id", "turn", "role")
    return T.keyset_page(rows, "turn", 1, 5)


@query("d01_counts_by_key", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(
    "c14_counts_with_zero",
    """SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def counts_zero(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select("c_custkey")
    return T.counts_with_zero(parents, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "n_orders")


@query(
    "d02_progress_stats",
    """SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS ready FROM lineitem
    WHERE l_returnflag <> 'R' GROUP BY l_orderkey""",
)
def progress(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return rows.groupBy("l_orderkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("ready")
    )


@query(
    "d03_counts_without_null",
    """SELECT p_brand, count(*) AS n FROM (SELECT nullif(p_brand, 'Brand#11') AS p_brand FROM part) WHERE p_brand IS NOT NULL GROUP BY p_brand""",
)
def counts_not_null(spark, sf_dir):
    brand = F.nullif("p_brand", F.lit("Brand#11"))
    return table(spark, sf_dir, "part").select(brand.alias("p_brand")).where("p_brand IS NOT NULL").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("d04_active_count", "SELECT count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).agg(F.count("*").alias("active"))


@query(
    "e04_first_per_group",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
    FROM conversations WHERE role <> 'system') WHERE n = 1""",
)
def first_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role")
    return T.first_per_group(rows, ["conv_id"], F.asc("turn"))


@query("e05_latest_per_group", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("d05_next_sequence", "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_no FROM events GROUP BY user_id")
def next_sequence(spark, sf_dir):
    return T.next_numbers(table(spark, sf_dir, "events"), "user_id", "event_id")


@query(
    "k05_append_numbered",
    """WITH log AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 2),
    m AS (SELECT conv_id, max(turn) AS last FROM log GROUP BY conv_id)
    SELECT n.conv_id, n.role, coalesce(m.last, 0) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS turn
    FROM conversations n LEFT JOIN m USING (conv_id) WHERE n.turn % 3 = 2""",
)
def append(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    log = rows.where("turn % 3 <> 2")
    return T.append_numbered(log, rows.where("turn % 3 = 2").select("conv_id", "role", "turn"), "conv_id", "turn", F.asc("turn"))


@query(
    "c04_model_census",
    """SELECT n_name, count(s_suppkey) AS vectors FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name""",
)
def census(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return T.counts_with_zero(nations, table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", "vectors").drop("n_nationkey")


@query(
    "d11_stale_default_model",
    """WITH c AS (SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL)
    SELECT min(n) FILTER (n_nationkey = 0) = 0 AND max(n) FILTER (n_nationkey <> 0) > 0 AS stale,
      sum(n) FILTER (n_nationkey <> 0)::BIGINT AS others FROM c""",
)
def stale_default(spark, sf_dir):
    c = T.counts_with_zero(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", "n")
    own, other = F.col("n_nationkey") == 0, F.col("n_nationkey") != 0
    return c.agg(
        ((F.min(F.when(own, F.col("n"))) == 0) & (F.max(F.when(other, F.col("n"))) > 0)).alias("stale"),
        F.sum(F.when(other, F.col("n"))).alias("others"),
    )


_MISSING = """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))"""


def _missing(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    parents = table(spark, sf_dir, "customer").select("c_custkey")
    return T.missing_children(parents, table(spark, sf_dir, "orders"), made, "c_custkey", "o_orderkey", "o_custkey", "l_orderkey")


@query("c07_missing_vectors", _MISSING)
def missing(spark, sf_dir):
    return _missing(spark, sf_dir)


@query("c06_missing_vector_count", f"SELECT count(*) AS n FROM ({_MISSING})")
def missing_count(spark, sf_dir):
    return _missing(spark, sf_dir).agg(F.count("*").alias("n"))


@query(
    "c08_unused_parents",
    "SELECT p_partkey, p_name FROM part WHERE p_size > 5 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
)
def unused(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 5")
    return parts.join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query(
    "c03_left_join_json",
    """SELECT e.event_id, c.c_name, json_extract_string(e.props, '$.k')::INT AS k FROM events e
    LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error'""",
)
def left_join_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return events.join(customers, F.col("user_id") == F.col("c_custkey"), "left").select(
        "event_id", "c_name", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


@query(
    "c09_guarded_update",
    """SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')
    THEN 'held' ELSE l_linestatus END AS l_linestatus FROM lineitem""",
)
def guarded(spark, sf_dir):
    """An update that holds where a parent row exists: the parent's flag joins once per key."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey").distinct()
    joined = lines.join(open_, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return T.update_where(joined, F.col("o_orderkey").isNotNull(), l_linestatus=F.lit("held")).drop("o_orderkey")


@query(
    "c12_pending_pages",
    """SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderstatus = 'P' AND l_linestatus <> 'F' AND l_returnflag NOT IN ('A', 'R')""",
)
def pending_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F' AND l_returnflag NOT IN ('A', 'R')")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query(
    "c13_completed_pages",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
)
def completed_pages(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query(
    "c21_neighbour_pages",
    """SELECT l_orderkey, l_linenumber, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""",
)
def page_neighbours(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", F.lag("l_partkey").over(w).alias("before"), F.lead("l_partkey").over(w).alias("after")
    )


@query(
    "g04_exact_dedup",
    "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)",
)
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "b10_scope_filter",
    """SELECT event_id, value FROM events WHERE event_type <> 'view' AND ((user_id % 10 = 3 AND value > 20) OR (user_id % 10 = 4 AND value > 80))
    AND (ts IS NULL OR ts > TIMESTAMP '2024-01-10') ORDER BY value DESC, event_id DESC LIMIT 30""",
)
def scope_filter(spark, sf_dir):
    u, v = F.col("user_id") % 10, F.col("value")
    scope = ((u == 3) & (v > 20)) | ((u == 4) & (v > 80))
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'").where(scope)
    rows = rows.where("ts IS NULL OR ts > TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id", "value")
    return rows.orderBy(F.desc("value"), F.desc("event_id")).limit(30)


@query(
    "f09_nulls_last_sort",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ORDER BY l.quality DESC NULLS LAST, d.doc_id DESC""",
)
def nulls_last(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc"), "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.join(labels, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "quality")
    return rows.orderBy(F.desc_nulls_last("quality"), F.desc("doc_id"))


@query(
    "a24_upsert_merge",
    """SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL AND NOT coalesce(o.price = n.price AND o.status = 'F', false)
      THEN n.price ELSE o.price END AS price,
      CASE WHEN n.k IS NOT NULL AND NOT coalesce(o.price = n.price AND o.status = 'F', false) THEN n.status ELSE o.status END AS status
    FROM (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0) o
    FULL JOIN (SELECT o_orderkey AS k, o_totalprice AS price, 'N' AS status FROM orders WHERE o_orderkey % 2 = 0) n ON o.k = n.k""",
)
def upsert_merge(spark, sf_dir):
    """An old row stays where its price is unchanged and it is final; others are replaced."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey k", "o_totalprice price", "o_orderstatus status")
    new = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey k", "o_totalprice price", "'N' status")
    keep = (F.col("old.price") == F.col("new.price")) & (F.col("old.status") == "F")
    return T.upsert(old, new, ["k"], keep)


@query(
    "a25_seed_if_absent",
    """SELECT r_regionkey, r_name FROM region UNION ALL
    SELECT * FROM (VALUES (0::INT, 'PRESET'), (77::INT, 'PRESET')) v(k, n) WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = k)""",
)
def seed(spark, sf_dir):
    existing = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    new = spark.createDataFrame([(0, "PRESET"), (77, "PRESET")], "r_regionkey int, r_name string")
    return T.insert_absent(existing, new, ["r_regionkey"])


@query("k10_retention_delete", "SELECT event_id FROM events WHERE NOT (ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-25')")
def retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return T.delete_where(rows, F.expr("ts + INTERVAL 7 DAYS < TIMESTAMP_NTZ '2024-01-25 00:00:00'")).select("event_id")


@query(
    "k15_stale_reset",
    """SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 3 MINUTE THEN 'pending' ELSE event_type END AS event_type FROM events""",
)
def stale_reset(spark, sf_dir):
    stale = F.expr("event_type = 'click' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' - INTERVAL 3 MINUTES")
    return T.update_where(table(spark, sf_dir, "events"), stale, event_type=F.lit("pending")).select("event_id", "event_type")


@query(
    "k17_acquire_lease",
    """SELECT o_orderkey, CASE WHEN o IS NULL OR u < TIMESTAMP '1996-01-01' OR o = 'me' THEN 'me' ELSE o END AS lease_owner,
      CASE WHEN o IS NULL OR u < TIMESTAMP '1996-01-01' OR o = 'me' THEN TIMESTAMP '1996-01-01 00:10:00' ELSE u END AS lease_until
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'other' WHEN 'P' THEN 'me' END AS o, o_orderdate::TIMESTAMP AS u FROM orders)""",
)
def lease(spark, sf_dir):
    owner = F.when(F.col("o_orderstatus") == "F", "other").when(F.col("o_orderstatus") == "P", "me")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", owner.alias("lease_owner"), F.col("o_orderdate").cast("timestamp_ntz").alias("lease_until")
    )
    return T.acquire_leases(rows, "me", F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"), 600)


@query(
    "a40_cascade_delete",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return T.delete_children(rows, gone, "l_orderkey", "o_orderkey")


@query(
    "f18_exclusive_toggle",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_nationkey = 12 ELSE n_nationkey % 2 = 0 END AS on_ FROM nation",
)
def toggle(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("on_", F.col("n_nationkey") % 2 == 0)
    return T.exclusive_toggle(rows, "n_regionkey", "n_nationkey", "on_", 2, 12).select("n_nationkey", "on_")


@query(
    "s13_constraint_violations",
    """SELECT count(*) FILTER (NOT coalesce(length(text) > 20, false)) AS short_text,
      count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr'), false)) AS other_lang FROM documents""",
)
def violated(spark, sf_dir):
    rules = {"short_text": F.char_length("text") > 20, "other_lang": F.col("lang").isin("en", "de", "fr")}
    return T.violations(table(spark, sf_dir, "documents"), rules)


@query(
    "d09_token_cost",
    """SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS input_tokens,
      sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::BIGINT AS output_tokens,
      CASE WHEN conv_id % 3 = 0 THEN round(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / 1e6::DOUBLE * 2
        + sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) / 1e6::DOUBLE * 8, 9) END AS cost
    FROM conversations GROUP BY conv_id""",
)
def token_cost(spark, sf_dir):
    """Token sums for each run, and a cost only where a user confirmed the prices."""
    size = F.char_length("text").cast("long")
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", size).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("role") != "user", size).otherwise(0)).alias("output_tokens"),
    )
    cost = F.col("input_tokens") / F.lit(1e6) * 2 + F.col("output_tokens") / F.lit(1e6) * 8
    return used.withColumn("cost", F.when(F.col("conv_id") % 3 == 0, F.round(cost, 9)))


@query(
    "d10_token_source",
    """SELECT user_id, CASE WHEN count(DISTINCT s) > 1 THEN 'mixed' WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'fallback' END AS token_source
    FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'actual' WHEN 'view' THEN 'estimated' END AS s FROM events) GROUP BY user_id""",
)
def token_source(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "actual").when(F.col("event_type") == "view", "estimated")
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(kind)).alias("s"))
    source = F.when(F.size("s") > 1, "mixed").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("fallback")
    return seen.select("user_id", source.alias("token_source"))


@query(
    "b20_span_durations",
    """SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k
    FROM events GROUP BY user_id""",
)
def durations(spark, sf_dir):
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    ms = F.floor(micros / 1000)
    k = F.sum(F.get_json_object("props", "$.k").cast("long"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ms.alias("duration_ms"), k.alias("k"))


@query(
    "k07_event_fold",
    """SELECT user_id, max(event_id) AS last_seq, arg_max(event_type, event_id) AS state, sum(value) FILTER (event_type = 'purchase') AS spent,
      bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id""",
)
def event_fold(spark, sf_dir):
    """The state that a fold over each key's event log ends with, as partial aggregates."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max("event_id").alias("last_seq"),
        F.max_by("event_type", "event_id").alias("state"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent"),
        F.bool_or(F.col("event_type") == "error").alias("failed"),
    )


@query(
    "k33_rate_limit",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""",
)
def rate_limit(spark, sf_dir):
    """The first two requests of a key on each day pass."""
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) <= 2).alias("allowed"))


@query(
    "n01_rollup",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "n02_set_operators",
    """SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
    EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
)
def set_operators(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keys = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return keys("O").intersect(keys("F")).subtract(poor)


@query(
    "n03_as_of",
    """SELECT p.event_id, p.user_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click'
    AND c.event_id <= p.event_id) AS click_id FROM events p WHERE p.event_type = 'purchase'""",
)
def as_of(spark, sf_dir):
    """The last click at or before each purchase: one sort of the union, no range join."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return rows.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query(
    "n04_tumbling_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")
