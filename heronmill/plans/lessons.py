"""Material, narration, queues and generations."""

from pyspark.sql import functions as F

from heronmill.functions import text as X
from heronmill.operators import directors as D
from heronmill.operators import filters as L
from heronmill.operators import material as M
from heronmill.plans.registry import query, table


@query(
    "e14_material_snapshot",
    """WITH d AS (SELECT source, doc_id, length(text) AS chars FROM documents WHERE lang <> 'fr' AND length(trim(text)) > 0),
    w AS (SELECT *, least(800, floor(4000 / count(*) OVER (PARTITION BY source)))::BIGINT AS outline_chars,
      sum(CASE WHEN chars <= 6000 THEN chars ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM d)
    SELECT source, doc_id, chars, outline_chars, CASE WHEN chars <= 6000 AND running <= 8000 THEN 'full' ELSE 'retrieval' END AS use FROM w""",
)
def material(spark, sf_dir):
    status = F.when(F.col("lang") == "fr", "failed").otherwise("ready")
    docs = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.col("text").alias("content"), status.alias("status"), F.lit(True).alias("enabled")
    )
    return M.snapshot(docs, "source", "doc_id")


@query(
    "c19_narration_problems",
    """WITH b AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL),
    t AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT coalesce(b.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, t.l_linenumber) AS l_linenumber,
      CASE WHEN t.n IS NULL THEN 'missing' WHEN b.l_orderkey IS NULL THEN 'unknown' WHEN t.n > 1 THEN 'repeated' END AS problem
    FROM b FULL JOIN t ON b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber WHERE problem IS NOT NULL""",
)
def narration(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    moved = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    return M.narration_problems(lines, lines.withColumn("l_linenumber", moved), "l_orderkey", "l_linenumber")


@query(
    "c15_update_from",
    """SELECT c_custkey, coalesce(n_name, c_mktsegment) AS kind FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""",
)
def update_from(spark, sf_dir):
    children = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("kind"))
    parents = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("kind"))
    return M.propagated(children, parents, "c_nationkey", "n_nationkey", "kind").drop("c_nationkey")


@query(
    "k36_queue_slots",
    """WITH a AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 200 = 0),
    w AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O')
    SELECT o_orderkey FROM w, a WHERE r + n <= 100""",
)
def queue_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    active = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 200 == 0)
    picked = M.queued(rows, F.col("o_orderstatus") == "O", active, 100, F.asc("o_orderdate"), F.asc("o_orderkey"))
    return picked.select("o_orderkey")


@query("f10_pending_first", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def pending(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@query("h44_packed_sentences")
def packed(spark, sf_dir):
    pieces = M.packed_sentences(X.sentences("text"), 300)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(pieces).alias("piece", "text"))
    return rows.where("char_length(text) > 0")


@query(
    "k09_generation_parts",
    """SELECT conv_id, turn, nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS content, role AS action, CASE WHEN turn % 2 = 0 THEN 'a' || turn END AS speaker FROM conversations""",
)
def generations(spark, sf_dir):
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<next_speaker>a"), F.col("turn").cast("string"), F.lit("</next_speaker>"))).otherwise("")
    text = F.concat(F.lit("<content>"), "text", F.lit("</content>\n<next_action>"), "role", F.lit("</next_action>"), tail)
    parts = M.generation_parts(text)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", parts["content"].alias("content"), parts["action"].alias("action"), parts["speaker"].alias("speaker")
    )


@query(
    "k35_generating_state",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'generating' ELSE 'queued' END AS state
    FROM orders""",
)
def generating(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "generating").otherwise(F.col("o_orderstatus"))
    task = F.when(F.col("o_orderkey") % 3 == 0, "archived").when(F.col("o_orderkey") % 3 == 1, "live")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.generating_state(status, F.coalesce(task, F.lit(""))).alias("state"))


@query(
    "b02_chunk_filter",
    """SELECT doc_id AS document_id FROM documents WHERE doc_id % 5 <> 0 AND lang = 'en' AND doc_id % 3 <> 1 AND source = 'src1'""",
)
def chunk_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % 5 != 0).alias("enabled"),
        F.when(F.col("lang") == "en", "ready").otherwise("failed").alias("status"),
        F.when(F.col("doc_id") % 3 == 1, "material").otherwise("knowledge").alias("kind"),
        F.when(F.col("source") == "src1", 1).otherwise(2).alias("owner_id"),
    )
    return docs.where(L.ChunkFilter(owner_id=1).predicate()).select("document_id")


@query(
    "d26_embedding_status",
    """SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS stale, count(*) FILTER (lang = 'de') AS in_flight FROM documents d""",
)
def embedding_status(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(have, F.col("doc_id") == F.col("_doc"), "left")
    return rows.agg(F.count_if(F.col("_doc").isNull()).alias("stale"), F.count_if(F.col("lang") == "de").alias("in_flight"))


@query(
    "c20_first_match_or_fallback",
    """SELECT l_orderkey, l_linenumber, coalesce(p_name, 'page ' || l_linenumber) AS title FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 10""",
)
def titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem")
    title = F.coalesce("p_name", F.concat(F.lit("page "), F.col("l_linenumber").cast("string")))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", title.alias("title"))


def _plans(spark, sf_dir):
    """Conversations with raw plans of all kinds, some of which have a fault."""
    key = F.col("conv_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    people = F.array(*map(F.lit, ("a0", "a1", "a2", "a3")))
    speakers = F.when(key % 11 == 3, F.array(F.lit("zz"))).otherwise(
        F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda i: F.concat(F.lit("a"), ((key + i) % 4).cast("string")))
    )
    raw = F.struct(
        pick(7, "reply", "discussion", "round", "redirect", "clarify", "discussion", "other"), pick(5, "brief", "?", "normal", "detailed", "long"),
        pick(4, "simple", "multi_view", "unclear", "none"), F.when(key % 13 == 5, "refuse").otherwise("allow"), speakers,
    ).cast(D.PLAN)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = D.response_plan(raw, people, F.array(F.lit("a2")), key % 2 == 0, F.col("n") < 3)
    return rows.select("conv_id", plan.alias("plan"), people.alias("participants"))


_RESPONSE_PLANS = """r AS (SELECT conv_id, count(*) AS n, ['reply', 'discussion', 'round', 'redirect', 'clarify', 'discussion', 'other'][conv_id % 7 + 1] AS mode,
    ['brief', '?', 'normal', 'detailed', 'long'][conv_id % 5 + 1] AS length, ['simple', 'multi_view', 'unclear', 'none'][conv_id % 4 + 1] AS kind,
    conv_id % 13 = 5 AS refused, CASE WHEN conv_id % 11 = 3 THEN ['zz'] ELSE list_transform(range(conv_id % 3 + 1), lambda i: 'a' || ((conv_id + i) % 4)) END AS speakers
  FROM conversations GROUP BY conv_id),
v AS (SELECT *, mode = 'other' OR (mode <> 'round' AND conv_id % 11 = 3) AS faulty, CASE WHEN refused THEN 'reply' ELSE mode END AS own,
    CASE WHEN mode = 'round' THEN ['a0', 'a1', 'a2', 'a3'] ELSE speakers END AS everyone FROM r),
w AS (SELECT *, CASE WHEN own IN ('reply', 'clarify') THEN everyone[1:1] WHEN own = 'discussion' THEN everyone[1:3] ELSE everyone END AS chosen,
    conv_id % 2 = 0 AND NOT refused AND own NOT IN ('redirect', 'round', 'clarify') AS many FROM v),
x AS (SELECT *, many AND kind = 'simple' AS one, many AND own = 'reply' AND kind = 'multi_view' AND n >= 3 AS two FROM w),
p AS (SELECT conv_id, CASE WHEN faulty OR one THEN 'reply' WHEN two THEN 'discussion' ELSE own END AS mode,
    CASE WHEN faulty THEN 'normal' WHEN refused THEN 'brief' WHEN length IN ('brief', 'normal', 'detailed') THEN length ELSE 'normal' END AS length,
    CASE WHEN faulty OR kind = 'none' THEN 'unknown' ELSE kind END AS question_type, CASE WHEN refused AND NOT faulty THEN 'refuse' ELSE 'allow' END AS safety,
    CASE WHEN faulty THEN ['a2'] WHEN one THEN chosen[1:1] WHEN two THEN [chosen[1], CASE WHEN chosen[1] = 'a0' THEN 'a1' ELSE 'a0' END] ELSE chosen END AS speakers FROM x)"""


@query("g06_response_plans", f"WITH {_RESPONSE_PLANS} SELECT conv_id, mode, length, question_type, safety, array_to_string(speakers, ',') AS speakers FROM p")
def response_plans(spark, sf_dir):
    plans = _plans(spark, sf_dir).select("conv_id", "plan.*")
    return plans.withColumn("speakers", F.array_join("speakers", ","))


@query(
    "k45_decisions",
    f"""WITH {_RESPONSE_PLANS}, t AS (SELECT conv_id, turn, 'a' || (turn * 3 + conv_id) % 4 AS speaker,
      CASE WHEN length(text) % 9 = 0 THEN 'ask_user' WHEN length(text) % 9 = 1 THEN 'finish' ELSE 'switch_agent' END AS action, 'a' || length(text) % 5 AS preferred FROM conversations),
    s AS (SELECT conv_id, t.speaker AS last, action, preferred, mode, speakers, count(*) OVER w AS taken, list(t.speaker) OVER w AS spoken,
        count(*) FILTER (t.speaker = speakers[1]) OVER w AS lead_turns
      FROM t JOIN p USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, t.speaker ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, NULL, NULL, NULL, mode, speakers, 0, [], 0 FROM p),
    d AS (SELECT *, list_filter(speakers, lambda x: NOT list_contains(spoken, x)) AS silent, coalesce(action = 'finish', false) AS finished,
      mode = 'discussion' AS talk FROM s),
    c AS (SELECT *, CASE WHEN action = 'ask_user' THEN 'waiting' WHEN taken = 0 THEN 'lead' WHEN mode IN ('reply', 'clarify', 'redirect') THEN 'completed'
        WHEN talk AND (lead_turns > 1 OR (finished AND last = speakers[1])) THEN 'completed' WHEN talk AND taken + 1 > 6 THEN 'max_turns'
        WHEN talk AND (taken + 1 = 6 OR finished) THEN 'closing' WHEN talk AND list_contains(silent, preferred) THEN 'preferred'
        WHEN len(silent) > 0 THEN 'plan' WHEN talk AND len(speakers) > 1 THEN 'closing' ELSE 'completed' END AS what FROM d)
    SELECT conv_id, taken::INT AS taken, CASE what WHEN 'lead' THEN speakers[1] WHEN 'closing' THEN speakers[1] WHEN 'preferred' THEN preferred WHEN 'plan' THEN silent[1] END AS speaker,
      what = 'closing' AS closing, CASE WHEN what IN ('waiting', 'completed', 'max_turns') THEN what END AS stop_reason,
      CASE WHEN what NOT IN ('waiting', 'completed', 'max_turns') THEN what END AS reason FROM c""",
)
def decided(spark, sf_dir):
    """The turns of conversations under their plans, decided anew after each."""
    n = F.char_length("text")
    action = F.when(n % 9 == 0, "ask_user").when(n % 9 == 1, "finish").otherwise("switch_agent")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("a"), ((F.col("turn") * 3 + F.col("conv_id")) % 4).cast("string")).alias("speaker"),
        action.alias("action"), F.concat(F.lit("a"), (n % 5).cast("string")).alias("preferred"),
    )
    return D.decisions(turns, _plans(spark, sf_dir), "conv_id")
