"""Classification, chunking, outlines, plans and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronmill.functions import classify as C
from heronmill.operators import checkpoints as K
from heronmill.operators import code_units as U
from heronmill.operators import ingest as I
from heronmill.operators import pages as P
from heronmill.operators.chunks import Limits, chunk_documents
from heronmill.operators.sections import section_tree
from heronmill.operators.tables import dealt_by, violations
from heronmill.plans.registry import query, table
from heronmill.streaming import events as S


_CODE_LINES = """(SELECT doc_id, i, CASE WHEN doc_id % 4 = 0 THEN line WHEN i % 3 = 0 THEN 'if (' || line || ') {' WHEN i % 3 = 1 THEN '    ' || line || CASE WHEN doc_id % 4 = 1 THEN ';' ELSE '' END
    WHEN doc_id % 4 = 3 THEN '// ' || line ELSE '}' END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""
_KEYWORDS = ", ".join(f"'{k}'" for k in C.KEYWORDS)


@query(
    "d18_code_ratios",
    f"""WITH l AS (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM {_CODE_LINES}),
    r AS (SELECT doc_id, avg((lower(ltrim(regexp_extract(t, '^[^ \t(]*'), '#')) IN ({_KEYWORDS}))::INT) AS keyword, avg((ends_with(t, '{{') OR starts_with(t, '}}'))::INT) AS brace,
      avg(regexp_matches(line, '^[ \t]')::INT) AS indent, avg(regexp_matches(t, '^(//|#|/?[*])')::INT) AS comment, avg(ends_with(t, ';')::INT) AS semicolon FROM l WHERE t <> '' GROUP BY doc_id)
    SELECT *, (CASE WHEN keyword >= 0.2 THEN 2 ELSE 0 END + CASE WHEN brace >= 0.2 THEN 1 ELSE 0 END + CASE WHEN indent >= 0.3 THEN 1 ELSE 0 END
      + CASE WHEN comment >= 0.1 THEN 1 ELSE 0 END + CASE WHEN semicolon >= 0.2 THEN 1 ELSE 0 END)::INT AS score FROM r""",
)
def code_ratios(spark, sf_dir):
    """Documents made into code of three styles, or left as they are."""
    kind = F.col("doc_id") % 4

    def one(line, i):
        last = F.when(kind == 3, F.concat(F.lit("// "), line)).otherwise("}")
        body = F.concat(F.lit("    "), line, F.when(kind == 1, ";").otherwise(""))
        return F.when(kind == 0, line).when(i % 3 == 0, F.concat(F.lit("if ("), line, F.lit(") {"))).when(i % 3 == 1, body).otherwise(last)

    text = F.array_join(F.transform(F.split("text", "\n"), one), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("code"))
    return rows.select("doc_id", C.line_ratios(F.col("code")).alias("r"), C.code_score(F.col("code")).alias("score")).select("doc_id", "r.*", "score")


def _markdown(spark, sf_dir):
    """Documents of which some lines are headings of three levels and some have an empty line behind them."""
    mark = lambda i: F.when(i % 7 == 1, "# ").when(i % 7 == 3, "## ").when(i % 7 == 5, "#### ").otherwise("")
    lines = F.transform(
        F.split("text", "\n"), lambda t, i: F.concat(mark(i), t, F.when(i % 11 == 10, "\n").otherwise(""))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def _chunks(spark, sf_dir):
    return chunk_documents(_markdown(spark, sf_dir), "doc_id", "text")


@query(
    "j02_section_tree",
    """WITH l AS (SELECT doc_id, i, line, CASE i % 7 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE 0 END AS level
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
    s AS (SELECT *, CASE WHEN level = 0 AND (i = 0 OR lag(level) OVER w > 0 OR (i - 1) % 11 = 10) THEN 1 ELSE 0 END AS begins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM s),
    b AS (SELECT doc_id, min(i) AS i, length(trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13))) AS n FROM g WHERE level = 0 GROUP BY doc_id, block),
    h AS (SELECT doc_id, i, level, trim(line) AS heading,
        max(CASE WHEN level = 1 THEN i END) OVER w AS a1, max(CASE WHEN level = 2 THEN i END) OVER w AS a2
      FROM l WHERE level > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    t AS (SELECT h.*, o.heading AS h1, CASE WHEN h.a2 > h.a1 THEN p.heading END AS h2,
        (SELECT min(n.i) FROM h n WHERE n.doc_id = h.doc_id AND n.i > h.i AND n.level <= h.level) AS upto
      FROM h LEFT JOIN h o ON o.doc_id = h.doc_id AND o.i = h.a1 LEFT JOIN h p ON p.doc_id = h.doc_id AND p.i = h.a2)
    SELECT t.doc_id AS document_id, level, heading, CASE level WHEN 1 THEN heading WHEN 2 THEN h1 || '/' || heading
        ELSE CASE WHEN h2 IS NULL THEN h1 ELSE h1 || '/' || h2 END || '/' || heading END AS section_path,
      (sum(n) + 2 * (count(*) - 1))::BIGINT AS chars
    FROM t JOIN b ON b.doc_id = t.doc_id AND b.i > t.i AND b.i < coalesce(t.upto, 1000000000) AND b.n > 0 GROUP BY t.doc_id, t.i, level, heading, h1, h2""",
)
def sections(spark, sf_dir):
    return section_tree(_markdown(spark, sf_dir), "doc_id", "text").drop("section")


@query("i14_classify")
def classified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 9 == 0, "a/b.go").when(F.col("doc_id") % 9 == 1, "notes.md")
    return docs.select("doc_id", C.classify(F.col("text"), path).alias("class"))


@query("j01_chunk_documents")
def chunked(spark, sf_dir):
    return _chunks(spark, sf_dir)


def _lines(spark, sf_dir, each, gap="\n"):
    """Documents as sources: a text for every line and its place, joined."""
    parts = F.transform(F.split("text", "\n"), each)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, gap).alias("code"), F.lit("go").alias("language"))


_EACH_LINE = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


@query(
    "j20_code_units",
    f"""SELECT doc_id AS document_id, 'f' || i AS symbol, 'function' AS symbol_type, length('func f' || i || '() {{' || chr(10) || chr(9) || 's := `' || line || '`' || chr(10) || chr(10) || chr(9) || 'return' || chr(10) || '}}')::INT AS chars
    FROM {_EACH_LINE}""",
)
def code_units(spark, sf_dir):
    """A function for every line of a document, with an empty line inside."""
    def one(line, i):
        return F.concat(F.lit("func f"), i.cast("string"), F.lit("() {\n\ts := `"), line, F.lit("`\n\n\treturn\n}"))

    units = U.units_of(_lines(spark, sf_dir, one, "\n\n"), "doc_id", "code", "language")
    return units.select("document_id", U.symbol_of(F.col("text"), F.col("language")).alias("s"), F.char_length("text").alias("chars")).select("document_id", "s.*", "chars")


@query("j21_brace_depth", f"SELECT doc_id AS document_id, i AS at, CASE i % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS depth FROM {_EACH_LINE}")
def brace_depths(spark, sf_dir):
    """Braces in strings and comments among those that count, and a comment over two lines."""
    def one(line, i):
        words = F.translate(line, "{}/*\"'`\\", "")
        return (
            F.when(i % 4 == 0, F.concat(F.lit("if x { // { "), words)).when(i % 4 == 1, F.concat(F.lit('s := "}\\"}" /* { '), words))
            .when(i % 4 == 2, F.concat(words, F.lit(" } */ else {"))).otherwise(F.concat(words, F.lit(" }}}")))
        )

    rows = U.read_lines(_lines(spark, sf_dir, one), "doc_id", "code", "language")
    return rows.select("document_id", F.col("at").cast("long").alias("at"), "depth")


@query(
    "j18_json_members",
    """WITH d AS (SELECT doc_id, lang, to_json(string_split(text, chr(10)))::VARCHAR AS j, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id AS document_id, 'id' AS path, 1 AS n, length('"id": ' || doc_id)::INT AS chars FROM d
    UNION ALL SELECT doc_id, 'lang', 1, length('"lang": "' || lang || '"')::INT FROM d
    UNION ALL SELECT doc_id, 'lines', 1, length(j)::INT + 9 FROM d WHERE length(j) + 9 <= 680
    UNION ALL SELECT doc_id, 'lines[' || i || ']', ceil(length(e) / 680)::INT, length(e)::INT
    FROM (SELECT doc_id, unnest(range(len(lines))) AS i, to_json(unnest(lines))::VARCHAR AS e FROM d WHERE length(j) + 9 > 680)""",
)
def json_members(spark, sf_dir):
    fields = F.struct(F.col("doc_id").alias("id"), "lang", F.split("text", "\n").alias("lines"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.to_json(fields).alias("code"))
    rows = U.json_pieces(texts, "doc_id", "code", Limits())
    sizes = F.aggregate("pieces", F.lit(0), lambda n, p: n + F.char_length(p["text"]))
    return rows.select("document_id", F.get("pieces", F.lit(0))["symbol"].alias("path"), F.size("pieces").alias("n"), sizes.alias("chars"))


@query("j14_split_documents")
def split_documents(spark, sf_dir):
    """A fifth of the documents as functions, a fifth as JSON, a fifth with headings, the others as they are."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    functions = F.transform(lines, lambda t, i: F.concat(F.lit("func f"), i.cast("string"), F.lit("() {\n\t// "), t, F.lit("\n}")))
    kind = F.col("doc_id") % 5
    headed = F.transform(lines, lambda t, i: F.concat(F.when(i % 4 == 1, "## ").otherwise(""), t))
    text = (
        F.when(kind == 0, F.concat(F.lit("package a\n\n"), F.array_join(functions, "\n\n")))
        .when(kind == 1, F.to_json(F.struct("doc_id", lines.alias("lines"))))
        .when(kind == 2, F.array_join(headed, "\n\n")).otherwise(F.col("text"))
    )
    path = F.when(kind == 0, "a/b.go").when(kind == 2, "notes.md")
    return U.split_documents(docs.select("doc_id", text.alias("text"), path.alias("path")), "doc_id", "text", "path")


@query("j01_chunk_invariants", "SELECT 0 AS blank, 0 AS too_long, 0 AS wrong_count, 0 AS negative")
def chunk_invariants(spark, sf_dir):
    rules = {
        "blank": F.trim("content") != "",
        "too_long": F.col("character_count") <= 1600,
        "wrong_count": F.col("character_count") == F.char_length("content"),
        "negative": F.col("chunk_index") >= 0,
    }
    return violations(_chunks(spark, sf_dir), rules)


@query("d12_outline_sections")
def outline_sections(spark, sf_dir):
    return P.outline_by_section(_chunks(spark, sf_dir))


@query(
    "d12_outline_of_roles",
    """SELECT conv_id AS document_id, role AS section_path, min(turn) AS first_chunk, sum(length(text))::BIGINT AS chars, count(*) AS n_chunks,
      left(arg_min(text, turn), 60) AS preview FROM conversations WHERE role <> '' GROUP BY conv_id, role""",
)
def outline_of_roles(spark, sf_dir):
    """Turns as chunks and roles as their sections."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("section_path"),
        F.col("text").alias("content"), F.char_length("text").cast("long").alias("character_count"),
    )
    return P.outline_by_section(rows)


@query(
    "d13_outline_windows",
    """SELECT conv_id AS document_id, '第 ' || (turn // 5 + 1) || ' 段' AS title, sum(length(text))::BIGINT AS chars, left(arg_min(text, turn), 60) AS preview
    FROM conversations GROUP BY conv_id, turn // 5""",
)
def outline_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"),
        F.char_length("text").cast("long").alias("character_count"),
    )
    return P.outline_by_window(rows)


@query("k20_ingest_state")
def ingest_state(spark, sf_dir):
    return I.ingest(table(spark, sf_dir, "documents"))[0]


@query("j26_chunk_vectors")
def chunk_vectors(spark, sf_dir):
    return I.ingest(table(spark, sf_dir, "documents"))[2]


@query(
    "a21_vector_violations",
    """WITH c AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS i FROM lineitem),
    v AS (SELECT d, CASE WHEN d % 40 = 1 THEN i + 100 ELSE i END AS i FROM c WHERE (d + i) % 9 <> 0)
    SELECT d AS document_id, i AS chunk_index, 'no vector' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.d = c.d AND v.i = c.i)
    UNION ALL SELECT d, i, 'no chunk' FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE v.d = c.d AND v.i = c.i)""",
)
def vector_violations(spark, sf_dir):
    """Lines as chunks; some have no vector, some vectors have an index of no chunk."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"))
    lines = dealt_by(lines, lines.columns).distinct()
    moved = F.when(F.col("document_id") % 40 == 1, F.col("chunk_index") + 100).otherwise(F.col("chunk_index"))
    vectors = lines.where("(document_id + chunk_index) % 9 <> 0").withColumn("chunk_index", moved)
    return I.vector_violations(lines, vectors)


def _plans(spark, sf_dir, **more):
    """Orders as plans and their lines as pages; a page needs the one at half its place. ``more`` are columns made of a line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("position", (F.row_number().over(w) - 1).cast("int"))
    needs = F.when(F.col("position") > 0, F.array((F.col("position") / 2).cast("int").cast("string"))).otherwise(F.array().cast("array<string>"))
    needs = F.when((F.col("l_orderkey") % 50 == 0) & (F.col("position") == 1), F.array(F.lit("1"))).otherwise(needs)
    return rows.select(
        F.col("l_orderkey").alias("plan_id"), F.col("position").cast("string").alias("page_id"), "position", needs.alias("prerequisites"),
        *(column.alias(name) for name, column in more.items()),
    )


_PAGES = """p AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem),
e AS (SELECT plan_id, position, CASE WHEN plan_id % 50 = 0 AND position = 1 THEN 1 WHEN position > 0 THEN position // 2 END AS needs FROM p)"""


@query(
    "k24_page_levels",
    f"""WITH RECURSIVE {_PAGES}, l AS (SELECT plan_id, position, 0 AS level FROM e WHERE needs IS NULL
      UNION ALL SELECT e.plan_id, e.position, l.level + 1 FROM l JOIN e ON e.plan_id = l.plan_id AND e.needs = l.position AND e.position <> l.position)
    SELECT plan_id, position::VARCHAR AS page_id, level FROM l""",
)
def page_levels(spark, sf_dir):
    return P.levels(_plans(spark, sf_dir))


@query(
    "k26_plan_violations",
    f"""WITH {_PAGES} SELECT plan_id, CASE WHEN max(position) >= 15 THEN 'too_many,' ELSE '' END
      || CASE WHEN bool_or(coalesce(needs >= position, false)) THEN 'forward_dependency' ELSE '' END AS broken FROM e GROUP BY plan_id""",
)
def plan_violations(spark, sf_dir):
    """Rules as text: each is followed by a comma, but for the last one there is."""
    told = F.transform("broken", lambda rule: F.when(rule == "forward_dependency", rule).otherwise(F.concat(rule, F.lit(","))))
    return P.plan_violations(_plans(spark, sf_dir)).select("plan_id", F.array_join(told, "").alias("broken"))


_HOLDS = """h AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position,
    l_partkey % 6 <> 0 AND l_suppkey % 17 <> 0 AND l_partkey % 23 <> 5 AS holds FROM lineitem)"""


@query(
    "i39_kept_pages",
    f"""WITH RECURSIVE {_PAGES}, {_HOLDS},
    gone AS (SELECT plan_id, position FROM h WHERE NOT holds UNION SELECT e.plan_id, e.position FROM gone g JOIN e ON e.plan_id = g.plan_id AND e.needs = g.position)
    SELECT plan_id, position::VARCHAR AS page_id FROM h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.plan_id = h.plan_id AND g.position = h.position)""",
)
def kept_pages(spark, sf_dir):
    """Lines as pages whose saved form has its members in another order; some titles, versions and nodes have changed."""
    part, key = F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    planned = text('{"id":', key, ',"at":{"part":', part, ',"kind":"line"}}')
    saved = text('{ "at": {"kind": "line", "part": ', F.when(F.col("l_partkey") % 6 == 0, "-1").otherwise(part), '}, "id": ', key, " }")
    version = F.when(F.col("l_suppkey") % 17 == 0, 2).otherwise(1)
    node = F.when(F.col("l_partkey") % 23 == 5, "nowhere").otherwise("review")
    holds = K.restorable(version, K.content_hash(page=saved), node, K.content_hash(page=planned))
    return K.kept_pages(_plans(spark, sf_dir, holds=holds))


def _events(spark, sf_dir, files_per_batch=None):
    """The table as a stream; its files are in no order of events, so what has a state takes them in one batch."""
    batch = table(spark, sf_dir, "events")
    # A pattern, since a stream reads folders or patterns and the table may be one file.
    return S.read_stream(spark, f"{sf_dir}/event[s].parquet", batch.schema, files_per_batch)


@query(
    "k08_stream_fold",
    """SELECT user_id, max(event_id) AS last_seq, arg_max(event_type, event_id) AS state,
      coalesce(round(sum(value) FILTER (event_type = 'purchase'), 4), 0) AS spent, count(*) AS n FROM events GROUP BY user_id""",
)
def stream_fold(spark, sf_dir):
    updates = S.drain(S.fold_events(_events(spark, sf_dir)), "event-fold", "update")
    return S.latest_states(updates, "user_id").withColumn("spent", F.round("spent", 4))


@query(
    "n05_stream_windows",
    """SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_windows(spark, sf_dir):
    """Windows that the watermark has closed."""
    return S.drain(S.windowed_counts(_events(spark, sf_dir), "1 hour", "10 minutes", "event_type"), "event-windows")


@query("n06_stream_sessions")
def stream_sessions(spark, sf_dir):
    return S.drain(S.session_counts(_events(spark, sf_dir), "30 minutes", "10 minutes", "user_id"), "event-sessions")


@query(
    "a30_server_sent",
    """SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) AS head FROM events""",
)
def server_sent(spark, sf_dir):
    lines = S.drain(S.server_sent(_events(spark, sf_dir, 64)), "event-lines")
    return lines.select("event_id", F.regexp_extract("line", r"(?s)^(id: .*?\nevent: .*?\n)", 1).alias("head"))
