"""Text, HTML and JSON functions over documents, pages and events."""

from pyspark.sql import functions as F

from heronmill.functions import html as H
from heronmill.functions import json_values as J
from heronmill.functions import text as X
from heronmill.plans.registry import query, table


@query(
    "h01_text_normalize",
    r"""SELECT doc_id, length(regexp_replace(replace(text, chr(13), chr(10)), '\s+', ' ', 'g')) AS n, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed
    FROM documents""",
)
def normalize(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.char_length(F.regexp_replace(X.newlines(text), r"\s+", " ")).cast("long").alias("n"),
        X.checksum(F.trim(F.regexp_replace(text, r"\s+", " "))).alias("collapsed"),
    )


@query(
    "h29_preview",
    r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) AS preview FROM documents",
)
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(
    "h31_truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS clipped FROM documents",
)
def ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clipped(F.col("text"), 200).alias("clipped"))


@query("h18_checksum", "SELECT doc_id, sha256(text) AS digest FROM documents")
def checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.checksum(F.col("text")).alias("digest"))


@query(
    "h13_sentence_count",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?s)[^。！？；…\n.!?;]*[。！？；…\n.!?;]|[^。！？；…\n.!?;]+$'), lambda s: s <> '')) AS n FROM documents""",
)
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sentence_count(F.col("text")).alias("n"))


@query(
    "h20_first_heading",
    r"""WITH l AS (SELECT doc_id, regexp_extract(text, '^\s*(\S[^\n]*)', 1) AS line FROM (SELECT doc_id,
      CASE WHEN doc_id % 5 = 0 THEN chr(10) || '# ' || text ELSE text END AS text FROM documents))
    SELECT doc_id, CASE WHEN line LIKE '# %' THEN trim(substr(line, 3)) ELSE '' END AS heading FROM l""",
)
def headings(spark, sf_dir):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n# "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.first_heading(text).alias("heading"))


@query(
    "h24_front_matter_title",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id ELSE left(trim(split_part(text, chr(10), 1)), 300) END AS title FROM documents
    WHERE length(trim(split_part(text, chr(10), 1))) > 0""",
)
def front_titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.char_length(F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))) > 0)
    head = F.concat(F.lit('---\ntitle: "Part '), F.col("doc_id").cast("string"), F.lit('"\nlang: x\n---\n'), "text")
    text = F.when(F.col("doc_id") % 3 == 0, head).otherwise(F.col("text"))
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select("doc_id", X.document_title(text, line).alias("title"))


@query(
    "h02_half_width",
    """SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents""",
)
def half_width(spark, sf_dir):
    """ASCII is sent as full-width text and comes back."""
    ascii_ = "".join(chr(c) for c in range(0x21, 0x7F))
    wide = F.translate("text", ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_))
    return table(spark, sf_dir, "documents").select("doc_id", X.half_width(wide).alias("plain"))


@query("h03_strip_request")
def stripped(spark, sf_dir):
    asked = F.concat(F.lit("请帮我找一下 "), "text", F.lit("是什么？"))
    return table(spark, sf_dir, "documents").select("doc_id", X.query_text(asked).alias("asked"))


@query(
    "h51_tool_name",
    "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM pages",
)
def tool_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.tool_name(F.col("url")).alias("name"))


@query(
    "h52_page_numbers",
    """SELECT l_orderkey, array_to_string(list_slice(list_sort(list(l_linenumber)), 1, 3), ', ')
      || CASE WHEN count(*) > 3 THEN ' … ' || count(*) ELSE '' END AS pages FROM lineitem GROUP BY l_orderkey""",
)
def pages_of(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("p"))
    return rows.select("l_orderkey", X.page_numbers(F.col("p"), 3).alias("pages"))


@query(
    "h60_price_evidence",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda n: n::DOUBLE = 555)) > 0 AS found FROM documents""",
)
def price_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.number_in(F.col("text"), F.lit(555.0)).alias("found"))


@query("h62_valid_price", "SELECT c_custkey, coalesce(c_acctbal >= 0, false) AS valid FROM customer")
def prices(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.valid_price(F.col("c_acctbal")).alias("valid"))


_FORBIDDEN_SQL = " ".join(
    f"WHEN regexp_matches(h, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{reason}'" for p, reason in H.FORBIDDEN
)
_SCRUBBED = "html"
for _uri in H.NAMESPACES:
    _SCRUBBED = f"replace({_SCRUBBED}, '{_uri}', '')"


@query(
    "h38_html_security",
    f"SELECT page_id, CASE {_FORBIDDEN_SQL} END AS reason FROM (SELECT page_id, {_SCRUBBED} AS h FROM pages)",
)
def html_security(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.security_reason(F.col("html")).alias("reason"))


@query(
    "h39_html_quality",
    rf"""SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?i){H.CONTROL}') THEN 'control'
      WHEN NOT regexp_matches(html, '(?i){H.SCRIPT}') THEN 'script' WHEN NOT regexp_matches(html, '(?i){H.EVENT}') THEN 'event' END AS reason
    FROM pages""",
)
def html_quality(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.quality_reason(F.col("html")).alias("reason"))


@query("h35_html_visible_text")
def html_text(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.visible_text(html).alias("visible"), H.controls(html).alias("counts"))


_ANSWER_SQL = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Here:' || chr(10) || html || ' done' WHEN 1 THEN chr(10) || ' ' WHEN 2 THEN 'no page' || left(html, 5)
    WHEN 3 THEN replace(replace(html, '</html>', ''), '</HTML>', '') WHEN 4 THEN '<!doctype html>' || html || '<!DOCTYPE html></html>' WHEN 5 THEN html || html
    ELSE '```html' || chr(10) || html || chr(10) || '```' END AS a FROM pages)"""


@query(
    "h37_html_faults",
    f"""WITH w AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS w), t AS (SELECT page_id, trim(a, w) AS a, w FROM {_ANSWER_SQL}, w),
    f AS (SELECT page_id, w, CASE WHEN starts_with(a, '```') THEN trim(regexp_extract(regexp_replace(a, '^```[^\n]*\n?', ''), '(?s)^(.*)```', 1), w) ELSE a END AS a FROM t),
    p AS (SELECT *, CASE WHEN strpos(lower(a), '<!doctype') > 0 THEN strpos(lower(a), '<!doctype') ELSE strpos(lower(a), '<html') END AS s,
      CASE WHEN contains(lower(a), '</html>') THEN length(a) - strpos(reverse(lower(a)), '>lmth/<') + 1 ELSE 0 END AS e FROM f),
    d AS (SELECT *, trim(substr(a, s, greatest(e - s + 1, 0)), w) AS d FROM p),
    g AS (SELECT page_id, d, CASE WHEN a = '' THEN 'empty' WHEN s = 0 THEN 'no document' WHEN e < s THEN 'unfinished'
      WHEN len(string_split(lower(d), '<!doctype')) > 2 THEN 'several doctypes' WHEN len(string_split(lower(d), '<html')) > 2 THEN 'several roots' END AS fault FROM d)
    SELECT page_id, fault, CASE WHEN fault IS NULL THEN sha256(d) END AS document_sha256 FROM g""",
)
def html_faults(spark, sf_dir):
    """Answers of all kinds around a page."""
    html, kind = F.col("html"), F.col("page_id") % 7
    answer = (
        F.when(kind == 0, F.concat(F.lit("Here:\n"), html, F.lit(" done"))).when(kind == 1, "\n ").when(kind == 2, F.concat(F.lit("no page"), F.left(html, F.lit(5))))
        .when(kind == 3, F.replace(F.replace(html, F.lit("</html>"), F.lit("")), F.lit("</HTML>"), F.lit("")))
        .when(kind == 4, F.concat(F.lit("<!doctype html>"), html, F.lit("<!DOCTYPE html></html>"))).when(kind == 5, F.concat(html, html))
        .otherwise(F.concat(F.lit("```html\n"), html, F.lit("\n```")))
    )
    found = table(spark, sf_dir, "pages").select("page_id", H.html_answer(answer).alias("d"))
    return found.select("page_id", "d.fault", F.sha2("d.document", 256).alias("document_sha256"))


@query("h37_html_document")
def html_documents(spark, sf_dir):
    answer = F.concat(F.lit("Here it is:\n```html\n"), F.col("html"), F.lit("\n```"))
    found = H.html_document(answer)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("document"), H.document_reason(F.col("html")).alias("reason"))


@query(
    "i01_json_merge",
    """SELECT event_id, '{"k":' || event_id || ',"stage":"embed"}' AS merged FROM events""",
)
def json_merge(spark, sf_dir):
    patch = F.concat(F.lit('{"stage":"embed","k":'), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", J.merged(F.col("props"), patch).alias("merged"))


@query("i03_json_drop_keys", "SELECT event_id, '{}' AS left_ FROM events")
def json_drop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.without_keys(F.col("props"), "k", "stage").alias("left_"))


@query(
    "i05_json_slice",
    """SELECT event_id, props AS found, true AS container FROM events""",
)
def json_slice(spark, sf_dir):
    text = F.concat(F.lit("Sure! ```json\n"), "props", F.lit("\n```"))
    found = J.object_slice(text)
    return table(spark, sf_dir, "events").select("event_id", found.alias("found"), J.is_container(found).alias("container"))
