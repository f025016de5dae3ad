"""Checks and visible text of HTML documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronmill.functions.folds import let, trimmed
from heronmill.functions.text import collapse

#: What a page must not contain, and the reason that is reported.
FORBIDDEN = (
    (r"window\s*\.\s*parent", "访问 window.parent"),
    (r"\bparent\s*\.\s*document", "访问 parent.document"),
    (r"\btop\s*\.\s*document", "访问 top.document"),
    (r"\beval\s*\(", "使用 eval"),
    (r"new\s+Function\s*\(", "使用 new Function"),
    (r"\bfetch\s*\(", "发起 fetch 请求"),
    (r"XMLHttpRequest", "发起 XMLHttpRequest 请求"),
    (r"WebSocket", "建立 WebSocket 连接"),
    (r"EventSource", "建立 EventSource 连接"),
    (r"document\s*\.\s*cookie", "访问 cookie"),
    (r"\bwindow\s*\.\s*open\s*\(", "自动打开窗口"),
    (r"\blocalStorage\b", "使用 localStorage"),
    (r"\bsessionStorage\b", "使用 sessionStorage"),
    (r"\blocation\s*\.\s*(?:href|assign|replace)", "跳转页面"),
    (r"<form\b", "使用 form 表单"),
    (r"@import", "引入外部样式"),
    (r"https?://", "引用外部网络地址"),
    (r"""(?:src|href)\s*=\s*["']\s*//""", "引用外部网络地址"),
)
#: Addresses that only name a namespace.
NAMESPACES = ("http://www.w3.org/2000/svg", "http://www.w3.org/1999/xlink", "http://www.w3.org/1999/xhtml")
#: Signs of controls, scripts and event bindings.
CONTROL = r"<(?:button|input|select|textarea|canvas)\b"
SCRIPT = r"<script\b"
EVENT = r"\bon[a-z]+\s*=|\baddEventListener\s*\("
MOST_BYTES = 256 * 1024


def has(html: Column, pattern: str) -> Column:
    return html.rlike("(?i)" + pattern)


def without_namespaces(html: Column) -> Column:
    """Namespace addresses deleted."""
    for uri in NAMESPACES:
        html = F.replace(html, F.lit(uri), F.lit(""))
    return html


def security_reason(html: Column) -> Column:
    """Why a page is refused, or null."""
    scrubbed = without_namespaces(html)
    return F.coalesce(*(F.when(has(scrubbed, p), F.lit(reason)) for p, reason in FORBIDDEN))


def quality_reason(html: Column) -> Column:
    """What an interactive page lacks, or null."""
    return (
        F.when(~has(html, CONTROL), "control").when(~has(html, SCRIPT), "script").when(~has(html, EVENT), "event")
    )


def document_reason(html: Column) -> Column:
    """Why a document is refused: size, parts, security, quality."""
    return F.coalesce(
        F.when(F.octet_length(html) > MOST_BYTES, "size"),
        F.when(~has(html, r"<head\b"), "head"),
        F.when(~has(html, r"<body\b"), "body"),
        security_reason(html),
        quality_reason(html),
    )


def visible_text(html: Column) -> Column:
    """Text that a reader sees, white space collapsed."""
    shown = F.regexp_replace(html, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    shown = F.regexp_replace(shown, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        shown = F.replace(shown, F.lit(entity), F.lit(char))
    return collapse(shown)


def html_answer(text: Column) -> Column:
    """The one document in an answer and, without it, its fault (H37): ``empty``, ``no document``, ``unfinished``,
    ``several doctypes`` or ``several roots``. A fence around the whole answer goes first; null is empty.
    """
    bare = trimmed(F.coalesce(text, F.lit("")))
    opened = F.regexp_replace(bare, r"^```[^\n]*\n", "")
    closed = F.when(F.contains(opened, F.lit("```")), F.regexp_extract(opened, r"(?s)^(.*)```", 1)).otherwise(opened)
    inner = F.when(bare.startswith("```"), trimmed(closed)).otherwise(bare)

    def cut(of: Column) -> Column:
        lower = F.lower(of)
        doctype, root = F.instr(lower, "<!doctype"), F.instr(lower, "<html")
        start = F.when(doctype > 0, doctype).otherwise(root)
        back = F.instr(F.reverse(lower), ">lmth/<")
        end = F.when(back > 0, F.char_length(of) - back + 1).otherwise(0)
        return F.struct(of.alias("text"), start.alias("start"), end.alias("end"))

    def found(c: Column) -> Column:
        document = trimmed(F.substr(c["text"], c["start"], F.greatest(c["end"] - c["start"] + 1, F.lit(0))))
        fault = F.when(bare == "", "empty").when(c["start"] == 0, "no document").when(c["end"] < c["start"], "unfinished")
        return let(
            F.struct(document.alias("document"), fault.alias("fault")),
            lambda d: F.struct(d["document"].alias("document"), F.coalesce(
                d["fault"],
                F.when(F.regexp_count(d["document"], F.lit("(?i)<!doctype")) > 1, "several doctypes")
                .when(F.regexp_count(d["document"], F.lit("(?i)<html")) > 1, "several roots"),
            ).alias("fault")),
        )

    whole = let(let(inner, cut), found)
    return let(whole, lambda d: F.struct(F.when(d["fault"].isNull(), d["document"]).alias("document"), d["fault"].alias("fault")))


def html_document(text: Column) -> Column:
    """The one document in an answer, or null."""
    return html_answer(text)["document"]


def controls(html: Column) -> Column:
    """Counts of controls and event bindings."""
    return F.struct(
        F.regexp_count(html, F.lit("(?i)" + CONTROL)).alias("controls"),
        F.regexp_count(html, F.lit("(?i)" + EVENT)).alias("events"),
    )
