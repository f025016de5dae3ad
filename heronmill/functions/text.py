"""Text functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that end a sentence.
SENTENCE_ENDS = "。！？；…\n.!?;"

#: Phrases of request, reference, place and question around what is searched for.
REQUEST_PHRASES = (
    "帮我找一下", "帮我查一下", "帮我看一下", "帮忙找一下", "帮我找下", "帮我查下",
    "帮我看下", "请帮我找", "请帮我查", "请帮我", "我想知道", "我想了解",
    "我要找", "麻烦帮我", "麻烦", "请问", "帮我", "帮忙", "找一下", "查一下",
    "看一下", "找下", "查下", "看下", "一下",
    "之前上传的", "上次上传的", "刚才上传的", "之前传的", "我上传的", "上传的",
    "前面提到的", "刚才说的", "那份", "那个", "这份", "这个", "那些", "这些",
    "里面讲的", "里面说的", "里讲的", "里说的", "提到的", "关于", "有关",
    "什么是", "是什么", "什么叫", "怎么样", "怎么做", "怎么用", "怎么",
    "如何", "为什么", "有哪些", "哪些", "有没有", "是否", "多少",
)
#: Punctuation that is cut from the ends of a word of a query.
EDGE_PUNCTUATION = "，。！？；：、（）【】「」『』《》〈〉“”‘’·…—～.,;:!?()[]{}<>\"'`"
#: White space as Unicode has it.
SPACE = r"[\s\x{85}\p{Z}]"


def newlines(text: Column) -> Column:
    """Without a byte order mark, and with ``\\n`` for every line end."""
    plain = F.when(text.startswith("﻿"), F.substr(text, F.lit(2))).otherwise(text)
    return F.when(F.contains(plain, F.lit("\r")), F.regexp_replace(plain, "\r\n?", "\n")).otherwise(plain)


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def half_width(text: Column) -> Column:
    """Full-width ASCII and space as ASCII, white space collapsed."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return collapse(F.translate(text, full, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "))


def longest_first(phrases: tuple[str, ...]) -> list[str]:
    """By falling length, so that no phrase is cut by one inside it."""
    return sorted(phrases, key=len, reverse=True)


def strip_request(text: Column) -> Column:
    """What is left of a question without phrases of request and edge punctuation."""
    for phrase in longest_first(REQUEST_PHRASES):
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    words = F.transform(F.split(collapse(text), " "), lambda w: F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def query_text(text: Column) -> Column:
    """The text to search for: stripped, or the normalised question where nothing is left."""
    plain = half_width(text)
    return F.coalesce(F.nullif(strip_request(plain), F.lit("")), plain)


def sentence_count(text: Column) -> Column:
    """How many sentences ``sentences`` gives: one for each end, and one more after the last end."""
    ends = F.char_length(text) - F.char_length(F.translate(text, SENTENCE_ENDS, ""))
    rest = (text != "") & ~F.contains(F.lit(SENTENCE_ENDS), F.right(text, F.lit(1)))
    return (ends + rest.cast("int")).cast("long")


def sentences(text: Column) -> Column:
    """Sentences with their ends."""
    ends = SENTENCE_ENDS.replace("\n", r"\n")
    return F.regexp_extract_all(text, F.lit(f"(?s)[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0))


def first_sentence(text: Column, most: int) -> Column:
    """The first sentence, at most ``most`` characters."""
    return F.left(F.trim(F.coalesce(F.get(sentences(text), F.lit(0)), F.lit(""))), F.lit(most))


def clipped(text: Column, most: int) -> Column:
    """The first ``most`` characters, with an ellipsis where something is cut."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def preview(text: Column, most: int = 60) -> Column:
    """The beginning of the collapsed text."""
    return F.left(collapse(text), F.lit(most))


def title(text: Column, most: int = 300) -> Column:
    """A trimmed title of bounded length."""
    return F.left(F.trim(text), F.lit(most))


def fit(text: Column, budget: int) -> Column:
    """The text within a budget and whether it was cut."""
    return F.struct(F.left(text, F.lit(budget)).alias("text"), (F.char_length(text) > budget).alias("truncated"))


def checksum(text: Column) -> Column:
    """Hexadecimal SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def front_matter(text: Column) -> Column:
    """The lines between leading ``---`` lines, or an empty string."""
    return F.regexp_extract(text, r"^---[ \t]*\n((?s:.*?)\n)?---[ \t]*(?:\n|$)", 1)


def without_front_matter(text: Column) -> Column:
    """The text after its front matter; a delimiter that is never closed goes too."""
    body = F.regexp_replace(text, r"^---[ \t]*\n(?:(?s:.*?)\n)?---[ \t]*(?:\n|$)", "")
    open_ = F.when(body == text, F.regexp_replace(text, r"^---[ \t]*\n", "")).otherwise(body)
    return F.when(text.startswith("---"), open_).otherwise(text)


def front_title(text: Column) -> Column:
    """The title in the front matter, without quotes."""
    return F.btrim(F.trim(F.regexp_extract(front_matter(text), r"(?m)^title:[ \t]*(.*)$", 1)), F.lit("\"'"))


def first_heading(text: Column) -> Column:
    """The first line that is not blank, if it is a heading of level one."""
    line = F.regexp_extract(without_front_matter(text), r"^\s*(\S[^\n]*)", 1)
    return F.when(line.startswith("# "), F.trim(F.substr(line, F.lit(3)))).otherwise("")


def document_title(text: Column, fallback: Column) -> Column:
    """Front matter, else heading, else what the caller has."""
    empty = F.lit("")
    return title(F.coalesce(F.nullif(front_title(text), empty), F.nullif(first_heading(text), empty), fallback))


def first_line(text: Column) -> Column:
    """The first line that is not blank, or the name of an untitled document."""
    return F.coalesce(F.nullif(title(F.regexp_extract(text, r"^\s*(\S[^\n]*)", 1)), F.lit("")), F.lit("未命名文档"))


def tool_name(text: Column) -> Column:
    """Every byte that a tool's name may not have as ``_``."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_replace(latin, "[^A-Za-z0-9_-]", "_")


def page_numbers(pages: Column, most: int = 10) -> Column:
    """The first page numbers, and the total where there are more."""
    shown = F.array_join(F.transform(F.slice(pages, 1, most), lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) > most, F.concat(shown, F.lit(" … "), F.size(pages).cast("string"))).otherwise(shown)


def importance(value: Column) -> Column:
    """From 1 to 5; what is lower becomes 3."""
    return F.when(value < 1, 3).otherwise(F.least(value, F.lit(5)))


def rewrite_line(line: Column) -> Column:
    """A line of a list without bullet, number and quotes."""
    plain = F.regexp_replace(F.trim(line), r"^(?:[-*•]\s*|\d{1,3}[.)、．]\s*)", "")
    return F.trim(F.btrim(F.trim(plain), F.lit("\"'“”‘’「」")))


def unfenced(text: Column) -> Column:
    """The inside of a code fence around the whole text."""
    inner = F.regexp_extract(F.trim(text), r"^```[^\n]*\n((?s:.*?))\n?```$", 1)
    return F.coalesce(F.nullif(F.trim(inner), F.lit("")), F.trim(text))


def number_in(text: Column, price: Column) -> Column:
    """Whether any number in the text equals the price."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.exists(numbers, lambda n: n.cast("double") == price)


def valid_price(price: Column) -> Column:
    """Finite and not negative."""
    return F.coalesce((price >= 0) & ~F.isnan(price) & (price < float("inf")), F.lit(False))


def unit_price_text(vector: Column) -> Column:
    """A vector as ``[a,b]``; null for vectors that are empty or not finite."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")))
