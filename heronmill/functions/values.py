"""Small values of documents, runs and reviews as Column expressions; letters and numbers name the survey's rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics that need no plan.
TRIVIAL_TOPICS = ("你好", "您好", "嗨", "在吗", "谢谢", "好的", "可以", "嗯", "什么？", "什么")
#: Signs of a network fault, and what users read instead.
NETWORK_SIGNS = ("proxyconnect", "dial tcp", "stacktrace")
NETWORK_NOTICE = "模型服务连接失败"
#: White space at the edges of short texts.
EDGES = " \t\n\r\v\f"


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def token_source(tokens_in: Column, tokens_out: Column) -> Column:
    """Whether a run reported tokens."""
    return F.when((tokens_in == 0) & (tokens_out == 0), "none").otherwise("reported")


def tokens(reported: Column, text: Column) -> Column:
    """Reported tokens, or the number of characters."""
    return F.coalesce(reported, F.char_length(text)).cast("int")


def ended(status: Column) -> Column:
    """Whether an ingest has come to an end."""
    return F.coalesce(status.isin("ready", "failed"), F.lit(False))


def detail(metadata: Column, name: str) -> Column:
    """A text of a metadata object, empty where there is none (B39 with stage, B40 with error)."""
    return F.coalesce(F.get_json_object(metadata, f"$.{name}"), F.lit(""))


def trimmed(items: Column) -> Column:
    """Items without white space at their edges; blank ones go."""
    return F.filter(F.transform(items, lambda x: F.trim(x, F.lit(EDGES))), lambda x: x != "")


def variants(asked: Column, items: Column, most: int = 3) -> Column:
    """Up to ``most`` items that differ from the question and from each other, whatever their case."""
    own = F.lower(F.trim(asked, F.lit(EDGES)))

    def take(held: Column, x: Column) -> Column:
        seen = F.exists(held, lambda h: F.lower(h) == F.lower(x)) | F.coalesce(F.lower(x) == own, F.lit(False))
        return F.when((F.size(held) >= most) | seen, held).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(trimmed(items), F.array().cast("array<string>"), take)


def search_text(parts: list[Column], most: int = 300) -> Column:
    """Non-blank parts in a row."""
    return F.left(F.array_join(trimmed(F.array(*(F.coalesce(p, F.lit("")) for p in parts))), " "), F.lit(most))


def shown(current: Column, target: Column) -> Column:
    """What a typewriter shows next: longer steps where more is left."""
    left = F.char_length(target) - F.char_length(current)
    step = F.when(left > 260, 8).when(left > 120, 4).when(left > 60, 2).otherwise(1)
    return F.when(left <= 0, target).otherwise(F.left(target, F.char_length(current) + F.least(step, left)))


def trivial(topic: Column) -> Column:
    """Whether a topic needs no plan."""
    return F.coalesce(F.lower(F.trim(topic, F.lit(EDGES))).isin(*TRIVIAL_TOPICS), F.lit(False))


def safe(text: Column) -> Column:
    """One line for users, without network details (H47); the cut counts characters, so that none is split."""
    line = F.trim(F.translate(text, "\r\n", "  "), F.lit(EDGES))
    fault = F.lit(False)
    for sign in NETWORK_SIGNS:
        fault = fault | F.contains(F.lower(line), F.lit(sign))
    cut = F.when(F.char_length(line) > 600, F.concat(F.left(line, F.lit(600)), F.lit("…"))).otherwise(line)
    return F.when(fault, NETWORK_NOTICE).otherwise(cut)


def source_type(value: Column, fallback: str) -> Column:
    """manual or import, the fallback for blank, null for anything else."""
    clean = F.trim(F.coalesce(value, F.lit("")), F.lit(EDGES))
    return F.when(clean == "", fallback).when(clean.isin("manual", "import"), clean)


def needs_prices(source: Column, price_in: Column, price_out: Column) -> Column:
    """Whether prices are to be looked up."""
    missing = price_in.isNull() | price_out.isNull()
    return source.isNull() | (source == "catalog") | ((source != "user") & missing)


def review_text(lines: Column, most: int = 24_000) -> Column:
    """Lines joined; where they are cut, a notice follows."""
    joined = F.array_join(lines, "\n")
    notice = f"\n（可见文本过长，这里只给前 {most} 个字符）"
    return F.when(F.char_length(joined) <= most, joined).otherwise(F.concat(F.left(joined, F.lit(most)), F.lit(notice)))
