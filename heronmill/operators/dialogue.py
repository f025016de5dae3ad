"""Turns, compactions and reconciliation of conversations, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compactions(messages: DataFrame, key: str, number: str, keep: int = 20) -> DataFrame:
    """For each conversation the covered numbers before the last ``keep`` messages."""
    last = Window.partitionBy(key).orderBy(F.desc(number))
    ranked = messages.withColumn("_n", F.row_number().over(last))
    old = ranked.where(F.col("_n") > keep)
    return old.groupBy(key).agg(
        F.min(number).alias("covered_from"),
        F.max(number).alias("covered_to"),
        F.count("*").alias("covered"),
        F.sum(F.char_length("text")).alias("chars"),
    )


def after_compaction(messages: DataFrame, covered: DataFrame, key: str, number: str) -> DataFrame:
    """Messages that no compaction covers."""
    marks = covered.select(F.col(key).alias("_key"), "covered_to")
    joined = messages.join(marks, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col(number) > F.coalesce("covered_to", F.lit(-1))).drop("_key", "covered_to")


def next_speaker(participants: Column, spoken: Column, preferred: Column) -> Column:
    """The preferred participant, else the first who has not spoken, else the first."""
    silent = F.array_except(participants, spoken)
    return F.when(F.array_contains(participants, preferred), preferred).otherwise(
        F.coalesce(F.get(silent, F.lit(0)), F.get(participants, F.lit(0)))
    )


def next_action(action: Column) -> Column:
    """A known action, else the change of speaker."""
    known = ("switch_agent", "ask_user", "finish")
    return F.when(F.lower(F.trim(action)).isin(*known), F.lower(F.trim(action))).otherwise("switch_agent")


def reconcile(runs: DataFrame, messages: DataFrame, run_id: str, message_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a restart: unfinished runs fail, their streaming messages too, one event each."""
    open_ = F.col("status").isin("queued", "running")
    failed = runs.where(open_)
    ids = failed.select(F.col(message_id).alias("_message")).where("_message IS NOT NULL").distinct()
    hit = messages.join(ids, F.col("id") == F.col("_message"), "left")
    status = F.when(F.col("_message").isNotNull() & (F.col("status") == "streaming"), "failed").otherwise(F.col("status"))
    events = failed.select(run_id, F.lit("run_failed").alias("event_type"))
    return (
        runs.withColumn("status", F.when(open_, "failed").otherwise(F.col("status"))),
        hit.withColumn("status", status).drop("_message"),
        events,
    )


def page_asked_for(question: Column) -> Column:
    """The page number in a question, in digits or Chinese numerals, or null."""
    digits = F.nullif(F.regexp_extract(question, r"第\s*(\d{1,2})\s*页", 1), F.lit("")).cast("int")
    numeral = F.regexp_extract(question, "第([一二三四五六七八九十]{1,3})页", 1)
    tens, ones = F.regexp_extract(numeral, "^([一二三四五六七八九]?)十", 1), F.regexp_extract(numeral, "([一二三四五六七八九])$", 1)
    has_ten = numeral.contains("十")
    number = F.when(has_ten, F.when(tens == "", 10).otherwise(value_of(tens) * 10)).otherwise(0) + F.when(ones == "", 0).otherwise(value_of(ones))
    return F.coalesce(digits, F.when(numeral != "", number))


def value_of(numeral: Column) -> Column:
    """The value of a Chinese digit from one to nine."""
    return F.position(numeral, F.lit("一二三四五六七八九"))
