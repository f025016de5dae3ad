"""Checks of content blocks and reviews held as JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<key:string,type:string,content:string,options:array<string>,answer:string,columns:array<array<string>>>>"
TYPES = ("text", "list", "code", "table", "columns", "quiz", "image", "formula")
REVIEW = "struct<approved:boolean,score:int,target:string,issues:array<struct<severity:string,code:string,message:string>>>"
TARGETS = ("plan", "research", "both", "content", "narration")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def block_reason(json: Column) -> Column:
    """The first rule that the blocks break, or null."""
    blocks = F.from_json(json, BLOCKS)
    keys = F.transform(blocks, lambda b: b["key"])
    columns = lambda b: F.coalesce(b["columns"], F.array().cast("array<array<string>>"))
    bad_columns = lambda b: (b["type"] == "columns") & (
        ~F.size(columns(b)).between(2, 3) | F.exists(columns(b), lambda c: ~F.size(c).between(1, 5))
    )
    return (
        F.when(blocks.isNull() | (F.size(blocks) == 0), "empty")
        .when(F.exists(keys, blank), "key")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated key")
        .when(F.exists(blocks, lambda b: ~F.coalesce(b["type"].isin(*TYPES), F.lit(False))), "type")
        .when(F.exists(blocks, bad_columns), "columns")
        .when(F.exists(blocks, lambda b: b["type"].isin("text", "code", "formula") & blank(b["content"])), "content")
    )


def quiz_reason(json: Column) -> Column:
    """What a quiz lacks: a quiz block, two distinct options, an answer among them."""
    quizzes = F.filter(F.from_json(json, BLOCKS), lambda b: b["type"] == "quiz")
    options = lambda b: F.array_distinct(F.filter(F.transform(b["options"], lambda o: F.trim(o)), lambda o: o != ""))
    return (
        F.when(F.coalesce(F.size(quizzes), F.lit(0)) <= 0, "no quiz")
        .when(F.exists(quizzes, lambda b: F.coalesce(F.size(options(b)), F.lit(0)) < 2), "options")
        .when(F.exists(quizzes, lambda b: ~F.coalesce(F.array_contains(options(b), F.trim(b["answer"])), F.lit(False))), "answer")
    )


def review(json: Column) -> Column:
    """A review with a score from 0 to 100, known targets and no blank issue."""
    r = F.from_json(json, REVIEW)
    issues = F.transform(
        F.filter(F.coalesce(r["issues"], F.array().cast("array<struct<severity:string,code:string,message:string>>")), lambda i: ~blank(i["message"])),
        lambda i: F.struct(
            F.when(i["severity"].isin("blocker", "major", "minor"), i["severity"]).otherwise("major").alias("severity"),
            F.trim(F.coalesce(i["code"], F.lit(""))).alias("code"), F.trim(i["message"]).alias("message"),
        ),
    )
    return F.struct(
        (F.coalesce(r["approved"], F.lit(False)) | (F.size(issues) == 0)).alias("approved"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(r["score"], F.lit(0)))).alias("score"),
        F.when(r["target"].isin(*TARGETS), r["target"]).otherwise("content").alias("target"),
        issues.alias("issues"),
        F.size(F.filter(issues, lambda i: i["severity"] == "blocker")).alias("blockers"),
    )


def better_revision(old: Column, new: Column) -> Column:
    """Whether the new review wins: fewer blockers, then a higher score."""
    return (new["blockers"] < old["blockers"]) | ((new["blockers"] == old["blockers"]) & (new["score"] > old["score"]))


def revision_target(targets: Column) -> Column:
    """The target that comes first among those asked for."""
    return F.coalesce(*(F.when(F.array_contains(targets, t), F.lit(t)) for t in TARGETS))


def confirmed_price(pricing: Column, model: Column) -> Column:
    """A model's prices if a user confirmed them; the currency is USD where none is named."""
    entry = F.try_element_at(
        F.from_json(pricing, "map<string,struct<source:string,input:double,output:double,currency:string>>"), model
    )
    has = (entry["source"] == "user") & (entry["input"].isNotNull() | entry["output"].isNotNull())
    return F.when(has, F.struct(
        F.coalesce(entry["input"], F.lit(0.0)).alias("input"), F.coalesce(entry["output"], F.lit(0.0)).alias("output"),
        F.coalesce(F.nullif(entry["currency"], F.lit("")), F.lit("USD")).alias("currency"),
    ))
