"""Dependent pages: plan checks and the order in which they can be worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.sources.storage import stored

MOST_PAGES = 15


def plan_violations(pages: DataFrame) -> DataFrame:
    """For each plan the rules it breaks: size, order, identity, backward dependencies.

    ``pages`` has (plan_id, page_id, position, prerequisites); a plan is small by rule,
    and its rows meet by partial aggregation.
    """
    deps = pages.select("plan_id", "position", F.explode("prerequisites").alias("needs"))
    at = pages.select(F.col("plan_id").alias("_plan"), F.col("page_id").alias("_page"), F.col("position").alias("_at"))
    joined = deps.join(at, (F.col("plan_id") == F.col("_plan")) & (F.col("needs") == F.col("_page")), "left")
    wrong = joined.groupBy("plan_id").agg(
        F.count_if(F.col("_at").isNull()).alias("unknown"), F.count_if(F.col("_at") >= F.col("position")).alias("forward")
    )
    shape = pages.groupBy("plan_id").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("ids"),
        F.min("position").alias("low"), F.max("position").alias("high"), F.count_distinct("position").alias("places"),
    )
    rules = {
        "too_many": F.col("n") > MOST_PAGES,
        "repeated_id": F.col("ids") < F.col("n"),
        "order": (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("places") < F.col("n")),
        "unknown_dependency": F.coalesce("unknown", F.lit(0)) > 0,
        "forward_dependency": F.coalesce("forward", F.lit(0)) > 0,
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return shape.join(wrong, "plan_id", "left").select("plan_id", broken.alias("broken"))


def levels(pages: DataFrame) -> DataFrame:
    """(plan_id, page_id, level): the round in which a page's prerequisites are finished.

    A plan has ``MOST_PAGES`` pages by rule and is settled in one fold over its rounds. Plans that break the rule
    go through all rounds together. Pages on a cycle or behind an unknown page get no level.
    """
    sized = pages.select("plan_id", "page_id", "prerequisites").withColumn("_n", F.count("*").over(Window.partitionBy("plan_id")))
    small = sized.where(F.col("_n") <= MOST_PAGES).groupBy("plan_id").agg(F.collect_list(F.struct("page_id", "prerequisites")).alias("pages"))
    kind = "array<struct<page_id: string, level: int>>"

    def round_of(done: Column, level: Column) -> Column:
        ids = F.transform(done, lambda d: d["page_id"])
        waits = lambda p: F.array_contains(ids, p["page_id"]) | F.exists(p["prerequisites"], lambda q: ~F.array_contains(ids, q))
        ready = F.filter("pages", lambda p: ~waits(p))
        return F.concat(done, F.transform(ready, lambda p: F.struct(p["page_id"].alias("page_id"), level.cast("int").alias("level"))).cast(kind))

    settled = F.aggregate(F.sequence(F.lit(0), F.size("pages") - 1), F.array().cast(kind), round_of)
    out = small.select("plan_id", F.explode(settled).alias("p")).select("plan_id", "p.*")
    large = stored(sized.where(F.col("_n") > MOST_PAGES).drop("_n"), "large-plans")
    return out if large.isEmpty() else out.unionByName(levels_by_rounds(large))


def levels_by_rounds(pages: DataFrame) -> DataFrame:
    """Levels of plans of any size: each round takes the pages of all plans whose prerequisites are done.

    The number of jobs follows the deepest plan and not the number of plans.
    """
    deps = pages.select("plan_id", "page_id", F.explode("prerequisites").alias("needs")).distinct()
    done = stored(
        pages.where(F.size("prerequisites") == 0).select("plan_id", "page_id", F.lit(0).alias("level")), "page-levels"
    )
    level = 0
    while True:
        level += 1
        met = done.select("plan_id", F.col("page_id").alias("needs"))
        waiting = deps.join(met, ["plan_id", "needs"], "left_anti").select("plan_id", "page_id")
        ready = (
            pages.select("plan_id", "page_id")
            .join(waiting, ["plan_id", "page_id"], "left_anti")
            .join(done, ["plan_id", "page_id"], "left_anti")
            .withColumn("level", F.lit(level))
        )
        ready = stored(ready, "page-round")
        if ready.isEmpty():
            return done
        done = done.unionByName(ready)


def outline_by_section(chunks: DataFrame) -> DataFrame:
    """Sections of a document in order of their first chunk."""
    rows = chunks.where("section_path <> ''").groupBy("document_id", "section_path").agg(
        F.min("chunk_index").alias("first_chunk"),
        F.sum("character_count").alias("chars"),
        F.count("*").alias("n_chunks"),
        F.left(F.min_by("content", "chunk_index"), F.lit(60)).alias("preview"),
    )
    return rows


def outline_by_window(chunks: DataFrame, width: int = 5) -> DataFrame:
    """Windows of chunks for documents without sections."""
    part = F.floor(F.col("chunk_index") / width)
    rows = chunks.groupBy("document_id", part.alias("part")).agg(
        F.sum("character_count").alias("chars"), F.left(F.min_by("content", "chunk_index"), F.lit(60)).alias("preview")
    )
    return rows.select("document_id", F.concat(F.lit("第 "), (F.col("part") + 1).cast("string"), F.lit(" 段")).alias("title"), "chars", "preview")
