"""Budgets of lesson material: outlines, whole small documents, sections to summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.operators.tables import key_counts, running_sum

TOTAL, SUMMARIES, OUTLINE, SMALL = 8000, 4000, 800, 6000
MOST_SECTIONS, PER_CALL, MOST_CALLS = 40, 4, 12


def snapshot(documents: DataFrame, plan: str, order: str) -> DataFrame:
    """For each plan's documents how they are used: in full while the budget lasts, else by retrieval.

    ``documents`` has the columns ``content``, ``status`` and ``enabled``; others are skipped.
    """
    ready = documents.where((F.col("status") == "ready") & F.col("enabled") & (F.trim("content") != ""))
    # One row for each plan.
    counts = ready.groupBy(F.col(plan).alias("_plan")).agg(F.count("*").alias("_count"))
    share = F.least(F.lit(OUTLINE), F.floor(F.lit(SUMMARIES) / F.col("_count")))
    sized = ready.select(plan, order, F.char_length("content").alias("chars"))
    small = F.col("chars") <= SMALL
    summed = running_sum(sized, F.when(small, F.col("chars")).otherwise(0), "_running", F.asc(order), by=[plan])
    use = F.when(small & (F.col("_running") <= TOTAL), "full").otherwise("retrieval")
    joined = summed.join(counts, F.col(plan).eqNullSafe(F.col("_plan")))
    return joined.select(plan, order, "chars", share.alias("outline_chars"), use.alias("use"))


def sections_to_summarise(sections: DataFrame, document: str, path: str, at: str) -> DataFrame:
    """At most 40 sections of a document, top level first, in calls of four and twelve calls."""
    depth = F.when(F.instr(path, "/") == 0, 0).otherwise(1)
    first = Window.partitionBy(document).orderBy(depth, at)
    ranked = sections.withColumn("place", F.row_number().over(first)).where(F.col("place") <= MOST_SECTIONS)
    return ranked.withColumn("call", F.floor((F.col("place") - 1) / PER_CALL)).where(F.col("call") < MOST_CALLS)


def subtree_sizes(sections: DataFrame, document: str, path: str, size: str) -> DataFrame:
    """Characters of each section with all below it: every row adds to each of its ancestors."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = sections.select(document, F.explode(above).alias("section"), F.col(size).alias("_size"))
    return rows.groupBy(document, "section").agg((F.sum("_size") + 2 * (F.count("*") - 1)).alias("chars"))


def narration_problems(blocks: DataFrame, narration: DataFrame, scene: str, key: str) -> DataFrame:
    """Blocks that a narration lacks, repeats or makes up."""
    both = key_counts(blocks, narration, [scene, key])
    wanted, told = F.col("n_left") > 0, F.col("n_right") > 0
    known = F.col(scene).isNotNull() & F.col(key).isNotNull()
    # What lacks a part of its key is never the same as another.
    apart = F.array_compact(F.array(F.when(wanted, "missing"), F.when(told, "unknown")))
    one = F.array_compact(F.array(F.when(~told, "missing").when(~wanted, "unknown").when(F.col("n_right") > 1, "repeated")))
    return both.select(scene, key, F.explode(F.when(known, one).otherwise(apart)).alias("problem"))


def propagated(children: DataFrame, parents: DataFrame, child: str, parent: str, column: str) -> DataFrame:
    """Children with a column taken from their parents where these have it."""
    source = parents.select(F.col(parent).alias("_parent"), F.col(column).alias("_value"))
    joined = children.join(source, F.col(child) == F.col("_parent"), "left")
    return joined.withColumn(column, F.coalesce("_value", column)).drop("_parent", "_value")


def queued(rows: DataFrame, waiting: Column, active: Column, capacity: int, *order: Column) -> DataFrame:
    """Rows that get one of the free slots of a queue (K36, K37): the first ones in order."""
    taken = rows.where(active).agg(F.count("*").alias("n")).scalar()
    first = rows.where(waiting).orderBy(*order).limit(capacity)
    place = F.row_number().over(Window.orderBy(*order))
    return first.withColumn("_n", place).where(F.col("_n") + taken <= capacity).drop("_n")


def packed_sentences(sentences: Column, most: int) -> Column:
    """Sentences packed in order into pieces of at most ``most`` characters."""
    zero = F.array().cast("array<string>")

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.char_length(last) + F.char_length(s) <= most)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, s)))
        return F.when(F.size(out) == 0, F.array(s)).when(fits, joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(sentences, zero, add)


def generation_parts(text: Column) -> Column:
    """What a finished generation says between its tags."""
    inside = lambda tag: F.nullif(F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    content = F.coalesce(inside("content"), F.trim(F.regexp_replace(text, r"(?s)<(next_action|next_speaker)>.*?</\1>", "")))
    return F.struct(content.alias("content"), inside("next_action").alias("action"), inside("next_speaker").alias("speaker"))


def generating_state(status: Column, task: Column) -> Column:
    """After a restart: fail for archived tasks, leave live ones, queue the others again."""
    return F.when(status != "generating", status).when(task == "archived", "failed").when(task == "live", status).otherwise("queued")
