"""Checkpoints by content: what a page was made from is hashed, and a new plan keeps the pages that still hold.

Hashes are taken of JSON in a canonical form, which does not depend on white space or on the order of members at any depth.
A checkpoint can be restored if its version is the current one, its node is known, and its hash is that of the page as it
is planned now (I38, I39). A plan keeps the largest set of such finished pages that holds all prerequisites of its
pages; what depends on a page that goes is made anew.

Defined cases: text that is no JSON has no canonical form and no hash, and restores nothing; null parts are JSON null; pages
behind unknown prerequisites are not kept, pages that need each other are kept together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.functions.folds import let
from heronmill.operators.pages import MOST_PAGES
from heronmill.sources.storage import stored

VERSION = 1
#: Nodes that a checkpoint may go on with.
NODES = ("plan", "research", "content", "narration", "review", "revision", "done")


def canonical(json: Column) -> Column:
    """JSON text with members in order of their names and without white space; null for what is not JSON."""
    return F.to_json(F.try_parse_json(json))


def content_hash(**parts: Column) -> Column:
    """SHA-256 of an object of these members, each JSON text."""
    empty = F.lit("null")
    texts = [F.concat(F.lit(f'"{name}":'), canonical(F.coalesce(part, empty))) for name, part in sorted(parts.items())]
    return F.sha2(F.concat(F.lit("{"), *(x for t in texts for x in (t, F.lit(",")))), 256)


def steps_signature(steps: Column) -> Column:
    """What tells two lists of steps apart: the canonical text, or nothing for none."""
    text = canonical(F.coalesce(steps, F.lit("[]")))
    return F.when(text.isin("[]", "null"), "").otherwise(F.coalesce(text, F.lit("")))


def restorable(version: Column, saved_hash: Column, node: Column, current_hash: Column) -> Column:
    """Whether a checkpoint can be gone on with."""
    # Hashes are the costly part: each is taken once, and none where a cheaper sign tells.
    same = (version == VERSION) & node.isin(*NODES) & (F.nullif(saved_hash, F.lit("")) == current_hash)
    return F.coalesce(same, F.lit(False))


def kept_pages(pages: DataFrame) -> DataFrame:
    """(plan_id, page_id) of pages that a plan keeps; ``pages`` has (plan_id, page_id, prerequisites, holds).

    A plan has ``MOST_PAGES`` pages by rule and is settled in one fold; larger ones lose pages round by round together.
    """
    rows = pages.select("plan_id", "page_id", "prerequisites", F.coalesce("holds", F.lit(False)).alias("holds"))
    # Stored, so that what a page holds by is looked at once.
    rows = stored(rows, "pages")
    large = stored(rows.groupBy("plan_id").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_PAGES).select("plan_id"), "large-plans")
    any_large = not large.isEmpty()
    own = rows.join(large, rows["plan_id"].eqNullSafe(large["plan_id"]), "left_anti") if any_large else rows
    small = own.groupBy("plan_id").agg(F.collect_list(F.when(F.col("holds"), F.struct("page_id", "prerequisites"))).alias("pages"))
    kind = "struct<pages: array<struct<page_id: string, prerequisites: array<string>>>, stays: boolean>"

    def stay(held: Column, _: Column) -> Column:
        ids = F.transform(held["pages"], lambda p: p["page_id"])
        left = F.filter(held["pages"], lambda p: F.size(F.array_except(p["prerequisites"], ids)) == 0)
        after = let(left, lambda pages: F.struct(pages, F.size(pages) == F.size(held["pages"])).cast(kind))
        return F.when(held["stays"], held).otherwise(after)

    start = F.struct(F.col("pages"), F.size("pages") == 0).cast(kind)
    settled = F.aggregate(F.sequence(F.lit(0), F.size("pages")), start, stay)["pages"]
    out = small.select("plan_id", F.explode(settled).alias("p")).select("plan_id", "p.page_id")
    if not any_large:
        return out
    kept = stored(rows.where("holds").drop("holds").join(large, rows["plan_id"].eqNullSafe(large["plan_id"]), "left_semi"), "kept-pages")
    count = kept.count()
    while True:
        needs = kept.select("plan_id", "page_id", F.explode("prerequisites").alias("needs"))
        have = kept.select("plan_id", F.col("page_id").alias("needs"))
        broken = needs.join(have, ["plan_id", "needs"], "left_anti").select("plan_id", "page_id").distinct()
        kept = stored(kept.join(broken, ["plan_id", "page_id"], "left_anti"), "kept-pages")
        left = kept.count()
        if left == count:
            return out.unionByName(kept.select("plan_id", "page_id"))
        count = left
