"""The section tree of Markdown as a plan over lines.

Texts become lines, lines become units (a heading, or a block of text, code or table), and units
know their section, all sections above it, and how much these hold. Everything is keyed by a
number of the row, so the rows move once, before they are split into lines, and all windows
and groups after that are local. What follows an order is a running window: the fence state is a running
sum of opened and closed fences, the stack of headings is the last heading of each level that no higher heading follows.

Only headings with ``#`` that stand at the top open a section; underlined ones are text, those in lists,
quotes and code are part of these (J02, J41). Fenced code has its fences (J42), fenced and indented code and tables
are not to be cut (J03), horizontal rules go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.functions import text as X
from heronmill.functions.folds import emitted, let, trimmed

LEVELS = range(1, 7)
FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]|$)"
TITLE = r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
ITEM = r"^ {0,3}([-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)"
#: More characters than a heading's or an item's sign has with what stands around it.
HEAD = 16


def fence_turns(lines: Column) -> Column:
    """Where code begins (+1, before its first line) and ends (-1, after its last line).

    A fence is closed by one of the same sign that is as long at least and has nothing behind it.
    """
    may_be = lambda line: F.contains(line, F.lit("```")) | F.contains(line, F.lit("~~~"))
    mark = lambda line: F.when(may_be(line), F.regexp_extract(line, FENCE, 1)).otherwise("")
    each = F.transform(lines, lambda line, i: F.struct(i.alias("i"), mark(line).alias("mark"), line.alias("line")))
    found = F.transform(
        F.filter(each, lambda f: f["mark"] != ""),
        lambda f: F.struct(f["i"], f["mark"], F.rtrim(F.translate(f["line"], "\t", " ")).alias("line")),
    )

    def step(mark: Column, f: Column) -> tuple[Column, Column]:
        opens = mark == ""
        closes = (mark != "") & F.startswith(f["mark"], mark) & f["line"].endswith(f["mark"])
        turn = F.when(opens, F.array(F.struct((f["i"] * 3).alias("at"), F.lit(1).alias("turn")))).when(
            closes, F.array(F.struct((f["i"] * 3 + 2).alias("at"), F.lit(-1).alias("turn")))
        )
        after = F.when(opens, f["mark"]).when(closes, F.lit("")).otherwise(mark)
        return after, F.coalesce(turn, F.array().cast("array<struct<at: int, turn: int>>"))

    return emitted(found, "string", F.lit(""), "struct<at: int, turn: int>", step)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, document_id, at, line, code, fence): the lines of every row without front matter; null texts have none."""
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("document_id"), F.col(text_col).alias("text")
    ).where("text IS NOT NULL")
    # The number is given, so that small tables are dealt to all tasks as well.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def marked(lines: Column) -> Column:
        none = F.lit(None).cast("string")
        own = F.transform(lines, lambda line, i: F.struct((i * 3 + 1).alias("at"), line.alias("line"), F.lit(0).alias("turn")))
        turns = F.transform(fence_turns(lines), lambda t: F.struct(t["at"].alias("at"), none.alias("line"), t["turn"].alias("turn")))
        return F.concat(own, turns)

    body = let(X.newlines(F.col("text")), X.without_front_matter)
    rows = keyed.repartition(parts, "row").select("row", "document_id", F.explode(let(F.split(body, "\n"), marked)).alias("_"))
    flat = rows.select("row", "document_id", "_.*")
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum("turn").over(before)
    opened = F.count_if(F.col("turn") == 1).over(before)
    return flat.withColumns({"code": inside > 0, "fence": opened}).where("line IS NOT NULL").drop("turn")


def cells(line: Column) -> Column:
    """How many cells a line of a table has; 0 where no sign divides it."""
    inner = F.btrim(F.replace(trimmed(line), F.lit("\\|"), F.lit("")), F.lit(" \t"))
    count = F.size(F.split(F.regexp_replace(inner, r"^\||\|$", ""), r"\|"))
    return F.when(F.contains(line, F.lit("|")), F.when(F.contains(inner, F.lit("|")), count).otherwise(0)).otherwise(0)


def ruled_cells(line: Column) -> Column:
    """The number of cells of a line under a table's head; 0 for other lines."""
    bare = F.translate(line, " \t", "")
    inner = F.split(F.regexp_replace(bare, r"^\||\|$", ""), r"\|")
    ok = F.contains(bare, F.lit("|")) & F.forall(inner, lambda c: c.rlike("^:?-+:?$"))
    return F.when(F.contains(line, F.lit("|")) & line.rlike(r"^[ \t|:-]+$"), F.when(ok, F.size(inner)).otherwise(0)).otherwise(0)


def units_of(lines: DataFrame) -> DataFrame:
    """(row, document_id, unit, level, title, text, whole): headings (level 1 to 6) and blocks (level 0) in order."""
    line = F.col("line")
    order = Window.partitionBy("row").orderBy("at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.translate(line, " \t", "")
    # Most patterns look no further, and Java tries one that is tied to the beginning at every place of what it is given.
    head = F.left(line, F.lit(HEAD))
    marked = head.rlike("^ {0,3}[-*_=]")
    text = ~F.col("code") & ~F.col("blank")
    seen = lines.withColumns(
        {
            "indent": F.when(
                head.rlike("^[ \t]"), F.char_length(F.replace(F.regexp_extract(line, "^[ \t]*", 0), F.lit("\t"), F.lit("    ")))
            ).otherwise(0),
            "blank": ~F.col("code") & (trimmed(line) == ""),
            "level": F.when(F.col("code"), 0).otherwise(F.char_length(F.regexp_extract(head, HEADING, 1))),
            "item": F.when(F.col("code"), "").otherwise(F.regexp_extract(head, ITEM, 1)),
            "quote": ~F.col("code") & head.rlike("^ {0,3}>"),
            "ruled": F.when(
                ~F.col("code") & marked & line.rlike(r"^ {0,3}[-*_][-*_ \t]*$"), bare.rlike(r"^(\*{3,}|-{3,}|_{3,})$")
            ).otherwise(False),
            "under": ~F.col("code") & marked & line.rlike(r"^ {0,3}(=+|-+)[ \t]*$"),
            "cells": F.when(F.col("code"), 0).otherwise(cells(line)),
            "ruled_cells": F.when(F.col("code"), 0).otherwise(ruled_cells(line)),
        }
    ).withColumns(
        {
            "item": F.when(F.col("ruled"), "").otherwise(F.right("item", F.lit(1))),
            "first": F.regexp_extract(head, r"^ {0,3}(?:[-+*]|0{0,8}1[.)])(?:[ \t]|$)", 0) != "",
        }
    )
    # The sign of the list that goes on here: that of the last line at the margin.
    margin = F.when(~F.col("blank") & (F.col("indent") < 2), F.when(F.col("code"), "").otherwise(F.col("item")))
    seen = seen.withColumn("list", F.coalesce(F.last(margin, ignorenulls=True).over(earlier), F.lit("")))
    inside = text & (F.col("indent") >= 2) & (F.col("list") != "")
    seen = seen.withColumns({"inside": inside, "level": F.when(inside, 0).otherwise(F.col("level"))})
    deep = text & (F.col("indent") >= 4) & ~F.col("inside")
    plain = text & (F.col("level") == 0)
    kept = seen.withColumns(
        {
            "deep": deep,
            "plain": plain,
            # Text of a paragraph, under which a line may make a heading of it.
            "prose": plain & (F.col("item") == "") & ~F.col("quote") & ~F.col("inside") & ~F.col("ruled") & ~deep,
        }
    ).withColumns(
        {
            "was": F.lag(F.struct("plain", "blank", "prose", "quote", "code", "fence")).over(order),
            "next_cells": F.coalesce(F.lead("ruled_cells").over(order), F.lit(0)),
        }
    )
    was = F.col("was")
    kept = kept.withColumn("lined", F.col("under") & F.coalesce(was["prose"], F.lit(False)) & ~F.col("inside"))
    kept = kept.withColumn("rule", F.col("ruled") & ~F.col("lined") & ~F.col("inside"))
    # An indented line is code unless it goes on with a paragraph.
    goes_on = F.last(F.when(~F.col("deep"), F.col("plain") & ~F.col("rule") & ~F.col("lined")), ignorenulls=True).over(earlier)
    kept = kept.withColumn("set_in", F.col("deep") & ~F.coalesce(goes_on, F.lit(False)))
    kept = kept.withColumns(
        {
            "ended": F.coalesce(F.lag(F.col("lined") | F.col("rule")).over(order), F.lit(False)),
            "was_code": F.coalesce(F.lag("set_in").over(order), F.lit(False)),
            "was_set_in": F.coalesce(F.last(F.when(~F.col("blank"), F.col("set_in")), ignorenulls=True).over(earlier), F.lit(False)),
        }
    )
    table = F.col("plain") & ~F.col("rule") & ~F.col("lined") & (F.col("cells") > 0) & (F.col("cells") == F.col("next_cells"))
    # A line that is no text of a paragraph: behind it a new block begins.
    apart = was.isNull() | (~was["blank"] & ~was["plain"]) | F.col("ended")
    starts_item = (F.col("item") != "") & (F.col("list") != F.col("item")) & (F.col("first") | ~was["prose"])
    begins = (
        F.when(F.col("code"), was.isNull() | ~was["code"] | (was["fence"] != F.col("fence")))
        .when((F.col("level") > 0) | F.col("rule"), True)
        .when(F.col("blank") | F.col("lined"), False)
        .when(apart | table, True)
        .when(F.col("inside") | ((F.col("item") != "") & (F.col("list") == F.col("item"))), False)
        .when(was["blank"], ~(F.col("set_in") & F.col("was_set_in")))
        .otherwise(starts_item | (F.col("quote") & ~was["quote"]) | (F.col("was_code") & ~F.col("set_in")))
    )
    told = kept.withColumns({"begins": begins, "table": table})
    told = told.withColumn("unit", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shown = ~F.col("rule") & ~F.col("lined") & (F.col("level") == 0)
    own = F.array_sort(F.collect_list(F.when(shown, F.struct("at", "line"))))
    grouped = told.groupBy("row", "unit").agg(
        F.first("document_id").alias("document_id"),
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, trimmed(F.regexp_extract("line", TITLE, 1)))).alias("title"),
        trimmed(F.array_join(F.transform(own, lambda r: r["line"]), "\n")).alias("text"),
        F.max(F.col("begins") & (F.col("code") | F.col("set_in") | F.col("table"))).alias("whole"),
        F.max(F.col("begins") & F.col("code")).alias("fenced"),
    )
    # Fences without a line between them hold nothing.
    hollow = F.col("fenced") & F.col("text").rlike(r"^(`{3,}|~{3,})[^\n]*(\n {0,3}\1[`~]*[ \t]*)?$")
    return grouped.withColumn("text", F.when(F.col("level") > 0, "").when(hollow, "").otherwise(F.col("text"))).drop("fenced")


def placed(units: DataFrame) -> DataFrame:
    """Blocks with ``above``: for each section around them, from the top, its unit, title and size with all below it.

    ``size`` is that of the section at hand. Sizes count characters and two for each gap between blocks. They
    are differences of running sums at the section's heading and at the next one that is as high or higher.
    """
    order = Window.partitionBy("row").orderBy("unit")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("unit")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("row")
    chars = F.char_length("text")
    rows = units.withColumns({"chars": F.sum(chars).over(upto), "n": F.count_if(chars > 0).over(upto)})
    here = F.struct("unit", "title", "chars", "n")
    rows = rows.withColumns({f"h{k}": F.last(F.when(F.col("level") == k, here), ignorenulls=True).over(upto) for k in LEVELS})
    sums = F.struct("chars", "n")
    rows = rows.withColumns(
        {f"e{k}": F.last(F.when(F.col("level").between(1, k), sums), ignorenulls=True).over(back) for k in LEVELS}
        | {"total": F.struct(F.max("chars").over(all_of).alias("chars"), F.max("n").over(all_of).alias("n"))}
    )

    def size(k: int, begin: Column | None) -> Column:
        end = F.coalesce(f"e{k}", "total")
        chars, n = (end[c] - (begin[c] if begin is not None else 0) for c in ("chars", "n"))
        return chars + 2 * F.greatest(n - 1, F.lit(0))

    entries = []
    for k in LEVELS:
        own = F.col(f"h{k}")
        higher = [F.coalesce(F.col(f"h{j}")["unit"], F.lit(-1)) for j in range(1, k)]
        open_ = own.isNotNull()
        for h in higher:
            open_ = open_ & (own["unit"] > h)
        entries.append(
            F.when(open_, F.struct(own["unit"].alias("unit"), own["title"].alias("title"), F.lit(k).alias("level"), size(k, own).alias("size")))
        )
    above = F.array_compact(F.array(*entries))
    return (
        rows.withColumn("above", above)
        .withColumn("size", F.when(F.size("above") == 0, size(6, None)).otherwise(F.element_at(F.col("above"), -1)["size"]))
        .where("level = 0 AND text <> ''")
        .select("row", "document_id", "unit", "text", "whole", "above", "size")
    )


def path_of(above: Column) -> Column:
    """Titles from the top, joined by a slash; nothing stands before the first one that is not empty."""
    return F.aggregate(
        above, F.lit(""), lambda path, s: F.when(path == "", s["title"]).otherwise(F.concat(path, F.lit("/"), s["title"]))
    )


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The blocks of all texts with their sections."""
    return placed(units_of(lines_of(docs, id_col, text_col)))


def section_tree(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, section, level, heading, section_path, chars): sections that hold text, with all below them."""
    rows = blocks_of(docs, id_col, text_col)
    each = F.transform(
        "above",
        lambda s, i: F.struct(
            s["unit"].alias("section"), s["level"].alias("level"), s["title"].alias("heading"),
            path_of(F.slice(F.col("above"), F.lit(1), i + 1)).alias("section_path"), s["size"].alias("chars"),
        ),
    )
    # Every block knows its sections; one row of each is enough.
    found = rows.select("row", "document_id", F.explode(each).alias("s"))
    return found.groupBy("row", "document_id", "s.section").agg(F.first("s").alias("s")).select("document_id", "s.*")
