"""Text of pages from boxes: blocks that a table covers give way to the table.

A block is covered if its centre lies in the table's box, or half of its area does. A part of an interval
that is half as long holds its middle, so a half-covered block has its centre in the box too: it is enough to look
for tables where the centre is. Tables stand in every cell of a grid that they touch, blocks in the one
of their centre, and a page of any size is many groups of (page, cell).

Boxes are (x0, y0, x1, y1) as four columns. Defined cases: boxes with a null or non-finite side cover
nothing and are covered by nothing; blank blocks go; tables without a text cover nothing and go; rows that repeat stay as often as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.functions.folds import trimmed
from heronmill.sources.text_files import bbox_overlap

BOX = ("x0", "y0", "x1", "y1")
#: The side of a cell, in the unit of the boxes: about a line's length on a page of 600.
CELL = 150.0
#: Cells that one table may stand in; larger tables take larger cells.
MOST_CELLS = 64


def finite(*sides: str) -> Column:
    ok = F.lit(True)
    for s in (F.col(s).cast("double") for s in sides):
        ok = ok & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def covered(block: dict[str, Column], table: dict[str, Column]) -> Column:
    """Whether a table takes the place of a block."""
    x, y = (block["x0"] + block["x1"]) / 2, (block["y0"] + block["y1"]) / 2
    inside = x.between(table["x0"], table["x1"]) & y.between(table["y0"], table["y1"])
    return inside | (bbox_overlap(*(block[c] for c in BOX), *(table[c] for c in BOX)) >= 0.5)


def scale_of(width: Column, height: Column) -> Column:
    """How often the cell's side is doubled for a box, so that it touches some ``MOST_CELLS`` cells at most."""
    side = F.greatest(width, height, F.lit(CELL)) / (CELL * (MOST_CELLS**0.5 - 1))
    return F.greatest(F.ceil(F.log2(side)), F.lit(0)).cast("int")


def without_covered(blocks: DataFrame, tables: DataFrame, page: str) -> DataFrame:
    """Rows of ``blocks`` that no table of their page covers."""
    sides = [F.col(c).cast("double").alias(f"_{c}") for c in BOX]
    boxes = tables.select(F.col(page).alias("_page"), *sides).where(finite(*(f"_{c}" for c in BOX)))
    boxes = boxes.where("_x1 >= _x0 AND _y1 >= _y0").distinct()
    boxes = boxes.withColumn("_scale", scale_of(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))
    cell = lambda at, scale: F.floor(at / (F.lit(CELL) * F.pow(F.lit(2.0), scale)))
    for axis in "xy":
        first, last = (cell(F.col(f"_{axis}{k}"), F.col("_scale")) for k in "01")
        boxes = boxes.withColumn(f"_c{axis}", F.explode(F.sequence(first, last)))
    # A double has some two thousand of these at most, and pages have a few.
    scales = sorted(r[0] for r in boxes.select("_scale").distinct().collect())
    own = {c: F.col(f"`{c}`").cast("double") for c in BOX}
    holds = finite(*BOX) & covered(own, {c: F.col(f"_{c}") for c in BOX})
    for scale in scales:
        cx, cy = (cell((own[f"{a}0"] + own[f"{a}1"]) / 2, F.lit(scale)) for a in "xy")
        same = (F.col(f"`{page}`") == F.col("_page")) & (cx == F.col("_cx")) & (cy == F.col("_cy"))
        blocks = blocks.join(boxes.where(F.col("_scale") == scale), same & holds, "left_anti")
    return blocks


def page_items(blocks: DataFrame, tables: DataFrame, page: str, order: str) -> DataFrame:
    """(page, y0, is_table, order, text): what stands on a page, in this order by ``y0``, ``is_table`` and ``order``."""
    shown = tables.where(F.coalesce(trimmed(F.col("text")) != "", F.lit(False)))
    text = blocks.where(F.coalesce(trimmed(F.col("text")) != "", F.lit(False)))
    rest = without_covered(text.select(page, order, *BOX, "text"), shown, page)

    def items(rows: DataFrame, is_table: bool) -> DataFrame:
        return rows.select(page, F.col("y0").cast("double").alias("y0"), F.lit(is_table).alias("is_table"), order, trimmed(F.col("text")).alias("text"))

    return items(rest, False).unionByName(items(shown, True))


def page_texts(items: DataFrame, page: str, order: str) -> DataFrame:
    """(page, n_tables, text): items joined by empty lines. The text of a page is one value, so its items meet in one group."""
    rows = F.array_sort(F.collect_list(F.struct("y0", "is_table", order, "text")))
    return items.groupBy(page).agg(
        F.count_if("is_table").alias("n_tables"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text")
    )
