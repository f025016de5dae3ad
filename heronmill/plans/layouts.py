"""Pages of boxes: lines as text blocks, orders as tables."""

from pyspark.sql import functions as F

from heronmill.operators import layout as L
from heronmill.plans.registry import query, table
from heronmill.sources.text_files import markdown_table

_BOXES = """b AS (SELECT {page} AS page, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey * 7 % 700)::DOUBLE AS y0,
    (l_partkey % 500 + l_quantity * 4)::DOUBLE AS x1, (l_suppkey * 7 % 700 + 8 + l_linenumber)::DOUBLE AS y1, l_returnflag AS text FROM lineitem),
t AS (SELECT {own} AS page, o_orderkey * 10 AS id, (o_custkey % 400)::DOUBLE AS x0, (o_custkey * 3 % 600)::DOUBLE AS y0,
    (o_custkey % 400 + 20 + o_orderkey % 180)::DOUBLE AS x1, (o_custkey * 3 % 600 + 10 + o_orderkey % 40)::DOUBLE AS y1,
    CASE WHEN o_orderkey % 11 <> 0 THEN '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' END AS text
  FROM orders WHERE o_orderkey % 4 = 1),
i AS (SELECT page, y0, false AS is_table, id, text FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND t.text IS NOT NULL
    AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)
  UNION ALL SELECT page, y0, true, id, text FROM t WHERE text IS NOT NULL)"""


def _boxes(spark, sf_dir, page):
    """Blocks and tables; ``page`` gives the page of an order."""
    d = lambda c: c.cast("double")
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") * 7 % 700
    blocks = table(spark, sf_dir, "lineitem").select(
        page(F.col("l_orderkey")).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        d(x).alias("x0"), d(y).alias("y0"), d(x + F.col("l_quantity") * 4).alias("x1"), d(y + 8 + F.col("l_linenumber")).alias("y1"),
        F.col("l_returnflag").alias("text"),
    )
    key = F.col("o_orderkey")
    x, y = F.col("o_custkey") % 400, F.col("o_custkey") * 3 % 600
    cells = F.array(F.array(F.lit("key"), F.lit("status")), F.array(key.cast("string"), F.col("o_orderstatus")))
    tables = table(spark, sf_dir, "orders").where(key % 4 == 1).select(
        page(key).alias("page"), (key * 10).alias("id"), d(x).alias("x0"), d(y).alias("y0"),
        d(x + 20 + key % 180).alias("x1"), d(y + 10 + key % 40).alias("y1"), F.when(key % 11 != 0, markdown_table(cells)).alias("text"),
    )
    return blocks, tables


@query(
    "a08_page_items",
    "WITH "
    + _BOXES.format(page="CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 100 END", own="CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END")
    + " SELECT * FROM i",
)
def items_of_pages(spark, sf_dir):
    """Some pages, one of which has a third of all boxes."""
    blocks, tables = _boxes(spark, sf_dir, lambda k: F.when(k % 3 == 0, F.lit(0)).otherwise(k % 100))
    return L.page_items(blocks, tables, "page", "id")


@query(
    "a08_page_texts",
    "WITH "
    + _BOXES.format(page="l_orderkey // 4", own="o_orderkey // 4")
    + " SELECT page, count(*) FILTER (is_table) AS n_tables, string_agg(text, chr(10) || chr(10) ORDER BY y0, is_table, id, text) AS text FROM i GROUP BY page",
)
def texts_of_pages(spark, sf_dir):
    blocks, tables = _boxes(spark, sf_dir, lambda k: F.floor(k / 4))
    return L.page_texts(L.page_items(blocks, tables, "page", "id"), "page", "id")
