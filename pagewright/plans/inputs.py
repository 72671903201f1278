"""Document-shaped inputs derived from the star schema, in whole numbers so that both engines compute the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned items: a document for each order, two pages, coordinates from quantities and prices."""
    t = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return t.select(
        F.col("l_orderkey").alias("doc_id"), (1 + F.col("l_linenumber") % 2).alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("item_no"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("text"), (F.col("l_quantity") * 10).cast("double").alias("x"), (cents % 842).cast("double").alias("y"),
        (F.length(F.col("l_partkey").cast("string")) * 6 + 6).cast("double").alias("width"), F.lit(12.0).alias("height"), (8 + F.col("l_suppkey") % 8).cast("double").alias("font_size"),
        F.when(F.col("l_returnflag") == "R", "Image").when(F.col("l_returnflag") == "A", "FormField").otherwise("Text").alias("item_type"),
    )


#: The same in DuckDB.
ITEMS = """items AS (SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS item_no,
 'P' || l_partkey AS text, CAST(l_quantity * 10 AS DOUBLE) AS x, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 842 AS DOUBLE) AS y,
 CAST(length(CAST(l_partkey AS VARCHAR)) * 6 + 6 AS DOUBLE) AS width, 12.0::DOUBLE AS height, CAST(8 + l_suppkey % 8 AS DOUBLE) AS font_size,
 CASE l_returnflag WHEN 'R' THEN 'Image' WHEN 'A' THEN 'FormField' ELSE 'Text' END AS item_type FROM lineitem)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as recognised blocks, origin top left, on pages of 600 by 842 pixels."""
    i = items(spark, sf_dir)
    return i.select("doc_id", "page", F.col("item_no").alias("block_no"), "text", F.col("x").alias("left"), (842 - F.col("y")).alias("top"), "width", "height", F.lit(600).alias("width_px"), F.lit(842).alias("height_px"))


BLOCKS = ITEMS + ", blocks AS (SELECT doc_id, page, item_no AS block_no, text, x AS \"left\", 842 - y AS top, width, height, 600 AS width_px, 842 AS height_px FROM items)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage log from the event stream."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "pdf").when(F.col("event_type") == "view", "drawTable").when(F.col("event_type") == "purchase", "image").when(F.col("event_type") == "signup", "imageTable").otherwise("screenshot")
    engine = F.when(F.col("user_id") % 3 == 0, "local").when(F.col("user_id") % 3 == 1, "ai")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), kind.alias("kind"), F.lit(1).cast("long").alias("fileCount"), (1 + F.col("event_id") % 7).alias("pageCount"), (F.col("event_id") % 3).alias("ocrPageCount"), engine.alias("engine"), (100 + F.col("event_id") % 1000).alias("totalMs"))


USAGE = """usage AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CASE event_type WHEN 'click' THEN 'pdf' WHEN 'view' THEN 'drawTable' WHEN 'purchase' THEN 'image' WHEN 'signup' THEN 'imageTable' ELSE 'screenshot' END AS kind,
 1 AS files, 1 + event_id % 7 AS pages, event_id % 3 AS ocr, CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'ai' END AS engine, 100 + event_id % 1000 AS ms FROM events)"""


def region_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one document for each region, its nations as a GFM table below a page marker."""
    from ..functions.text import page_marker
    from ..operators.markdown import render_table

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    cells = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit("**"), F.col("n_name"), F.lit("**")), F.concat(F.col("n_nationkey") * 4, F.lit("%")))
    own = rows.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    text = F.concat(page_marker(F.col("r_regionkey") + 1), F.lit("\n\n# "), F.col("r_name"), F.lit("\n\n"), render_table(F.array(F.lit("Key"), F.lit("Nation"), F.lit("Share")), F.col("rows")), F.lit("\n"))
    return own.select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text"))
