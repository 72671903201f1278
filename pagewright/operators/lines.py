"""Positioned text into lines.

Two families that give different results. Anchored grouping compares each item with the first item of the open line,
which never moves, so lines come from one pass over the page's sorted items that keeps the open line alone (``scan``). Gap
grouping compares each block with the one before it, which windows express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..functions.arrays import scan

PAGE = ("doc_id", "page")


def anchored_numbers(items: Column, rule: str) -> Column:
    """Line number (from 1) of each of an array of structs (at, size) in reading order.

    ``rule``: ``text`` opens a line beyond max(0.5 of the anchor's size, 3); ``table`` from max(0.4 of the item's own
    size, 3) on. ``at`` runs downwards or upwards, only distances count.
    """
    def step(line: Column, x: Column) -> Column:
        gap = F.abs(x["at"] - line["at"])
        far = gap > F.greatest(F.greatest(line["size"], F.lit(1.0)) * 0.5, F.lit(3.0)) if rule == "text" else gap >= F.greatest(x["size"] * 0.4, F.lit(3.0))
        new = (line["n"] == 0) | far
        n = line["n"] + new.cast("int")
        state = F.struct(F.when(new, x["at"]).otherwise(line["at"]).alias("at"), F.when(new, x["size"]).otherwise(line["size"]).alias("size"), n.alias("n"))
        return F.struct(state.alias("state"), n.alias("value"))

    return scan(items, F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("size"), F.lit(0).alias("n")), step, "int")


def _grouped(items: DataFrame, keys, at: Column, cross: Column, size: Column, no: str, rule: str, down: bool) -> DataFrame:
    """Adds line_no (from 1) by an anchored fold over each page's items."""
    first = -at if down else at
    rows = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(first.alias("o"), cross.alias("c"), F.col(no).alias("no"), at.alias("at"), size.cast("double").alias("size"), F.struct(*[F.col(c) for c in items.columns]).alias("item")))).alias("s"))
    rows = rows.withColumn("n", anchored_numbers(F.transform("s", lambda x: F.struct(x["at"].cast("double").alias("at"), x["size"].alias("size"))), rule))
    rows = rows.select(F.posexplode(F.arrays_zip("s", "n")).alias("seq", "z"))
    return rows.select("z.s.item.*", F.col("z.n").alias("line_no"), "seq")


def text_lines(items: DataFrame, keys=PAGE) -> DataFrame:
    """Text-layer lines: items by y downwards, then x; ``line_no`` from 1 and ``seq``, the reading order."""
    return _grouped(items, keys, F.col("y"), F.col("x"), F.col("font_size"), "item_no", "text", True)


def table_lines(items: DataFrame, keys=PAGE) -> DataFrame:
    """Lines of drawn tables: as text lines, by the tighter rule of each item's own font."""
    return _grouped(items, keys, F.col("y"), F.col("x"), F.col("font_size"), "item_no", "table", True)


def image_table_lines(blocks: DataFrame, keys=PAGE) -> DataFrame:
    """The same for recognised blocks, top downwards."""
    return _grouped(blocks, keys, F.col("top"), F.col("left"), F.col("height"), "block_no", "table", False)


def ocr_lines(blocks: DataFrame, keys=PAGE, height: str = "height_px", share: float = 0.015) -> DataFrame:
    """Recognised lines: a new one where the top moves more than max(1.5 % of the page height, 8) from the last block."""
    order = W.Window.partitionBy(*keys).orderBy("top", "block_no")
    far = F.abs(F.col("top") - F.lag("top").over(order)) > F.greatest(F.col(height) * share, F.lit(8.0))
    return blocks.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("line_no", F.sum("_new").over(order)).drop("_new")


def grid_cells(blocks: DataFrame, keys=PAGE, height: str = "height_px", width: str = "width_px") -> DataFrame:
    """Rows as recognised lines, and in a row a new cell where the gap to the last block's right edge is wide."""
    rows = ocr_lines(blocks, keys, height)
    order = W.Window.partitionBy(*keys, "line_no").orderBy("left", "block_no")
    wide = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order) > F.greatest(F.col(width) * 0.02, F.lit(12.0))
    return rows.withColumn("_new", F.coalesce(wide, F.lit(True)).cast("int")).withColumn("cell_no", F.sum("_new").over(order)).drop("_new")


def ordered_text(value: Column, *order: Column, sep: str) -> Column:
    """Aggregate: values joined in the given order."""
    own = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.array_join(F.transform(own, lambda x: x["v"]), sep)


def line_table(lines: DataFrame, keys=PAGE, separator: str = " ", split_gaps: bool = True) -> DataFrame:
    """(keys, line_no, text, cells, y, font_size, x0, x1): text lines put together, with their geometry.

    With ``split_gaps`` the pieces between wide gaps inside an item count as items of their own.
    """
    glue = separator if separator.strip() else " "
    own = X.utrim(F.col("text"))
    parts = F.coalesce(X.column_gaps(F.col("text")), F.array(own)) if split_gaps else F.array(own)
    found = lines.groupBy(*keys, "line_no").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", parts.alias("p")))), lambda s: s["p"])).alias("cells"),
        F.max("y").alias("y"), F.greatest(F.max("font_size"), F.lit(1.0)).alias("font_size"), F.min("x").alias("x0"), F.greatest(F.max(F.col("x") + F.col("width")), F.min("x"), F.lit(0.0)).alias("x1"),
    )
    return found.withColumn("text", F.array_join("cells", glue))


def page_text(lines: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, markdown, line_meta): lines joined by newlines, and their geometry in the same order."""
    return lines.groupBy(*keys).agg(ordered_text(F.col("text"), F.col("line_no"), sep="\n").alias("markdown"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", "y", "font_size", "x0", "x1"))), lambda x: F.struct(x["y"].alias("y"), x["font_size"].alias("font_size"), x["x0"].alias("x0"), x["x1"].alias("x1"))).alias("line_meta"))


def gfm_page(lines: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, markdown): a page's lines as one table, the first line its header, short rows padded."""
    from .markdown import render_table

    rows = lines.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "cells"))), lambda x: x["cells"]).alias("g"))
    return rows.select(*keys, render_table(F.get("g", F.lit(0)), F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), pad=True, escape=False).alias("markdown"))


def page_geometry(line_meta: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, block_left, text_width, column_layout): left edge, width of at least 1, and whether any line starts far
    right of, and inside, the line before it."""
    order = W.Window.partitionBy(*keys).orderBy("line_no")
    left = F.min("x0").over(W.Window.partitionBy(*keys))
    rows = line_meta.withColumn("_left", left).withColumn("_px1", F.lag("x1").over(order))
    column = (F.col("x0") - F.col("_left") >= 3.5 * F.col("font_size")) & (F.col("x0") <= F.col("_px1") + 0.5 * F.lag("font_size").over(order))
    rows = rows.withColumn("_col", F.coalesce(column, F.lit(False)))
    return rows.groupBy(*keys).agg(F.min("x0").alias("block_left"), F.greatest(F.max("x1") - F.min("x0"), F.lit(1.0)).alias("text_width"), F.bool_or("_col").alias("column_layout"))


def upper_median(values: Column) -> Column:
    """The upper median of an array, 0 of none."""
    return X.let(F.sort_array(values), lambda own: F.coalesce(F.get(own, F.floor(F.size(own) / 2).cast("int")), F.lit(0)))


def is_table_page(lines: Column) -> Column:
    """Whether an array of lines is a table's: a delimiter-like row, or half of its lines start with a pipe."""
    def test(own: Column) -> Column:
        pipes = F.filter(own, lambda x: x.startswith("|"))
        return F.exists(pipes, lambda x: x.contains("---")) | ((F.size(own) > 0) & (2 * F.size(pipes) >= F.size(own)))

    return X.let(F.filter(F.transform(lines, X.utrim), lambda x: x != ""), test)


def is_table_like(rows: Column) -> Column:
    """Whether a grid (array of rows of cells) looks like a table: two rows or more that have two cells or more."""
    return F.size(F.filter(rows, lambda r: F.size(r) >= 2)) >= 2
