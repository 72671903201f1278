"""Filters on positioned items, and the pages built from what passes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lines import line_table, ocr_lines, ordered_text, page_text, text_lines
from .paragraphs import joined

PAGE = ("doc_id", "page")


def text_items(items: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Text and form fields that are not blank; the page set, if any, reaches the scan as a filter."""
    own = items if pages is None else items.filter(F.col("page").isin(pages))
    return own.filter(F.col("item_type").isin("Text", "FormField") & ~X.blank(F.col("text")))


def table_elements(items: DataFrame, origins: DataFrame | None = None, keys=PAGE) -> DataFrame:
    """Elements for drawn tables, blank ones included, shifted to their page's own origin (page_x, page_y)."""
    own = items.filter(F.col("item_type").isin("Text", "FormField")).select(*keys, "item_no", "text", "x", "y", "width", "font_size")
    if origins is None:
        return own
    shifted = own.join(origins.select(*keys, "page_x", "page_y"), list(keys), "left")
    zero = F.lit(0.0)
    return shifted.withColumns({"x": F.col("x") - F.coalesce("page_x", zero), "y": F.col("y") - F.coalesce("page_y", zero)}).drop("page_x", "page_y")


def image_boxes(items: DataFrame, keys=PAGE) -> DataFrame:
    """Boxes of images that have area; an image's height stands in its font size."""
    return items.filter((F.col("item_type") == "Image") & (F.col("width") > 0) & (F.col("font_size") > 0)).select(*keys, "item_no", "x", "y", "width", F.col("font_size").alias("height"))


def page_images(pages: DataFrame, images: DataFrame, keys=PAGE) -> DataFrame:
    """Pages with their rendered image, the last one of several; ``images``: keys, seq, image, render_scale."""
    last = images.groupBy(*keys).agg(F.max_by(F.struct("image", "render_scale"), "seq").alias("i"))
    return pages.join(last, list(keys), "left").select(*pages.columns, "i.image", "i.render_scale")


def rebuild_text_pages(pages: DataFrame, items: DataFrame, separator: str = " ", keys=PAGE) -> DataFrame:
    """Pages with markdown and line geometry built anew from items; pages with tables, that need recognition or have no
    items stay as they are."""
    built = page_text(line_table(text_lines(text_items(items), keys), keys, separator), keys).withColumnsRenamed({"markdown": "_m", "line_meta": "_g"})
    rows = pages.join(built, list(keys), "left")
    use = F.col("_m").isNotNull() & ~F.coalesce("needs_ocr", F.lit(False)) & ~F.coalesce("has_table", F.lit(False))
    return rows.withColumn("markdown", F.when(use, F.col("_m")).otherwise(F.col("markdown"))).withColumn("line_meta", F.when(use, F.col("_g"))).drop("_m", "_g")


def ocr_page_text(blocks: DataFrame, separator: str = " ", mode: str = "smart", clean: bool = True, keys=PAGE) -> DataFrame:
    """(keys, markdown, error): recognised blocks as lines, cleaned and joined to paragraphs; blank pages get an error.

    Geometry of a line for joining: y falls downwards from the top, so the line before has the larger one.
    """
    lines = ocr_lines(blocks.filter(~X.blank(F.col("text"))), keys).groupBy(*keys, "line_no").agg(
        ordered_text(F.col("text"), F.col("left"), F.col("block_no"), sep=separator).alias("t"),
        F.struct((-(F.min("top") + F.max("height") / 2)).alias("y"), F.greatest(F.max("height"), F.lit(1.0)).alias("font_size"), F.min("left").alias("x0"), F.max(F.col("left") + F.col("width")).alias("x1")).alias("m"),
    )
    rows = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "t", "m"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["t"]), "\n")
    text = X.clean_ocr(text) if clean else text
    found = rows.select(*keys, X.utrim(joined(text, F.transform("s", lambda x: x["m"]), mode)).alias("markdown"))
    every = blocks.select(*keys).distinct().join(found, list(keys), "left")
    return every.select(*keys, F.coalesce("markdown", F.lit("")).alias("markdown"), F.when(F.coalesce("markdown", F.lit("")) == "", "no text recognised").alias("error"))


def still_to_recognise(pages: DataFrame, results: DataFrame, keys=PAGE) -> DataFrame:
    """Pages without text after the text pass that no result covers yet."""
    return pages.filter(X.blank(F.col("markdown"))).join(results.select(*keys).distinct(), list(keys), "left_anti")


def batches(pages: DataFrame, size: int = 6, keys=PAGE) -> DataFrame:
    """Pages dealt into rounds of ``size`` a document, in page order."""
    from pyspark.sql import window as W

    return pages.withColumn("round", F.floor((F.row_number().over(W.Window.partitionBy(keys[0]).orderBy(*keys[1:])) - 1) / size).cast("int"))
