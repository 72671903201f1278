"""Regions whose content is left out of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.arrays import runs


def rects_for_page(spec_pages: Column, use_for_all: Column, page: Column) -> Column:
    """The boxes that hold for a page: its own entry, even an empty one, or else the first page's that has any, if they
    are meant for all pages; clipped to the page."""
    own = F.get(F.filter(spec_pages, lambda p: p["page"] == page), F.lit(0))
    template = F.get(F.filter(spec_pages, lambda p: F.size(p["rects"]) > 0), F.lit(0))
    entry = F.when(own.isNotNull(), own).when(F.coalesce(use_for_all, F.lit(False)), template)
    none = F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")
    return F.coalesce(G.clamp_rects(entry["rects"], entry["page_width"], entry["page_height"]), none)


def page_filters(spec: DataFrame, page_counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page, rects): boxes in absolute coordinates of every page that has any.

    ``spec``: id, pages, use_for_all_pages, total_pages; ``page_counts``: id, page_count.
    """
    last = F.greatest(F.coalesce("total_pages", "page_count"), F.col("page_count"))
    rows = spec.join(page_counts, id_col).filter(F.size("pages") > 0)
    rows = rows.withColumn("page", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last.cast("int")))))
    own = F.get(F.filter("pages", lambda p: p["page"] == F.col("page")), F.lit(0))
    origin = F.coalesce(own, F.get(F.filter("pages", lambda p: F.size(p["rects"]) > 0), F.lit(0)))
    shift = lambda r: F.struct((r["x"] + F.coalesce(origin["page_x"], F.lit(0.0))).alias("x"), (r["y"] + F.coalesce(origin["page_y"], F.lit(0.0))).alias("y"), r["width"].alias("width"), r["height"].alias("height"))
    rects = F.transform(rects_for_page(F.col("pages"), F.col("use_for_all_pages"), F.col("page")), shift)
    return rows.select(id_col, "page", rects.alias("rects")).filter(F.size("rects") > 0)


def hits_box(rects: Column, left: Column, bottom: Column, width: Column, height: Column) -> Column:
    box = F.struct(left.alias("x"), bottom.alias("y"), width.alias("width"), height.alias("height"))
    return F.exists(rects, lambda r: G.overlaps(box, r))


def split_outside(rects: Column, left: Column, bottom: Column, width: Column, height: Column, text: Column, strict_reference: bool = False) -> Column:
    """Array of (x, width, text): runs of characters outside the boxes, blank ones left out.

    A character is inside a box that it overlaps. With ``strict_reference`` only x counts once the whole box hits
    anything, so boxes above or below cut too; and text without length or width is dropped even where nothing hits.
    """
    n = F.length(text)
    advance = width / n
    counted = rects if strict_reference else F.filter(rects, lambda r: (bottom < r["y"] + r["height"]) & (r["y"] < bottom + height))
    inside = lambda i, own: F.exists(own, lambda r: (left + i * advance < r["x"] + r["width"]) & (left + (i + 1) * advance > r["x"]))
    kept = X.let(counted, lambda own: F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~inside(i, own)))
    # Runs of kept characters: cut before each that does not follow the one before it.
    found = X.let(kept, lambda own: runs(own, lambda k: F.get(own, k) != F.get(own, k - 1) + 1))
    pieces = F.transform(found, lambda r: F.struct((left + F.get(r, F.lit(0)) * advance).alias("x"), (F.size(r) * advance).alias("width"), F.substr(text, F.get(r, F.lit(0)) + 1, F.size(r)).alias("text")))
    pieces = F.filter(pieces, lambda p: ~X.blank(p["text"]))
    whole = F.array(F.struct(left.alias("x"), width.alias("width"), text.alias("text")))
    none = F.slice(whole, 1, 0)
    missed = ~hits_box(rects, left, bottom, width, height)
    if strict_reference:
        return F.when((n == 0) | (width <= 0), none).when(missed, whole).otherwise(pieces)
    return F.when(missed, whole).when((n == 0) | (width <= 0), none).otherwise(pieces)


def exclude_items(items: DataFrame, filters: DataFrame, keys=("doc_id", "page"), strict_reference: bool = False) -> DataFrame:
    """Items without what lies in their page's boxes; an item that is hit is cut into the runs outside.

    Joins on document and page, never on geometry: a page's boxes are one array. Adds ``part_no``, the order of an
    item's pieces.
    """
    rows = items.join(filters, list(keys), "left")
    height = F.greatest("height", "font_size")
    hit = F.coalesce(hits_box(F.col("rects"), F.col("x"), F.col("y"), F.col("width"), height), F.lit(False))
    whole = F.array(F.struct(F.col("x"), F.col("width"), F.col("text")))
    pieces = F.when(hit, split_outside(F.col("rects"), F.col("x"), F.col("y"), F.col("width"), height, F.col("text"), strict_reference)).otherwise(whole)
    rows = rows.select("*", F.posexplode(pieces).alias("part_no", "_p"))
    return rows.withColumns({"x": F.col("_p.x"), "width": F.col("_p.width"), "text": F.col("_p.text")}).drop("_p", "rects")


def rebuild_pages(pages: DataFrame, items: DataFrame, filters: DataFrame, separator: str = " ", keys=("doc_id", "page")) -> DataFrame:
    """Pages with their markdown built anew, without excluded content, where they have boxes.

    Table pages become one table, others lines, with the geometry of those lines (``line_meta``; a table has none). Pages
    that need recognition and pages without boxes stay as they are, their geometry too.
    """
    from .lines import gfm_page, line_table, page_text, text_lines

    usable = items.filter(F.col("item_type").isin("Text", "FormField") & ~X.blank(F.col("text")))
    kept = exclude_items(usable.join(filters.select(*keys), list(keys), "left_semi"), filters, keys)
    kept = kept.withColumn("item_no", F.col("item_no") * 10_000 + F.col("part_no"))
    lines = line_table(text_lines(kept, keys), keys, separator)
    table = gfm_page(lines, keys).withColumnRenamed("markdown", "as_table")
    plain = page_text(lines, keys).select(*keys, F.col("markdown").alias("as_lines"), F.col("line_meta").alias("_fresh"))
    rows = pages.join(filters.select(*keys, F.lit(True).alias("_cut")), list(keys), "left").join(table, list(keys), "left").join(plain, list(keys), "left")
    tabular = F.coalesce(F.col("has_table"), F.lit(False)) if "has_table" in pages.columns else F.lit(False)
    new = F.coalesce(F.when(tabular, F.col("as_table")).otherwise(F.col("as_lines")), F.lit(""))
    changed = F.coalesce(F.col("_cut"), F.lit(False)) & ~F.coalesce("needs_ocr", F.lit(False))
    old = F.col("line_meta") if "line_meta" in pages.columns else F.lit(None)
    rows = rows.withColumn("line_meta", F.when(changed, F.when(~tabular, F.col("_fresh"))).otherwise(old))
    return rows.withColumn("markdown", F.when(changed, new).otherwise(F.col("markdown"))).drop("_cut", "as_table", "as_lines", "_fresh")


def count_rects(spec: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return spec.select(id_col, F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["rects"])).alias("rects"))


def with_page_rects(spec_pages: Column, entry: Column) -> Column:
    """The specification's pages with one page's boxes replaced, or its entry dropped where it has none left."""
    others = F.filter(spec_pages, lambda p: p["page"] != entry["page"])
    return F.array_sort(F.when(F.size(entry["rects"]) > 0, F.concat(others, F.array(entry))).otherwise(others))
