"""Page sets and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lines import ordered_text


def parse_range(spec: Column, page_count: Column) -> Column:
    """``1-5,8`` as ascending distinct pages within the document; null (all pages) if blank or without a valid page.

    Ranges may run backwards; what can't be read is passed over. Bounds are clipped before they are spread out.
    """
    # One match a part that can be read: its first number and, in a range, its second.
    part = r"(?U)(?<=\A|,)\s*\+?([0-9]{1,18})\s*(?:-\s*\+?([0-9]{1,18})\s*)?(?=,|\z)"
    numbers = lambda group: F.regexp_extract_all(spec, F.lit(part), group)
    pairs = F.zip_with(numbers(1), numbers(2), lambda a, b: F.struct(a.cast("long").alias("a"), F.when(b == "", a).otherwise(b).cast("long").alias("b")))
    pairs = F.filter(pairs, lambda p: F.greatest(p["a"], p["b"]) <= 4294967295)
    clipped = F.transform(pairs, lambda p: F.struct(F.greatest(F.least(p["a"], p["b"]), F.lit(1)).alias("low"), F.least(F.greatest(p["a"], p["b"]), page_count.cast("long")).alias("high")))
    spread = F.transform(F.filter(clipped, lambda p: p["low"] <= p["high"]), lambda p: F.sequence(p["low"], p["high"]))
    found = F.sort_array(F.array_distinct(F.flatten(spread)))
    return F.when(F.size(found) > 0, found.cast("array<int>"))


def in_range(pages: DataFrame, ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pages that their document's range (array, null for all) holds. ``ranges``: id, pages."""
    return pages.join(ranges.select(id_col, F.col("pages").alias("_want")), id_col).filter(F.col("_want").isNull() | F.array_contains("_want", F.col("page"))).drop("_want")


def ocr_pages(detected: Column, empty: Column, page_range: Column | None = None, forced: Column | None = None) -> Column:
    """Pages that need recognition: detected, empty or forced ones, within the range; ascending, each once."""
    none = F.array().cast("array<int>")
    found = F.array_union(F.coalesce(detected, none), F.coalesce(empty, none))
    if forced is not None:
        found = F.array_union(found, F.coalesce(forced, none))
    if page_range is not None:
        found = F.when(page_range.isNull(), found).otherwise(F.array_intersect(found, page_range))
    return F.array_sort(F.array_distinct(found))


def assemble(pages: DataFrame, text_col: str = "markdown", id_col: str = "doc_id") -> DataFrame:
    """(id, markdown): pages in order, each below its marker; a page without text keeps its marker."""
    chunk = F.concat(X.page_marker(F.col("page")), F.lit("\n\n"), X.utrim(F.coalesce(F.col(text_col), F.lit(""))))
    return pages.groupBy(id_col).agg(ordered_text(chunk, F.col("page"), sep="\n\n").alias("markdown"))


def hybrid(pages: DataFrame, results: DataFrame, skipped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pages with the text that wins: a skip comment, else the recognised text, else the text layer.

    ``results``: id, page, ocr_markdown (one row a page); ``skipped``: id, page, reason.
    """
    comment = F.format_string("<!-- OCR skipped (page %d): %s -->", F.col("page"), F.col("reason"))
    rows = pages.join(results.select(id_col, "page", "ocr_markdown"), [id_col, "page"], "left").join(skipped.select(id_col, "page", "reason"), [id_col, "page"], "left")
    return rows.withColumn("markdown", F.coalesce(F.when(F.col("reason").isNotNull(), comment), "ocr_markdown", X.utrim(F.col("markdown")), F.lit(""))).drop("ocr_markdown", "reason")


def latest_results(attempts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The last result of each page; ``attempts``: id, page, seq, ocr_markdown, confidence."""
    return attempts.groupBy(id_col, "page").agg(F.max_by("ocr_markdown", "seq").alias("ocr_markdown"), F.max_by("confidence", "seq").alias("confidence"))


def confidence_of_attempts(attempts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, confidence): the mean over all attempts, a page done twice counted twice."""
    return attempts.groupBy(id_col).agg(F.avg("confidence").alias("confidence"))


def detect_status(detected: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, confidence, ocr_pages): classification with empty pages added to those that need recognition."""
    empty = pages.groupBy(id_col).agg(F.collect_list(F.when(X.blank(F.col("markdown")), F.col("page"))).alias("_e"))
    return detected.join(empty, id_col, "left").select(id_col, "kind", "confidence", ocr_pages(F.col("ocr_pages"), F.col("_e")).alias("ocr_pages"))


def convert(pages: DataFrame, specs: DataFrame, mode: str = "guided", id_col: str = "doc_id", items: DataFrame | None = None, exclusions: DataFrame | None = None, separator: str = " ") -> DataFrame:
    """(id, markdown, ocr_pages, skipped_pages): the text path from page text to one document.

    ``specs``: id, page_range (text), page_count. Every page of the range is in the document, below its marker. Pages that
    need recognition, those flagged ``needs_ocr`` and those without text, are reported; nothing recognises them here, so
    they are the skipped ones too. ``exclusions`` (id, page, rects, as ``exclusion.page_filters`` gives them) take content
    away after that, so a page that they empty is not reported; the pages are built anew from ``items``. Then visual
    lines are joined to paragraphs by ``mode``.
    """
    from .exclusion import rebuild_pages
    from .paragraphs import join_pages

    want = specs.select(id_col, parse_range(F.col("page_range"), F.col("page_count")).alias("pages"))
    own = in_range(pages, want, id_col)
    open_ = F.coalesce(F.col("needs_ocr"), F.lit(False)) | X.blank(F.coalesce("markdown", F.lit("")))
    status = own.groupBy(id_col).agg(F.sort_array(F.collect_set(F.when(open_, F.col("page")))).alias("ocr_pages"))
    if exclusions is not None:
        own = rebuild_pages(own, items, exclusions, separator, (id_col, "page"))
    text = assemble(join_pages(own, mode, "line_meta" in own.columns), id_col=id_col)
    found = F.coalesce("ocr_pages", F.array().cast("array<int>"))
    return specs.select(id_col).join(text, id_col, "left").join(status, id_col, "left").select(id_col, F.coalesce("markdown", F.lit("")).alias("markdown"), found.alias("ocr_pages"), found.alias("skipped_pages"))


def merge_images(items: DataFrame, keys=("doc_id",)) -> DataFrame:
    """(keys, markdown): recognised images below ``Image N`` comments, between rules; blank ones left out after they
    are numbered. ``items``: keys, item_no, markdown."""
    from pyspark.sql import window as W

    number = F.row_number().over(W.Window.partitionBy(*keys).orderBy("item_no"))
    rows = items.withColumn("n", number).filter(~X.blank(F.regexp_replace(F.col("markdown"), r"^\s*<!--[^>]*-->", "")))
    chunk = F.concat(F.format_string("<!-- Image %d -->", F.col("n")), F.lit("\n\n"), X.utrim(F.col("markdown")))
    return rows.groupBy(*keys).agg(ordered_text(chunk, F.col("n"), sep="\n\n---\n\n").alias("markdown"))


def max_page(items: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, last_page): the largest page of items, or the stated total if that is more."""
    own = items.groupBy(id_col).agg(F.max("page").alias("m"))
    return docs.join(own, id_col, "left").select(id_col, F.greatest(F.coalesce("m", F.lit(0)), F.coalesce("total_pages", F.lit(0))).alias("last_page"))
