"""Usage statistics and merges of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters stop at the largest unsigned 32-bit number.
LARGEST = 4294967295
COUNTERS = ["file_count", "page_count", "ocr_page_count", "total_ms", "pdf_file_count", "pdf_page_count", "pdf_ocr_page_count", "image_file_count", "local_ocr_page_count", "ai_ocr_page_count"]


def counters() -> dict[str, Column]:
    """What a line of the log adds to each counter, null for nothing."""
    pdf, image = F.col("kind").isin("pdf", "drawTable"), F.col("kind").isin("image", "imageTable", "screenshot")
    return {
        "file_count": F.col("fileCount"), "page_count": F.col("pageCount"), "ocr_page_count": F.col("ocrPageCount"), "total_ms": F.col("totalMs"),
        "pdf_file_count": F.when(pdf, F.col("fileCount")), "pdf_page_count": F.when(pdf, F.col("pageCount")), "pdf_ocr_page_count": F.when(pdf, F.col("ocrPageCount")),
        "image_file_count": F.when(image, F.col("fileCount")),
        "local_ocr_page_count": F.when(F.col("engine") == "local", F.col("ocrPageCount")), "ai_ocr_page_count": F.when(F.col("engine") == "ai", F.col("ocrPageCount")),
    }


def usage_stats(log: DataFrame, today: str) -> DataFrame:
    """(period, ten counters) for total, month and today: one row each, zeros where nothing happened.

    ``log``: date (text, YYYY-MM-DD), kind, fileCount, pageCount, ocrPageCount, engine, totalMs. One pass: partial sums
    by period, which overlap, are conditional aggregates.
    """
    values = counters()
    periods = {"total": F.lit(True), "month": F.substring("date", 1, 7) == today[:7], "today": F.col("date") == today}

    def total(when: Column, name: str) -> Column:
        own = F.coalesce(F.sum(F.when(when, values[name])), F.lit(0)).cast("long")
        return own if name == "total_ms" else F.least(own, F.lit(LARGEST))

    wide = log.agg(*[total(when, c).alias(f"{p}_{c}") for p, when in periods.items() for c in COUNTERS])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), *[F.col(f"{p}_{c}").alias(c) for c in COUNTERS]) for p in periods])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def merge_results(batches: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Results of page batches as one: sums, page lists joined, confidence weighted by recognised pages (null if none)."""
    pages = F.size("ocr_pages")
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    weight = F.sum(F.when(F.col("ocr_confidence").isNotNull(), pages))
    mean = F.when(weight > 0, F.sum(F.col("ocr_confidence") * pages) / weight)
    return batches.groupBy(*keys).agg(F.sum("table_count").alias("table_count"), F.sum("total_rows").alias("total_rows"), joined("ocr_pages"), joined("empty_text_pages"), joined("image_pages"), mean.alias("ocr_confidence"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, and the sum of finished jobs' durations."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "converting", "done", "error")], F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("total_ms"))), F.lit(0)).alias("total_ms"))
