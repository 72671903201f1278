"""Visual lines into paragraphs.

Whether a line continues the one before is decided from geometry where a page has it, else from the text. By geometry,
two lines decide, so paragraphs are runs between breaks. The textual rule looks at the paragraph as joined so far, so
there joining is a fold over a page's lines, which keeps the open paragraph alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import indices, runs, scan
from .lines import is_table_page, upper_median

COLUMN_INDENT = 3.5


def textual_break(prev: Column, cur: Column, median: Column) -> Column:
    """Hard break by text alone: sentence end, indent, block marker, colon, or a short line before."""
    short = (median > 0) & (F.length(X.rtrim(prev)) * 2 < median)
    return X.ends_sentence(prev) | cur.startswith("  ") | cur.startswith("　") | X.starts_block(cur) | X.rtrim(prev).rlike("[:：]$") | short


def geometric_break(prev: Column, cur: Column, a: Column, b: Column, left: Column, width: Column, columns: Column) -> Column:
    """Hard break by geometry; the first rule that applies decides. a, b: geometry of the line before and this one."""
    indent_a, indent_b = a["x0"] - left, b["x0"] - left
    flush = indent_b < b["font_size"] * 0.5
    return (
        F.when(X.dehyphenates(prev, cur), False)
        .when(a["y"] - b["y"] > a["font_size"] * 1.2 * 1.5, True)
        .when(F.abs(b["font_size"] - a["font_size"]) > 0.5, True)
        .when((indent_b >= b["font_size"] * COLUMN_INDENT) & (b["x0"] <= a["x1"] + b["font_size"] * 0.5), False)
        .when(columns & flush, True)
        .when((indent_b > b["font_size"] * 1.5) & (indent_a < a["font_size"] * 0.5), True)
        .when((a["x1"] - left < width * 0.6) & flush, True)
        .otherwise(X.starts_block(cur))
    )


def _page_of(own: Column, meta: Column) -> Column:
    """What the rules ask of a page: median length, left edge, width of at least 1, and whether lines stand in columns."""
    pairs = F.sequence(F.lit(1), F.greatest(F.size(meta) - 1, F.lit(1)))
    wrapped = lambda i, left: (F.get(meta, i)["x0"] - left >= F.get(meta, i)["font_size"] * COLUMN_INDENT) & (F.get(meta, i)["x0"] <= F.get(meta, i - 1)["x1"] + F.get(meta, i)["font_size"] * 0.5)
    return X.let(F.array_min(F.transform(meta, lambda m: m["x0"])), lambda left: F.struct(
        upper_median(F.transform(F.filter(own, lambda x: ~X.blank(x)), lambda x: F.length(X.utrim(x)))).alias("median"),
        left.alias("left"),
        F.greatest(F.array_max(F.transform(meta, lambda m: m["x1"])) - left, F.lit(1.0)).alias("width"),
        F.coalesce(F.exists(pairs, lambda i: wrapped(i, left)), F.lit(False)).alias("columns"),
    ))


def _by_neighbours(own: Column, meta: Column | None) -> Column:
    """Lines joined where each break follows from two lines alone: by their geometry, or with none only where they must.

    A paragraph is a run of lines, and its text their pieces with what stands between each two; nothing is folded.
    """
    lines = F.transform(own, lambda x: F.struct(x.alias("line"), X.utrim(x).alias("t")))

    def with_fences(s: Column, page: Column | None) -> Column:
        items = s["items"]
        fences = F.filter(indices(items), lambda i: X.is_fence(F.get(items, i)["t"]))

        def starts(i: Column, fences: Column) -> Column:
            cur, prev = F.get(items, i), F.get(items, i - 1)
            code = F.size(F.filter(fences, lambda f: f <= i)) % 2 == 1
            apart = (cur["t"] == "") | (prev["t"] == "") | code | X.is_fence(cur["t"]) | X.is_fence(prev["t"]) | cur["t"].startswith("|") | prev["t"].startswith("|")
            if meta is None:
                return apart
            hard = geometric_break(prev["t"], cur["line"], F.get(meta, i - 1), F.get(meta, i), page["left"], page["width"], page["columns"])
            return apart | F.coalesce(hard, F.lit(False))

        return X.let(fences, lambda f: F.array_join(F.transform(runs(items, lambda i: starts(i, f)), _paragraph), "\n"))

    held = F.struct(lines.alias("items"))
    if meta is None:
        return X.let(held, lambda s: with_fences(s, None))
    return X.let(held, lambda s: X.let(_page_of(own, meta), lambda page: with_fences(s, page)))


def _paragraph(run: Column) -> Column:
    """The text of a run of lines: a hyphen at a break goes, else a connector stands between."""
    n = F.size(run)

    def piece(x: Column, k: Column) -> Column:
        after = F.get(run, k + 1)
        hyphen = X.dehyphenates(x["t"], after["t"])
        inner = F.when(hyphen, F.regexp_replace(x["t"], "-$", "")).otherwise(F.concat(x["t"], X.connector(x["t"], after["t"])))
        return F.when(k < n - 1, inner).otherwise(X.ltrim(x["line"]))

    return F.when(n == 1, F.get(run, F.lit(0))["line"]).otherwise(F.array_join(F.transform(run, piece), ""))


def _by_text(own: Column, meta: Column, mode: Column) -> Column:
    """Lines joined by the textual rule, which looks at the paragraph as joined so far; by geometry where two lines have it."""

    def step(state: Column, x: Column, page: Column) -> Column:
        seen = F.struct(X.utrim(F.coalesce(state["cur"], F.lit(""))).alias("prev"), X.is_fence(x["t"]).alias("fence"))
        return X.let(seen, lambda s: moved(state, x, page, s["prev"], s["fence"]))

    def moved(state: Column, x: Column, page: Column, prev: Column, fence_line: Column) -> Column:
        cur = x["line"]
        code = state["code"] != fence_line
        apart = state["cur"].isNull() | (x["t"] == "") | code | (prev == "") | fence_line | X.is_fence(prev) | x["t"].startswith("|") | prev.startswith("|")
        a, b = F.get(meta, x["i"] - 1), F.get(meta, x["i"])
        by_text = textual_break(prev, cur, page["median"])
        hard = F.when(mode == "none", False).when(a.isNotNull() & b.isNotNull(), geometric_break(prev, cur, a, b, page["left"], page["width"], page["columns"])).otherwise(by_text)
        joined_up = F.when(apart | hard, F.struct(F.lit(True).alias("new"), cur.alias("cur"))).otherwise(F.struct(F.lit(False).alias("new"), X.join_pieces(prev, cur).alias("cur")))
        return X.let(joined_up, lambda j: F.struct(F.struct(j["cur"].alias("cur"), code.alias("code")).alias("state"), F.when(j["new"], state["cur"]).alias("value")))

    items = F.transform(own, lambda x, i: F.struct(x.alias("line"), i.alias("i"), X.utrim(x).alias("t")))
    zero = F.struct(F.lit(None).cast("string").alias("cur"), F.lit(False).alias("code"))
    rest = lambda state: F.when(state["cur"].isNotNull(), F.array(state["cur"])).otherwise(F.array().cast("array<string>"))
    return X.let(_page_of(own, meta), lambda page: F.array_join(scan(items, zero, lambda s, x: step(s, x, page), "string", rest), "\n"))


def joined(markdown: Column, meta: Column | None, mode: str, all_have_geometry: bool = False) -> Column:
    """A page's text with its visual lines joined. ``meta``: array of (y, font_size, x0, x1) by line, or null.

    With ``all_have_geometry`` (every line of every page has its own) and in the mode ``none`` no fold is needed.
    """
    if mode == "guided":
        return markdown
    if mode == "none":
        body = lambda own: _by_neighbours(own, None)
    elif all_have_geometry:
        body = lambda own: _by_neighbours(own, meta)
    else:
        none = F.lit(None).cast("array<struct<y:double,font_size:double,x0:double,x1:double>>")
        whole = lambda own: (F.size(meta) == F.size(own)) & ~F.exists(meta, lambda m: m.isNull())
        folded = lambda own: _by_text(own, none if meta is None else meta, F.lit(mode))
        body = folded if meta is None else lambda own: F.when(F.coalesce(whole(own), F.lit(False)), _by_neighbours(own, meta)).otherwise(folded(own))
    return X.let(X.lines(markdown), lambda own: F.when((F.size(own) <= 1) | is_table_page(own), markdown).otherwise(body(own)))


def join_pages(pages: DataFrame, mode: str = "guided", has_meta: bool = True, all_have_geometry: bool = False) -> DataFrame:
    """Pages with ``markdown`` joined by ``mode`` (guided, smart or none). Pages with tables or columns stay as they are."""
    meta = F.col("line_meta") if has_meta else None
    keep = F.lit(False)
    for c in ("has_table", "has_columns"):
        if c in pages.columns:
            keep = keep | F.coalesce(F.col(c), F.lit(False))
    return pages.withColumn("markdown", F.when(keep, F.col("markdown")).otherwise(joined(F.col("markdown"), meta, mode, all_have_geometry)))


def join_text(docs: DataFrame, mode: str = "smart", text_col: str = "text") -> DataFrame:
    """Documents whose text is joined by the textual rule."""
    return join_pages(docs.withColumnRenamed(text_col, "markdown"), mode, has_meta=False).withColumnRenamed("markdown", text_col)
