"""Tables from drawn lines: columns by vertical lines, rows by text, by horizontal bands, or by boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as G
from ..functions import text as X
from ..functions.arrays import runs, scan
from . import exclusion
from .lines import anchored_numbers, image_table_lines, table_lines

PAGE = ("doc_id", "page")
#: Fixed value: what stands between a document and the tables drawn on it.
DRAWN = "\n\n---\n\n<!-- Draw lines to extract tables -->\n\n"
#: Line gaps above so many times the font size separate records.
ROW_GAP = 2.5


def column_bounds(lines: Column, width: Column) -> Column:
    """Ascending, distinct column bounds with 0 and the page width put around them."""
    return F.concat(F.array(F.lit(0.0)), F.array_sort(F.array_distinct(lines)), F.array(width))


def row_bounds(lines: Column, height: Column) -> Column:
    """Row bounds from the top of the page (height) down to 0."""
    return F.concat(F.array(height), F.reverse(F.array_sort(F.array_distinct(lines))), F.array(F.lit(0.0)))


def cut_line(items: Column, bounds: Column, strict_reference: bool = False) -> Column:
    """Cells of a line (array of (text, x, width) in order): each character falls where its centre lies.

    With ``strict_reference`` a character on a bound, within 1e-6, falls into both columns; otherwise to the right one.
    """
    slack = 1e-6
    at = lambda e, k: e["x"] + (k + 0.5) * e["width"] / F.length(e["text"])

    def cell(k: Column) -> Column:
        left, right = F.get(bounds, k), F.get(bounds, k + 1)
        last = k == F.size(bounds) - 2
        high = right + slack if strict_reference else F.when(last, right + slack).otherwise(right - slack)
        return X.let(F.struct((left - slack).alias("low"), high.alias("high")), lambda b: X.utrim(F.array_join(F.transform(items, lambda e: part(e, b)), "")))

    def part(e: Column, b: Column) -> Column:
        # Characters lie from left to right: those of most items are all in the cell or all out of it.
        first, final = at(e, F.lit(0)), at(e, F.length(e["text"]) - 1)
        chars = F.filter(F.split(e["text"], ""), lambda c: c != "")
        one = F.array_join(F.filter(chars, lambda c, i: (at(e, i) >= b["low"]) & (at(e, i) < b["high"])), "")
        ahead = (F.length(e["text"]) > 0) & (e["width"] >= 0)
        return F.when(ahead & (first >= b["low"]) & (final < b["high"]), e["text"]).when(ahead & ((final < b["low"]) | (first >= b["high"])), "").otherwise(one)

    return F.when(F.size(bounds) > 1, F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), cell))


def first_column(cells: Column) -> Column:
    """Number (from 0) of the first cell with text, else null."""
    k = F.array_position(F.transform(cells, lambda c: ~X.blank(c)), True)
    return F.when(k > 0, (k - 1).cast("int"))


def fold_continuations(rows: Column) -> Column:
    """Array of cell arrays: wrapped remainders of cells joined to the record above.

    rows: array of (y, font_size, cells) from the top. A row continues the record above if the gap is not wide, and it
    starts further right than the row before, in a column that has text above it, or in the same column as a row that
    itself continued. Rows without text are passed over.
    """
    kind = "struct<y:double,font_size:double,cells:array<string>,col:int,on:boolean>"

    def step(last: Column, r: Column) -> Column:
        col = r["col"]
        wide = last["y"] - r["y"] > last["font_size"] * ROW_GAP
        right = (last["col"] < col) & ~X.blank(F.get(last["cells"], col))
        on = F.coalesce(last.isNotNull() & ~wide & (col > 0) & (right | ((last["col"] == col) & last["on"])), F.lit(False))
        cells = F.transform(last["cells"], lambda c, i: F.when(X.blank(F.coalesce(F.get(r["cells"], i), F.lit(""))), c).otherwise(X.join_fragments(F.array(c, F.get(r["cells"], i)))))
        record = lambda size, own, on: F.struct(r["y"].alias("y"), size.alias("font_size"), own.alias("cells"), col.alias("col"), F.lit(on).alias("on"))

        def move(goes_on: Column) -> Column:
            state = F.when(col.isNull(), last).when(goes_on, record(last["font_size"], cells, True)).otherwise(record(r["font_size"], r["cells"], False))
            return F.struct(state.alias("state"), F.when(col.isNotNull() & ~goes_on & last.isNotNull(), last["cells"]).alias("value"))

        return X.let(on, move)

    ended = lambda last: F.when(last.isNotNull(), F.array(last["cells"])).otherwise(F.array().cast("array<array<string>>"))
    placed = F.transform(rows, lambda r: F.struct(r["y"].alias("y"), r["font_size"].alias("font_size"), r["cells"].alias("cells"), first_column(r["cells"]).alias("col")))
    return scan(placed, F.lit(None).cast(kind), step, "array<string>", ended)


def guided_records(rows: Column, merge_cols: Column) -> Column:
    """Array of cell arrays: rows gathered into records, the chosen columns joined, of others the first cell with text.

    A record starts at each of the first two rows, at text in the first column and after a wide gap. Without chosen
    columns every row stays.
    """
    def starts(i: Column) -> Column:
        row, before = F.get(rows, i), F.get(rows, i - 1)
        return (i <= 1) | (F.coalesce(first_column(row["cells"]), F.lit(-1)) == 0) | (before["y"] - row["y"] > before["font_size"] * ROW_GAP)

    groups = runs(rows, starts)

    def merge(group: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(F.get(group, F.lit(0))["cells"]) - 1)
        filled = lambda c: F.filter(F.transform(group, lambda r: X.utrim(F.coalesce(F.get(r["cells"], c), F.lit("")))), lambda x: x != "")
        return F.transform(at, lambda c: X.let(filled(c), lambda own: F.when(F.array_contains(merge_cols, c), X.join_fragments(own)).otherwise(F.coalesce(F.get(own, F.lit(0)), F.lit("")))))

    return F.when(F.size(merge_cols) == 0, F.transform(rows, lambda r: r["cells"])).otherwise(F.transform(groups, merge))


def _lines_of(lines: DataFrame, keys, more: list[str], y: Column, size: Column) -> DataFrame:
    """(keys, line_no, items, y, font_size): one row a line, items in reading order."""
    return lines.groupBy(*keys, *more, "line_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "x", "width"))), lambda s: F.struct(s["text"].alias("text"), s["x"].alias("x"), s["width"].alias("width"))).alias("items"),
        F.max(y).alias("y"), F.max(size).alias("font_size"),
    )


def _page_lines(elements: DataFrame, keys, *carried: str) -> DataFrame:
    """(keys, lines, carried): one row a page, its lines as an array of (y, font_size, items) from the top.

    The same lines as ``table_lines`` gives; they stay in their page's row, so that items are grouped once.
    """
    item = F.struct((-F.col("y")).alias("o"), F.col("x").alias("x"), F.col("item_no").alias("no"), F.col("y").alias("at"), F.col("font_size").cast("double").alias("size"), F.col("text").alias("text"), F.col("width").alias("width"))
    pages = elements.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s"), *[F.any_value(c).alias(c) for c in carried])
    pages = pages.withColumn("_n", anchored_numbers(F.transform("_s", lambda x: F.struct(x["at"].cast("double").alias("at"), x["size"].alias("size"))), "table"))
    found = runs(F.col("_s"), lambda i: F.get("_n", i) != F.get("_n", i - 1))
    line = lambda own: F.struct(F.array_max(F.transform(own, lambda x: x["at"])).alias("y"), F.array_max(F.transform(own, lambda x: x["size"])).alias("font_size"), F.transform(own, lambda x: F.struct(x["text"].alias("text"), x["x"].alias("x"), x["width"].alias("width"))).alias("items"))
    return pages.select(*keys, F.transform(found, line).alias("lines"), *carried)


def _as_table(rows: DataFrame, keys, grid: Column) -> DataFrame:
    of = lambda own: F.struct(F.coalesce(F.get(own, F.lit(0)), F.array().cast("array<string>")).alias("columns"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))).alias("rows"))
    # A fold's result is taken apart by a row of its own, so that no fold is worked out twice.
    found = rows.select(*keys, F.explode(F.transform(F.array(grid), of)).alias("_t"))
    return found.select(*keys, "_t.columns", "_t.rows").filter(F.size("columns") > 0)


def vertical_tables(elements: DataFrame, draw: DataFrame, mode: str = "smart", keys=PAGE) -> DataFrame:
    """(keys, columns, rows): columns by drawn vertical lines, a row for each text line, wrapped cells folded back.

    ``draw``: keys, v_lines, page_width, merge_cols.
    """
    plan = draw.select(*keys, column_bounds(F.col("v_lines"), F.col("page_width")).alias("bounds"), F.coalesce("merge_cols", F.array().cast("array<int>")).alias("merge_cols"))
    pages = _page_lines(elements, keys).join(plan, list(keys))
    cut = F.transform("lines", lambda r: F.struct(r["y"].alias("y"), r["font_size"].alias("font_size"), cut_line(r["items"], F.col("bounds")).alias("cells")))
    return _as_table(pages, keys, X.let(cut, lambda rows: guided_records(rows, F.col("merge_cols")) if mode == "guided" else fold_continuations(rows)))


def grid_tables(elements: DataFrame, draw: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, columns, rows): rows by horizontal bands, columns by vertical lines; the top band is the header.

    An element belongs to the band of its vertical centre; pieces of a cell over several lines are joined. ``draw``:
    keys, v_lines, h_lines, page_width, page_height.
    """
    plan = draw.select(*keys, column_bounds(F.col("v_lines"), F.col("page_width")).alias("bounds"), F.reverse(row_bounds(F.col("h_lines"), F.col("page_height"))).alias("bands"))
    own = elements.join(plan, list(keys))
    band = G.band_of(F.col("bands"), F.col("y") + F.col("font_size") / 2)
    own = own.withColumn("band", F.size("bands") - 2 - band).filter("band IS NOT NULL").drop("bands")
    bands = _page_lines(own, (*keys, "band"), "bounds").withColumn("g", F.transform("lines", lambda r: cut_line(r["items"], F.col("bounds"))))
    merged = bands.withColumn("cells", F.transform(F.get("g", F.lit(0)), lambda _, c: X.join_fragments(F.transform("g", lambda line: F.get(line, c)))))
    by_band = merged.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("band", "cells"))).alias("m"))
    pages = plan.join(by_band, list(keys))
    empty = F.array_repeat(F.lit(""), F.size("bounds") - 1)
    return _as_table(pages, keys, F.transform(F.sequence(F.lit(0), F.size("bands") - 2), lambda b: F.coalesce(F.element_at("m", b), empty)))


def rectangle_tables(elements: DataFrame, draw: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, rect_no, columns, rows): one table for each drawn box, from the elements that it overlaps.

    The first line says how many columns there are. One: each line is a cell, its items joined by spaces; else each
    item is a cell, rows cut or padded.
    """
    boxes = draw.select(*keys, F.posexplode("rects").alias("rect_no", "r"))
    box = F.struct(F.col("x"), F.col("y"), F.col("width"), F.col("font_size").alias("height"))
    own = elements.join(boxes, list(keys)).filter(G.overlaps(box, F.col("r")) & ~X.blank(F.col("text"))).drop("r")
    lines = _lines_of(table_lines(own, (*keys, "rect_no")), (*keys, "rect_no"), [], F.col("y"), F.col("font_size"))
    tables = lines.groupBy(*keys, "rect_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "items"))), lambda x: F.transform(x["items"], lambda i: X.utrim(i["text"]))).alias("g"))
    n = F.size(F.get("g", F.lit(0)))
    one = F.transform("g", lambda r: F.array(F.array_join(r, " ")))
    many = F.transform("g", lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    return _as_table(tables, (*keys, "rect_no"), F.when(n == 1, one).otherwise(many))


def image_tables(blocks: DataFrame, draw: DataFrame, mode: str = "smart", keys=PAGE, separator: str = "") -> DataFrame:
    """(keys, columns, rows) from recognised blocks; lines in percent of the image. Whole blocks fall by their centre.

    ``draw``: keys, v_percents, h_percents, width_px, height_px, merge_cols. With horizontal lines rows are bands, else
    text lines.
    """
    sides = lambda p, size: F.transform(F.array_sort(p), lambda x: x / 100.0 * size)
    cols = F.concat(F.array(F.lit(0.0)), sides(F.col("v_percents"), F.col("width_px")), F.array(F.col("width_px").cast("double")))
    inner = F.array_distinct(F.filter(sides(F.col("h_percents"), F.col("height_px")), lambda y: (y > 0) & (y < F.col("height_px"))))
    plan = draw.select(*keys, cols.alias("bounds"), F.concat(F.array(F.lit(0.0)), inner, F.array(F.col("height_px").cast("double"))).alias("bands"), (F.size("h_percents") > 0).alias("banded"), F.coalesce("merge_cols", F.array().cast("array<int>")).alias("merge_cols"))
    own = blocks.join(plan, list(keys))
    own = own.withColumn("band", F.when(F.col("banded"), G.band_of(F.col("bands"), F.col("top") + F.col("height") / 2)).otherwise(0))
    own = own.filter("band IS NOT NULL").withColumn("col", G.band_of(F.transform("bounds", lambda b: b - 1e-3), F.col("left") + F.col("width") / 2))
    lines = image_table_lines(own, (*keys, "band"))
    cells = lines.filter("col IS NOT NULL").groupBy(*keys, "band", "line_no", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), separator).alias("text"), F.max(-F.col("top")).alias("y"), F.max("height").alias("size"))
    rows = cells.groupBy(*keys, "band", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("y").alias("y"), F.max("size").alias("font_size"))
    rows = rows.join(plan, list(keys)).withColumn("cells", F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda c: X.utrim(F.coalesce(F.element_at("m", c), F.lit("")))))
    pages = rows.groupBy(*keys).agg(F.any_value("banded").alias("banded"), F.any_value("merge_cols").alias("merge_cols"), F.any_value("bands").alias("bands"), F.any_value("bounds").alias("bounds"), F.sort_array(F.collect_list(F.struct("band", "line_no", "y", "font_size", "cells"))).alias("r"))
    visual = F.transform("r", lambda r: F.struct(r["y"].alias("y"), r["font_size"].alias("font_size"), r["cells"].alias("cells")))
    folded = guided_records(visual, F.col("merge_cols")) if mode == "guided" else fold_continuations(visual)
    at = F.sequence(F.lit(0), F.size("bounds") - 2)
    banded = F.transform(F.sequence(F.lit(0), F.size("bands") - 2), lambda b: F.transform(at, lambda c: X.join_fragments(F.transform(F.filter("r", lambda r: r["band"] == b), lambda r: F.get(r["cells"], c)))))
    return _as_table(pages, keys, F.when(F.col("banded"), banded).otherwise(folded))


def expand_template(draw: DataFrame, last_page: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Draw requests for every page: of documents with ``use_for_all_pages`` the first page's lines hold for pages 1 to
    ``max_pages``, or to the last page of items or ``total_pages``."""
    end = F.coalesce("max_pages", F.greatest("last_page", F.coalesce("total_pages", F.lit(0))))
    first = draw.filter("use_for_all_pages").withColumn("_n", F.row_number().over(W.Window.partitionBy(id_col).orderBy("page"))).filter("_n = 1").drop("_n")
    spread = first.join(last_page, id_col, "left").withColumn("_end", F.coalesce(end, F.lit(0)).cast("int")).filter("_end >= 1")
    spread = spread.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("_end")))).select(*draw.columns)
    return draw.filter("NOT use_for_all_pages").unionByName(spread)


def lines_touch_image(v_lines: Column, h_lines: Column, rects: Column, images: Column) -> Column:
    """Whether drawn lines, or boxes where there are no lines, touch an image (within a point)."""
    def near(x0, x1, y0, y1):
        return F.exists(images, lambda i: (x0 <= i["x"] + i["width"] + 1) & (x1 >= i["x"] - 1) & (y0 <= i["y"] + i["height"] + 1) & (y1 >= i["y"] - 1))

    far = F.lit(1e18)
    wide = lambda a, f, other: F.coalesce(f(a), other)
    lined = near(wide(v_lines, F.array_min, -far), wide(v_lines, F.array_max, far), wide(h_lines, F.array_min, -far), wide(h_lines, F.array_max, far))
    boxed = F.exists(rects, lambda r: near(r["x"], r["x"] + r["width"], r["y"], r["y"] + r["height"]))
    return F.when(F.size(v_lines) + F.size(h_lines) > 0, lined).otherwise(boxed)


def draw_tables(elements: DataFrame, draw: DataFrame, mode: str = "smart", ocr_elements: DataFrame | None = None, images: DataFrame | None = None, only_pages: list[int] | None = None, keys=PAGE, exclusions: DataFrame | None = None) -> DataFrame:
    """(keys, kind, table_no, columns, rows): every page by what is drawn on it.

    Boxes first, then lines: vertical and horizontal ones make a grid, vertical ones alone columns, horizontal ones
    alone nothing. Pages whose lines touch an image take recognised elements where there are any.

    Where ``draw`` has ``use_for_all_pages`` (null is false), the first page of such a document that has anything drawn
    holds for pages 1 to ``max_pages``, or to the last page of ``elements`` or ``total_pages``; both columns may be absent.
    ``exclusions`` (id, pages, use_for_all_pages; boxes in the coordinates of the elements) cut the elements after
    text or recognised ones are chosen, so that a page that they empty doesn't become one without text.
    """
    if "use_for_all_pages" in draw.columns:
        absent = {c: F.lit(None).cast("int") for c in ("max_pages", "total_pages") if c not in draw.columns}
        draw = draw.withColumns({"use_for_all_pages": F.coalesce("use_for_all_pages", F.lit(False)), **absent})
        draw = draw.withColumn("max_pages", F.when(F.col("max_pages") > 0, F.col("max_pages")))
        drawn = F.size("v_lines") + F.size("h_lines") + F.coalesce(F.size("rects"), F.lit(0)) > 0
        last = elements.groupBy(keys[0]).agg(F.max("page").alias("last_page"))
        draw = expand_template(draw.filter(~F.col("use_for_all_pages") | drawn), last, keys[0])
    if only_pages is not None:
        draw = draw.filter(F.col("page").isin(only_pages))
    if ocr_elements is not None and images is not None:
        by_page = images.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("images"))
        touched = draw.join(by_page, list(keys)).filter(lines_touch_image(F.col("v_lines"), F.col("h_lines"), F.col("rects"), F.col("images"))).select(*keys)
        from_ocr = ocr_elements.join(touched, list(keys), "left_semi")
        covered = from_ocr.select(*keys).distinct()
        elements = elements.join(covered, list(keys), "left_anti").unionByName(from_ocr.select(*elements.columns))
    if exclusions is not None:
        rects = exclusion.rects_for_page(F.col("pages"), F.col("use_for_all_pages"), F.col("page"))
        spec = exclusions.select(keys[0], "pages", "use_for_all_pages")
        cuts = draw.select(*keys).distinct().join(spec, keys[0]).select(*keys, rects.alias("rects")).filter(F.size("rects") > 0)
        columns = elements.columns
        # As tall as the font, whatever the item's own height.
        cut = exclusion.exclude_items(elements.withColumn("height", F.col("font_size")), cuts, keys)
        cut = cut.withColumn("item_no", F.col("item_no").cast("long") * 10_000 + F.col("part_no"))
        elements = cut.select(*[c for c in columns if c != "height"])
    boxes = rectangle_tables(elements, draw.filter(F.size("rects") > 0), keys).select(*keys, F.lit("rectangle").alias("kind"), "rect_no", "columns", "rows")
    grid = grid_tables(elements, draw.filter((F.size("v_lines") > 0) & (F.size("h_lines") > 0)), keys)
    columns = vertical_tables(elements, draw.filter((F.size("v_lines") > 0) & (F.size("h_lines") == 0)), mode, keys)
    lined = grid.select(*keys, F.lit("grid").alias("kind"), F.lit(1 << 20).alias("rect_no"), "columns", "rows").unionByName(columns.select(*keys, F.lit("vertical").alias("kind"), F.lit(1 << 20).alias("rect_no"), "columns", "rows"))
    both = boxes.unionByName(lined)
    number = F.row_number().over(W.Window.partitionBy(keys[0]).orderBy(*keys[1:], "rect_no"))
    return both.withColumn("table_no", number).drop("rect_no")


def merge_into_markdown(docs: DataFrame, tables: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the drawn tables appended after a rule and a comment.

    Tables stand in order of ``table_no``, rules between them, below a page marker wherever the page changes. The
    document's own text is trimmed; where it is blank the tables stand alone. Documents without tables stay, null as ''.
    """
    from .markdown import render_table

    last = F.lag("page").over(W.Window.partitionBy(id_col).orderBy("table_no"))
    chunk = F.concat(
        F.when(last.isNull(), "").otherwise("\n\n---\n\n"), F.when(last == F.col("page"), "").otherwise(F.concat(X.page_marker(F.col("page")), F.lit("\n\n"))),
        render_table(F.col("columns"), F.col("rows"), pad=False, escape=False, trailing_newline=True),
    )
    parts = tables.select(F.col(id_col).alias("id"), "table_no", chunk.alias("c"))
    own = parts.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_no", "c"))), lambda x: x["c"]), "").alias("drawn"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(own, "id", "left")
    merged = F.when(F.col("drawn").isNull(), F.col("t")).when(X.blank(F.col("t")), F.col("drawn")).otherwise(F.concat(X.utrim(F.col("t")), F.lit(DRAWN), F.col("drawn")))
    return rows.select(*[merged.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def drawn_pages(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pages): how many different pages a document's tables were drawn on."""
    return tables.groupBy(id_col).agg(F.count_distinct("page").alias("pages"))


def remap_merge_columns(old: Column, new: Column, chosen: Column) -> Column:
    """Chosen columns after the bounds have changed: the column with the same left bound, else that with the old centre."""
    def one(c: Column) -> Column:
        left, right = F.get(old, c), F.get(old, c + 1)
        same = F.array_position(F.slice(new, 1, F.size(new) - 1), left).cast("int") - 1
        return F.when(same >= 0, same).otherwise(G.band_of(new, (left + right) / 2))

    return F.array_sort(F.array_distinct(F.filter(F.transform(chosen, one), lambda c: c.isNotNull())))
