"""Markdown: lines, GFM tables, blocks, renderers, sheet layout, page chunks.

Everything is array expressions over a document's own row: it is cut into tables, code and other text by one expression, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import scan


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line): one row a line, positions from 0; empty texts have none."""
    return docs.select(F.col(id_col), F.posexplode(X.lines(F.col(text_col))).alias("pos", "line"))


#: White space within a line, what begins a fence line, and a header row with the delimiter row below it.
_WS = r"[^\S\n]*+"
_FENCE = rf"{_WS}(?:```|~~~)"
_HEAD = rf"{_WS}\|[^\n]*+\n{_WS}\|[-:| ]*-[-:| ]*\|{_WS}(?=\n|\z)"
#: After the newline that ends the piece before: a fence up to its closing line, a table, or other lines up to either.
#: Possessive, so that long texts take no stack.
PIECES = (
    rf"(?Ud)\G\n(?!\z)({_FENCE}[^\n]*+(?:\n(?!\z)(?!{_FENCE})[^\n]*+)*+(?:\n{_FENCE}[^\n]*+)?+"
    rf"|{_HEAD}(?:\n{_WS}\|[^\n]*+)*+"
    rf"|[^\n]*+(?:\n(?!\z)(?!{_FENCE})(?!{_HEAD})[^\n]*+)*+)"
)
_PIECE = "struct<pos:int,page:bigint,kind:string,piece:string>"


def pieces(text: Column) -> Column:
    """Array of a text's pieces in order: structs of pos (of the first line), page (sticky, up to the piece), kind (table,
    code or text) and piece.

    A fence marker of either kind switches code on or off; its closing line is an ordinary line again. A run of pipe lines
    outside code becomes a table from its first line that a delimiter row follows; earlier pipe lines are text, later
    delimiter rows are data. A document is taken apart in its own row: no line is shuffled or sorted.
    """
    def place(state: Column, x: Column) -> Column:
        kind = F.when(x.rlike(f"(?Umd)\\A{_FENCE}"), "code").when(x.rlike(f"(?Umd)\\A{_HEAD}"), "table").otherwise("text")
        marks = F.filter(F.transform(F.regexp_extract_all(x, F.lit(rf"(?Umd)^{_WS}<!-- [^\n]*+"), F.lit(0)), X.page_from_line), lambda n: n.isNotNull())
        last = lambda k: F.when((k == "text") & x.contains("<!-- "), F.try_element_at(marks, F.lit(-1)))
        return X.let(kind, lambda k: F.struct(
            F.struct((state["pos"] + 1 + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).alias("pos"), F.coalesce(last(k), state["page"]).alias("page")).alias("state"),
            F.struct(state["pos"].alias("pos"), state["page"].alias("page"), k.alias("kind"), x.alias("piece")).alias("value"),
        ))

    begun = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("long").alias("page"))
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), F.lit(PIECES), F.lit(1))
    return scan(found, begun, place, _PIECE)


def _is_table(piece: Column) -> Column:
    return piece["kind"] == "table"


def _height(piece: Column) -> Column:
    """Data rows of a table."""
    return F.length(piece["piece"]) - F.length(F.replace(piece["piece"], F.lit("\n"), F.lit(""))) - 1


def _plain(piece: Column) -> Column:
    """Array of (pos, line): code lines as they stand, others trimmed; no blank lines and page markers outside code."""
    def kept(own: Column) -> Column:
        code = (piece["kind"] == "code")
        rows = F.transform(own, lambda x, i: F.struct((piece["pos"] + i).alias("pos"), F.when(code & ((i == 0) | (i < F.size(own) - 1) | ~X.is_fence(x)), F.when(x.contains("\r"), F.regexp_replace(x, r"\r$", "")).otherwise(x)).otherwise(X.utrim(x)).alias("line")))
        return F.filter(rows, lambda r: code | ((r["line"] != "") & ~(r["line"].startswith("<!-- ") & X.page_from_line(r["line"]).isNotNull())))

    return X.let(F.split(piece["piece"], "\n", -1), kept)


def _cells_of(piece: Column) -> Column:
    """struct(columns, rows) of a table; short rows are padded, long ones cut."""
    def padded(lines: Column, columns: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(columns) - 1)
        rows = F.transform(F.slice(lines, 3, F.size(lines) - 2), lambda r: X.let(X.split_cells(r), lambda own: F.transform(at, lambda i: F.coalesce(F.get(own, i), F.lit("")))))
        return F.struct(columns.alias("columns"), rows.alias("rows"))

    return X.let(F.split(piece, "\n", -1), lambda lines: X.let(X.split_cells(F.get(lines, F.lit(0))), lambda columns: padded(lines, columns)))


def parse_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table_no, page, pos, columns, rows): every table of each text, in order; short rows are padded, long ones cut."""
    found = docs.select(id_col, F.posexplode(F.filter(pieces(F.col(text_col)), _is_table)).alias("_k", "_p"))
    own = found.select(id_col, (F.col("_k") + 1).alias("table_no"), "_p", _cells_of(F.col("_p.piece")).alias("_c"))
    return own.select(id_col, "table_no", F.col("_p.page").alias("page"), F.col("_p.pos").alias("pos"), "_c.columns", "_c.rows")


def parse_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_no, kind, line, page, columns, rows): tables and lines in document order.

    Code lines are kept as they stand, others trimmed; blank lines and page markers outside code are no blocks.
    """
    none = lambda kind: F.lit(None).cast(kind)
    block = lambda pos, line, page, piece: F.struct(pos.alias("pos"), line.alias("line"), page.alias("page"), piece.alias("piece"))
    every = F.flatten(F.transform(pieces(F.col(text_col)), lambda p: F.when(_is_table(p), F.array(block(p["pos"], none("string"), p["page"], p["piece"]))).otherwise(F.transform(_plain(p), lambda r: block(r["pos"], r["line"], none("long"), none("string"))))))
    found = docs.select(id_col, F.posexplode(every).alias("_k", "_b")).withColumn("_t", F.col("_b.piece").isNotNull())
    own = found.withColumn("_c", F.when(F.col("_t"), _cells_of(F.col("_b.piece"))))
    return own.select(id_col, "_b.pos", F.when(F.col("_t"), "table").otherwise("line").alias("kind"), "_b.line", "_b.page", "_c.columns", "_c.rows", (F.col("_k") + 1).alias("block_no"))


def cells(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, table_no, row_no, col_no, value): row 0 is the header."""
    grid = tables.select(id_col, "table_no", F.posexplode(F.concat(F.array("columns"), "rows")).alias("row_no", "row"))
    return grid.select(id_col, "table_no", "row_no", F.posexplode("row").alias("col_no", "value"))


def _total(every: Column, of) -> Column:
    return F.aggregate(every, F.lit(0).cast("long"), lambda n, x: n + of(x))


def analyze(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table_count, total_rows, total_lines) of every document."""
    own = X.let(F.filter(pieces(F.col(text_col)), _is_table), lambda every: F.struct(F.size(every).cast("long").alias("table_count"), _total(every, _height).alias("total_rows")))
    total = F.coalesce(F.size(F.split(F.regexp_replace(F.nullif(text_col, F.lit("")), r"\n\z", ""), "\n", -1)), F.lit(0))
    return docs.select(id_col, own.alias("_n"), F.when(F.coalesce(text_col, F.lit("")) == "", 0).otherwise(total).cast("long").alias("total_lines")).select(id_col, "_n.*", "total_lines")


def render_table(columns: Column, rows: Column, pad: bool = True, escape: bool = True, trailing_newline: bool = False, compact: bool = False) -> Column:
    """A GFM table. ``pad``: every row as wide as the widest; ``escape``: pipes in cells are escaped."""
    width = F.greatest(F.size(columns), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))) if pad else F.size(columns)
    cell = (lambda x: X.escape_cell(x)) if escape else (lambda x: x)

    def row(values: Column) -> Column:
        own = F.transform(values, cell)
        if pad:
            own = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(own, i), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(own, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.array(row(columns), rule), F.transform(rows, row)), "\n")
    return F.concat(text, F.lit("\n")) if trailing_newline else text


def sheet_cells(docs: DataFrame, tables_only: bool = True, strip: bool = True, numeric: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, col, kind, str_value, num_value, format): the worksheet of each document.

    A table takes a label row (``Page N`` or ``Table N``), a header row, its rows and a blank one; outside
    ``tables_only`` every other line takes a row of its own. Headers and labels stay as they are; other cells lose
    inline markup (``strip``) and become numbers where they look like one (``numeric``).
    """
    # Where each block begins, and how many tables there are up to it, by one pass over the document's pieces.
    kept = (lambda p: F.array().cast("array<struct<pos:int,line:string>>")) if tables_only else _plain
    one = "struct<at:bigint,no:int,page:bigint,piece:string,line:string>"

    def place(state: Column, p: Column) -> Column:
        entry = lambda at, no, page, piece, line: F.struct(at.alias("at"), no.alias("no"), page.alias("page"), piece.alias("piece"), line.alias("line"))
        none = F.lit(None).cast("string")
        of = lambda lines: F.when(_is_table(p), F.array(entry(state["at"], state["no"] + 1, p["page"], p["piece"], none))).otherwise(F.transform(lines, lambda r, i: entry(state["at"] + i, state["no"], F.lit(None).cast("long"), none, r["line"])))
        after = lambda found: F.struct((state["at"] + F.when(_is_table(p), _height(p) + 3).otherwise(F.size(found))).alias("at"), (state["no"] + _is_table(p).cast("int")).alias("no"))
        return X.let(of(kept(p)), lambda found: F.struct(after(found).alias("state"), found.alias("value")))

    begun = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("no"))
    own = pieces(F.col(text_col))
    placed = F.flatten(scan(F.filter(own, _is_table) if tables_only else own, begun, place, f"array<{one}>"))
    found = docs.select(id_col, F.explode(placed).alias("_b"))
    found = found.withColumn("_c", F.when(F.col("_b.piece").isNotNull(), _cells_of(F.col("_b.piece"))))
    blocks = found.select(id_col, F.when(F.col("_b.piece").isNotNull(), "table").otherwise("line").alias("kind"), "_b.at", "_b.no", "_b.page", "_b.line", "_c.columns", "_c.rows")
    blocks = blocks.withColumn("label", F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page"))).otherwise(F.concat(F.lit("Table "), F.col("no"))))
    stripped = (lambda c: F.when(c.rlike(r"[<\[*_`]"), X.strip_inline(c)).otherwise(c)) if strip else (lambda c: c)
    entry = lambda row, col, kind, value: F.struct(row.cast("long").alias("row"), col.cast("int").alias("col"), F.lit(kind).alias("kind"), value.alias("value"))
    header = F.transform("columns", lambda c, j: entry(F.col("at") + 1, j, "header", c))
    body = F.flatten(F.transform("rows", lambda r, i: F.transform(r, lambda c, j: entry(F.col("at") + 2 + i, j, "cell", stripped(c)))))
    table = F.concat(F.array(entry(F.col("at"), F.lit(0), "label", F.col("label"))), header, body)
    line = F.array(entry(F.col("at"), F.lit(0), "line", stripped(F.col("line"))))
    rows = blocks.select(id_col, F.explode(F.when(F.col("kind") == "table", table).otherwise(line)).alias("c")).select(id_col, "c.*")
    rows = rows.withColumn("n", F.when(F.col("kind") == "cell", X.sniff_number(F.col("value"))) if numeric else F.lit(None).cast("struct<kind:string,value:double>"))
    kind = F.when(F.col("n").isNotNull(), F.col("n.kind")).otherwise(F.when(F.col("kind") == "cell", "text").otherwise(F.col("kind")))
    look = F.when(F.col("n.kind") == "percent", "0.00%").when(F.col("kind") == "header", "header").when(F.col("kind") == "label", "label").otherwise("cell")
    return rows.select(id_col, "row", "col", kind.alias("kind"), F.when(F.col("n").isNull(), F.col("value")).alias("str_value"), F.col("n.value").alias("num_value"), look.alias("format"))


def export_totals(docs: DataFrame, tables_only: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table_count, total_rows, error): data rows, and plain lines where whole documents are exported."""
    own = X.let(pieces(F.col(text_col)), lambda every: X.let(_total(F.filter(every, lambda p: ~_is_table(p)), lambda p: F.size(_plain(p))), lambda lines: X.let(F.filter(every, _is_table), lambda tables: F.struct(
        F.size(tables).cast("long").alias("table_count"), (_total(tables, _height) + (0 if tables_only else lines)).alias("total_rows"), (F.size(tables) + lines).alias("blocks"),
    ))))
    found = docs.select(id_col, own.alias("_n")).select(id_col, "_n.*")
    empty = F.col("table_count" if tables_only else "blocks") == 0
    error = F.when(empty, "Table not found in Markdown" if tables_only else "No content found in Markdown")
    return found.select(id_col, "table_count", "total_rows", error.alias("error"))


def preview_chunks(docs: DataFrame, size: int = 200, scan: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, marker, content): a long text in pieces for display.

    Texts with page markers are cut at the markers. Others of more than ``size`` lines are cut every ``size`` lines,
    or at a blank line within ``scan`` lines before or else after, so that tables stay whole.
    """
    marker = r"<!--\s*(?:Page|Image|第)\s*[0-9]+\s*页?\s*-->"
    base = docs.select(id_col, F.col(text_col).alias("text"), F.regexp_extract_all(text_col, F.lit(f"({marker})"), 1).alias("marks"), F.split(text_col, marker, -1).alias("parts"), F.split(text_col, "\n", -1).alias("lines"))
    long_ = (F.size("marks") == 0) & (F.size("lines") > size) & ~X.blank(F.col("text"))

    def cut(acc: Column, _: Column) -> Column:
        # State: the start line of each chunk; one more start a step, until the end is reached.
        start, n = F.try_element_at(acc, F.lit(-1)), F.size("lines")
        end = F.least(start + size, n)
        is_blank = lambda i: F.coalesce(X.blank(F.get("lines", i)), F.lit(False))
        backward = F.filter(F.sequence(end, F.greatest(start + 1, end - scan + 1), F.lit(-1)), lambda i: is_blank(i - 1))
        forward = F.filter(F.sequence(end, F.least(n - 1, end + scan - 1)), is_blank)
        near = F.when(F.size(backward) > 0, F.get(backward, F.lit(0))).when(F.size(forward) > 0, F.get(forward, F.lit(0))).otherwise(end)
        following = F.when(end < n, near).otherwise(n)
        return F.when(start >= n, acc).otherwise(F.concat(acc, F.array(following)))

    steps = F.sequence(F.lit(1), F.floor(F.size("lines") / F.lit(max(1, size - scan))).cast("int") + 2)
    starts = F.aggregate(steps, F.array(F.lit(0)), cut)
    pieces = F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda s, i: F.struct(F.lit("").alias("marker"), F.array_join(F.slice("lines", s + 1, F.get(starts, i + 1) - s), "\n").alias("content")))
    marked = F.transform("parts", lambda p, i: F.struct(F.when(i == 0, "").otherwise(F.get("marks", i - 1)).alias("marker"), p.alias("content")))
    found = base.select(id_col, F.posexplode(F.when(long_, pieces).otherwise(marked)).alias("chunk_no", "c"))
    return found.select(id_col, "chunk_no", "c.marker", "c.content")
