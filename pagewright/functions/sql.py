"""The engine's functions in SQL.

``register(spark)`` makes them temporary functions of the session. The scalar ones are SQL functions: their bodies are the
same Column expressions that the operators use, so a call becomes part of the plan, is optimised with it, and runs
without Python. ``md_tables`` is a table function over Markdown: ``SELECT d.id, t.* FROM d, LATERAL md_tables(d.text) t``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.pages import parse_range
from ..runtime import importable
from . import geometry as G
from . import text as X

_BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"

#: Name: parameters, and the Column expression of them.
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "page_marker": ("page INT", X.page_marker),
    "page_from_line": ("line STRING", X.page_from_line),
    "is_table_delimiter": ("line STRING", X.is_delimiter),
    "split_table_cells": ("line STRING", X.split_cells),
    "is_fence": ("line STRING", X.is_fence),
    "starts_block": ("line STRING", X.starts_block),
    "ends_sentence": ("line STRING", X.ends_sentence),
    "dehyphenates": ("prev STRING, cur STRING", X.dehyphenates),
    "is_cjk": ("letter STRING", X.is_cjk),
    "text_connector": ("prev STRING, cur STRING", X.connector),
    "join_pieces": ("prev STRING, cur STRING", X.join_pieces),
    "join_fragments": ("parts ARRAY<STRING>", X.join_fragments),
    "clean_ocr_text": ("body STRING", X.clean_ocr),
    "strip_links": ("body STRING", X.strip_links),
    "strip_inline_markdown": ("body STRING", X.strip_inline),
    "sniff_number": ("cell STRING", X.sniff_number),
    "column_gaps": ("line STRING", X.column_gaps),
    "strip_markdown_fence": ("body STRING", X.strip_fence),
    "escape_cell": ("cell STRING", X.escape_cell),
    "unicode_trim": ("body STRING", X.utrim),
    "text_lines": ("body STRING", X.lines),
    "usage_month": ("day STRING", X.month),
    "format_duration": ("ms DOUBLE", X.duration),
    "confidence_class": ("confidence DOUBLE", X.confidence_class),
    "engine_of_mode": ("mode STRING", X.engine_of),
    "paragraph_mode": ("name STRING", X.paragraph_mode),
    "layout_mode": ("name STRING", X.layout_mode),
    "image_mime": ("ext STRING", X.mime),
    "completions_url": ("base STRING", X.completions_url),
    "display_name": ("name STRING", X.display_name),
    "path_is_inside": ("path STRING, folder STRING", X.is_inside),
    "to_lower_hex": ("body STRING", X.to_hex),
    "text_snippet": ("body STRING", X.snippet),
    "page_range": ("spec STRING, page_count INT", parse_range),
    "layout_class": ("name STRING", G.layout_class),
    "class_bucket": ("class_id INT, classes ARRAY<STRING>, buckets MAP<STRING, STRING>", G.class_bucket),
    "box_iou": (f"a {_BOX}, b {_BOX}", G.iou),
    "boxes_overlap": (f"a {_BOX}, b {_BOX}", G.overlaps),
    "box_contains": (f"box {_BOX}, px DOUBLE, py DOUBLE", G.contains),
    "clamp_rects": (f"rects ARRAY<{_BOX}>, page_width DOUBLE, page_height DOUBLE", G.clamp_rects),
    "clamp_region": ("px INT, py INT, w INT, h INT, image_width INT, image_height INT", G.clamp_region),
    "line_percents": ("positions ARRAY<DOUBLE>, scale DOUBLE, size DOUBLE", G.line_percents),
    "title_level": ("height DOUBLE, page_height DOUBLE", G.title_level),
    "map_model_point": ("px DOUBLE, py DOUBLE, input_w DOUBLE, input_h DOUBLE, image_width DOUBLE, image_height DOUBLE, keep_ratio BOOLEAN", G.map_model_point),
    "pixel_to_point": ("px_left DOUBLE, px_top DOUBLE, px_width DOUBLE, px_height DOUBLE, page_px DOUBLE, scale DOUBLE", G.pixel_to_point),
}


#: A string, which is left alone, or an operator that stands before its operands like a function.
_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|(?<![\w`>])(<=>|[<>=!]=|[-+*/%<>=!&|^~]|and|or|not|in)(?=\()", re.DOTALL)


def as_sql(c: Column) -> str:
    """A Column expression in SQL. Columns write operators before their operands, as in ``+(a, b)``; quoted, they are the
    functions of those names."""
    return _PIECE.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], c._jc.node().sql())


def definition(spark: SparkSession, name: str) -> str:
    """The SQL that makes one of the scalar functions."""
    parameters, build = SCALARS[name]
    schema = T._parse_datatype_string(", ".join(re.sub(r"^(\w+) ", r"`\1` ", p) for p in re.split(r", (?=\w+ (?:[A-Z]))(?![^<]*>)", parameters)))
    body = build(*[F.col(f.name) for f in schema.fields])
    kind = spark.createDataFrame([], schema).select(body.alias("r")).schema["r"].dataType.simpleString()
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {as_sql(body)}"


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name in SCALARS:
        spark.sql(definition(spark, name))
    importable(spark).udtf.register("md_tables", F.udtf(MdTables))
    return [*SCALARS, "md_tables"]


# ---- tables of a Markdown text ----

#: The code points of Unicode's property White_Space.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
_FENCE, _DELIMITER = re.compile("```|~~~"), re.compile(r"\|[-:| ]*-[-:| ]*\|")
_MARKER, _NUMBER = re.compile(r"<!-- (?:Page (.*)|第 (.*) 页) -->"), re.compile(r"\+?([0-9]{1,18})")


def _page(line: str) -> int | None:
    found = _MARKER.fullmatch(line)
    number = found and _NUMBER.fullmatch((found[1] or found[2] or "").strip(_BLANK))
    return int(number[1]) if number and int(number[1]) <= 4294967295 else None


def _cells(line: str) -> list[str]:
    inner = re.sub(r"^\||\|$", "", line)
    return [c.replace("\\|", "|").strip(_BLANK) for c in re.split(r"(?<!\\)\|", inner)]


def tables_in(text: str) -> Iterator[tuple[int | None, int, list[str], list[list[str]]]]:
    """(page, position of the header, columns, rows) of each table: a run of pipe lines outside code, from the first that a
    delimiter row follows. Short rows are padded, long ones cut."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    code, page, run, start = False, None, [], 0

    def told():
        head = next((k for k in range(len(run) - 1) if _DELIMITER.fullmatch(run[k + 1])), None)
        if head is not None:
            columns = _cells(run[head])
            rows = [_cells(r)[: len(columns)] for r in run[head + 2 :]]
            yield page, start + head, columns, [r + [""] * (len(columns) - len(r)) for r in rows]

    for at, raw in enumerate(lines):
        line = raw.removesuffix("\r").strip(_BLANK)
        if _FENCE.match(line):
            code = not code
        if not code and line.startswith("|"):
            start = start if run else at
            run.append(line)
            continue
        yield from told()
        run = []
        if not code and (found := _page(line)) is not None:
            page = found
    yield from told()


class MdTables:
    """The tables of a Markdown text: (table_no, page, pos, columns, rows), or with ``cells => true`` a row for each cell:
    (table_no, page, row_no, col_no, value), the header as row 0. A null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, cells: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("md_tables takes a text")
        if cells is not None and not (cells.isConstantExpression and isinstance(cells.dataType, T.BooleanType)):
            raise ValueError("cells must be a constant true or false")
        each = cells is not None and cells.value
        found = T.StructType().add("table_no", T.IntegerType()).add("page", T.LongType())
        if each:
            return AnalyzeResult(found.add("row_no", T.IntegerType()).add("col_no", T.IntegerType()).add("value", T.StringType()))
        cell = T.ArrayType(T.StringType())
        return AnalyzeResult(found.add("pos", T.IntegerType()).add("columns", cell).add("rows", T.ArrayType(cell)))

    def eval(self, text: str | None, cells: bool = False):
        for number, (page, at, columns, rows) in enumerate(tables_in(text or ""), 1):
            if not cells:
                yield number, page, at, columns, rows
                continue
            for r, row in enumerate([columns, *rows]):
                for c, value in enumerate(row):
                    yield number, page, r, c, value
