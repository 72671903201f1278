"""An XLSX sink: one workbook a document, made with the standard library and written by the committed file sink.

Rows are those of ``sheet_cells``; a task holds the cells of one document at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import importable
from .sink import write_files

#: Cell formats by name, as numbers of the style sheet below.
STYLES = {"cell": 1, "label": 2, "header": 3, "0.00%": 4}
_STYLE_SHEET = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts count="1"><numFmt numFmtId="164" formatCode="0.00%"/></numFmts>'
    "<fonts><font/><font><b/></font></fonts>"
    '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFE7EEF7"/></patternFill></fill></fills>'
    '<borders><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders>'
    "<cellStyleXfs><xf/></cellStyleXfs>"
    '<cellXfs><xf/><xf borderId="1" applyBorder="1"/><xf fontId="1" applyFont="1"/>'
    '<xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1"/><xf numFmtId="164" borderId="1" applyNumberFormat="1" applyBorder="1"/></cellXfs>'
    "</styleSheet>"
)
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": _STYLE_SHEET,
}


def column_name(col: int) -> str:
    """A, B, ... Z, AA, ... for 0, 1, ..."""
    name = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return name


def workbook(cells: list[tuple[int, int, str | None, float | None, str]]) -> bytes:
    """The file of one sheet; cells: row, column, text, number, format."""
    rows: dict[int, list[tuple]] = {}
    width: dict[int, int] = {}
    for r, c, s, n, f in cells:
        rows.setdefault(r, []).append((c, s, n, f))
        width[c] = max(width.get(c, 8), min(60, len(s if s is not None else str(n)) + 2))
    out = ['<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    out.append("<cols>" + "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in sorted(width.items())) + "</cols><sheetData>" if width else "<sheetData>")
    for r in sorted(rows):
        out.append(f'<row r="{r + 1}">')
        for c, s, n, f in sorted(rows[r], key=lambda x: x[0]):
            at = f'r="{column_name(c)}{r + 1}" s="{STYLES.get(f, 0)}"'
            clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s or "")
            out.append(f"<c {at}><v>{n!r}</v></c>" if n is not None else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
        out.append("</row>")
    out.append("</sheetData></worksheet>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        z.writestr("xl/worksheets/sheet1.xml", '<?xml version="1.0" encoding="UTF-8"?>' + "".join(out))
    return buffer.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """(name, content): a workbook for each document of cells (doc_id, row, col, str_value, num_value, format)."""

    def run(batches):
        open_, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if held and r["doc_id"] != open_:
                    yield told(open_, held)
                    held = []
                open_ = r["doc_id"]
                held.append((r["row"], r["col"], r["str_value"], r["num_value"], r["format"]))
        if held:
            yield told(open_, held)

    def told(doc_id, held):
        return pa.RecordBatch.from_arrays([pa.array([f"{doc_id}.xlsx"]), pa.array([workbook(held)], pa.binary())], names=["name", "content"])

    importable(cells.sparkSession)
    own = cells.select("doc_id", "row", "col", "str_value", "num_value", "format")
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "row", "col").mapInArrow(run, "name string, content binary")


def write_xlsx(cells: DataFrame, path: str) -> None:
    """A workbook file for each document; all are written or none."""
    write_files(workbooks(cells), path)
