"""Queries over whole documents: exclusions, conversions and sessions, text by text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import sql
from ..operators import exclusion, layout, lines, pages, paragraphs, tables
from ..streaming import session
from .inputs import ITEMS, items, table
from .queries import _IOU, _RECTS, ORACLES, PAGE_TEXT, _box, query
from .wide import _SEQ, orders_markdown

# ---- Exclusions ----

#: The runs of characters outside the boxes, of items that can be read on pages that have boxes and need no recognition.
_OUTSIDE = f"""raw AS (WITH {ITEMS} SELECT * FROM items), r(rx, ry, rw, rh) AS (VALUES {", ".join(map(str, _RECTS))}),
h AS (SELECT *, EXISTS (SELECT 1 FROM r WHERE x < rx + rw AND rx < x + width AND y < ry + rh AND ry < y + greatest(height, font_size)) AS hit FROM raw WHERE item_type <> 'Image' AND doc_id % 3 <> 0 AND doc_id % 7 <> 0),
ch AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, page, item_no, x, y ORDER BY i) AS run FROM (SELECT *, unnest(range(0, length(text))) AS i FROM h)
 WHERE NOT EXISTS (SELECT 1 FROM r WHERE y < ry + rh AND ry < y + greatest(height, font_size) AND x + i * (width / length(text)) < rx + rw AND x + (i + 1) * (width / length(text)) > rx)),
items AS (SELECT doc_id, page, item_no * 10000 AS item_no, text, x, y, font_size FROM h WHERE NOT hit
 UNION ALL SELECT doc_id, page, item_no * 10000 + row_number() OVER (PARTITION BY doc_id, page, item_no, x, y ORDER BY min(i)) - 1, string_agg(ch.text[i + 1:i + 1], '' ORDER BY i), x + min(i) * any_value(width / length(ch.text)), y, any_value(font_size) FROM ch WHERE hit GROUP BY doc_id, page, item_no, x, y, run)"""


def _excluded(spark, sf_dir):
    """Pages of items, their boxes (none where the document's number divides by three) and flags (by seven)."""
    i = items(spark, sf_dir)
    own = i.select("doc_id", F.col("page").cast("int").alias("page")).distinct()
    filters = own.filter("doc_id % 3 <> 0").withColumn("rects", F.array(*[_box(*r) for r in _RECTS]))
    marked = own.select("*", F.concat(F.lit("old "), "doc_id", F.lit(" of "), "page").alias("markdown"), (F.col("doc_id") % 7 == 0).alias("needs_ocr"), F.lit(False).alias("has_table"))
    meta = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("y", 1.0), ("font_size", 12.0), ("x0", -1.0), ("x1", 9.0))]))
    return marked.withColumn("line_meta", meta), i, filters


_KEPT = "CASE WHEN o.doc_id % 3 = 0 OR o.doc_id % 7 = 0 THEN 'old ' || o.doc_id || ' of ' || o.page ELSE coalesce(p.markdown, '') END"


@query(PAGE_TEXT.format(items=_OUTSIDE, select=f"""SELECT o.doc_id, o.page, {_KEPT} AS markdown, CASE WHEN o.doc_id % 3 = 0 OR o.doc_id % 7 = 0 THEN [-1.0] ELSE p.meta END::DOUBLE[] AS left_edges FROM (SELECT DISTINCT doc_id, page::INTEGER AS page FROM raw) o LEFT JOIN p USING (doc_id, page)"""))
def exclude_pages(spark, sf_dir):
    """Pages built anew around their boxes, with the geometry of the lines that they then have."""
    own, i, filters = _excluded(spark, sf_dir)
    built = exclusion.rebuild_pages(own, i, filters)
    return built.select("doc_id", "page", "markdown", F.transform("line_meta", lambda m: m["x0"]).alias("left_edges"))


@query(PAGE_TEXT.format(items=_OUTSIDE, select=f"""SELECT o.doc_id, string_agg('<!-- Page ' || o.page || ' -->' || chr(10) || chr(10) || {_KEPT}, chr(10) || chr(10) ORDER BY o.page) AS markdown,
coalesce(list(o.page ORDER BY o.page) FILTER (o.doc_id % 7 = 0), []) AS ocr_pages, coalesce(list(o.page ORDER BY o.page) FILTER (o.doc_id % 7 = 0), []) AS skipped_pages FROM (SELECT DISTINCT doc_id, page::INTEGER AS page FROM raw) o LEFT JOIN p USING (doc_id, page) GROUP BY o.doc_id"""))
def pages_convert_excluding(spark, sf_dir):
    """Whole documents without what lies in the boxes; a page that they empty is no page that needs recognition."""
    own, i, filters = _excluded(spark, sf_dir)
    specs = own.groupBy("doc_id").agg(F.max("page").alias("page_count")).withColumn("page_range", F.lit(None).cast("string"))
    return pages.convert(own, specs, items=i, exclusions=filters)


# ---- Sessions ----


def session_events(spark, sf_dir):
    """A session for each conversation, ten seconds after the one before; its turns are pages: text, a result, a result of a
    skipped page, a failure twice, nothing. Even ones finish at once, odd ones after twenty minutes."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn"), "text")
    page, k = (F.col("turn") + 1).cast("int"), F.col("turn") % 5
    event = lambda n, kind, markdown=None, confidence=None, error=None, late=0: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), page.alias("page"), (F.lit(None).cast("string") if markdown is None else markdown).alias("markdown"), F.lit(confidence).cast("double").alias("confidence"), F.lit(error).cast("string").alias("error"), F.lit(late).alias("late"))
    of_turn = F.when(k == 0, F.array(event(2, "text", F.col("text")))).when(k == 1, F.array(event(2, "text", F.lit("not this")), event(3, "page", F.col("text"), 0.5)))
    of_turn = of_turn.when(k == 2, F.array(event(2, "skip", error="user"), event(3, "page", F.col("text"), 0.75))).when(k == 3, F.array(event(2, "fail", error="first"), event(3, "fail", error="boom")))
    rows = c.select("conv_id", F.explode(of_turn).alias("e"))
    whole = c.groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("pages"))
    ends = whole.select("conv_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.col("pages").alias("page"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"), late.alias("late")) for n, kind, late in ((1, "start", F.lit(0)), (4, "finish", F.when(F.col("conv_id") % 2 == 1, 1200).otherwise(0)))])).alias("e"))
    rows = rows.unionByName(ends)
    at = F.col("conv_id") * 10 + F.col("e.n") + F.col("e.late")
    # In order of time; pages of a session tie at most with each other's.
    return rows.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), (at * 1000 + F.coalesce("e.page", F.lit(0)) % 1000).cast("long").alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200) + at).alias("ts"), "e.kind", "e.page", "e.markdown", "e.confidence", "e.error")


@query("""WITH c AS (SELECT conv_id, turn, trim(text) AS raw, text FROM conversations), n AS (SELECT max(conv_id) AS last FROM c),
d AS (SELECT conv_id, string_agg('<!-- Page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || CASE turn % 5 WHEN 0 THEN trim(text, ' ' || chr(10)) WHEN 1 THEN text WHEN 2 THEN '<!-- OCR skipped (page ' || (turn + 1) || '): user -->' WHEN 3 THEN '<!-- OCR failed (page ' || (turn + 1) || '): boom -->' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS markdown,
 sum(CASE turn % 5 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE END) / count(*) FILTER (turn % 5 IN (1, 2)) AS confidence, coalesce(list((turn + 1)::INTEGER ORDER BY turn) FILTER (turn % 5 = 3), []) AS failed, coalesce(list((turn + 1)::INTEGER ORDER BY turn) FILTER (turn % 5 = 2), []) AS skipped FROM c GROUP BY conv_id),
s AS (SELECT *, conv_id % 2 = 0 OR conv_id + 63 > last AS lives FROM d, n)
SELECT 's' || conv_id AS session_id, CASE WHEN lives THEN 'finished' ELSE 'late' END AS status, CASE WHEN lives THEN markdown END AS markdown, CASE WHEN lives THEN confidence END AS confidence,
CASE WHEN lives THEN list_sort(list_concat(failed, failed)) ELSE [] END AS failed_pages, CASE WHEN lives THEN skipped ELSE [] END AS skipped_pages FROM s""")
def sessions_assembled(spark, sf_dir):
    """At most 32 sessions live: an odd one is evicted by the 63rd start after its own (even ones end before the next), so
    its finish comes late; the last ones stay."""
    found = session.assemble_sessions(session_events(spark, sf_dir))
    return found.withColumn("failed_pages", F.sort_array("failed_pages"))


# ---- Paragraphs by geometry, guided records, functions in SQL ----

#: Lines of pages with their geometry, and for each whether it begins a paragraph.
_LINES = PAGE_TEXT[: PAGE_TEXT.index("l AS (")].format(items=ITEMS) + """l AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY k) AS line, max(y) AS y, greatest(max(font_size), 1) AS font, min(x) AS x0, max(x + width) AS x1 FROM f GROUP BY ALL),
b AS (SELECT *, lag(y) OVER w AS py, lag(font) OVER w AS pf, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, min(x0) OVER p AS l0, greatest(max(x1) OVER p - min(x0) OVER p, 1) AS wide FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no), p AS (PARTITION BY doc_id, page)),
c AS (SELECT *, bool_or(coalesce(x0 - l0 >= font * 3.5 AND x0 <= px1 + font * 0.5, false)) OVER (PARTITION BY doc_id, page) AS in_columns FROM b),
s AS (SELECT *, CASE WHEN py IS NULL OR py - y > pf * 1.2 * 1.5 OR abs(font - pf) > 0.5 THEN 1 WHEN x0 - l0 >= font * 3.5 AND x0 <= px1 + font * 0.5 THEN 0 WHEN in_columns AND x0 - l0 < font * 0.5 THEN 1 WHEN x0 - l0 > font * 1.5 AND px0 - l0 < pf * 0.5 THEN 1 WHEN px1 - l0 < wide * 0.6 AND x0 - l0 < font * 0.5 THEN 1 ELSE 0 END AS new FROM c),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS para FROM s)"""


@query(f"""{_LINES} SELECT doc_id, page, string_agg(body, chr(10) ORDER BY para) AS markdown FROM (SELECT doc_id, page, para, string_agg(line, ' ' ORDER BY line_no) AS body FROM n GROUP BY ALL) GROUP BY ALL""")
def text_paragraphs_geometric(spark, sf_dir):
    """Paragraphs of pages whose every line has its geometry."""
    built = lines.page_text(lines.line_table(lines.text_lines(items(spark, sf_dir))))
    return paragraphs.join_pages(built, "smart", all_have_geometry=True).select("doc_id", "page", "markdown")


@query(f"""WITH RECURSIVE {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS k FROM items),
f AS (SELECT o.*, y AS anchor, 1 AS line_no FROM o WHERE k = 1
UNION ALL SELECT o.*, CASE WHEN abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3) THEN o.y ELSE f.anchor END, f.line_no + (abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3))::INTEGER FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1),
c AS (SELECT doc_id, page, line_no, k, unnest(range(0, length(text))) AS j, text, x, width FROM f),
g AS (SELECT doc_id, page, line_no, k, j, text[j + 1:j + 1] AS ch, x + (j + 0.5) * width / length(text) AS mid FROM c),
v AS (SELECT doc_id, page, line_no, CASE WHEN mid < 200 THEN 0 WHEN mid < 350 THEN 1 ELSE 2 END AS col, string_agg(ch, '' ORDER BY k, j) AS v FROM g GROUP BY ALL),
m AS (SELECT doc_id, page, line_no, max(y) AS y, max(font_size) AS font FROM f GROUP BY ALL),
r AS (SELECT m.*, (SELECT min(col) FROM v WHERE v.doc_id = m.doc_id AND v.page = m.page AND v.line_no = m.line_no) AS first_col, lag(y) OVER w AS py, lag(font) OVER w AS pf, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
n AS (SELECT *, sum((i <= 2 OR first_col = 0 OR py - y > pf * 2.5)::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS row_no FROM r),
j AS (SELECT n.doc_id, n.page, n.row_no, v.col, string_agg(v.v, ' ' ORDER BY n.line_no) AS every, arg_min(v.v, n.line_no) AS first FROM n JOIN v ON v.doc_id = n.doc_id AND v.page = n.page AND v.line_no = n.line_no GROUP BY ALL)
SELECT t.doc_id, t.page, t.row_no::INTEGER AS row_no, k.col AS col_no, coalesce(CASE WHEN k.col = 1 THEN j.every ELSE j.first END, '') AS value FROM (SELECT DISTINCT doc_id, page, row_no FROM n) t CROSS JOIN (VALUES (0), (1), (2)) k(col) LEFT JOIN j ON j.doc_id = t.doc_id AND j.page = t.page AND j.row_no = t.row_no AND j.col = k.col""")
def tables_guided_cells(spark, sf_dir):
    """Records of drawn tables, cell by cell: the second column's lines joined, of the others the first with text."""
    e = items(spark, sf_dir).select("doc_id", "page", "item_no", "text", "x", "y", "width", "font_size")
    draw = e.select("doc_id", "page").distinct().select("*", F.array(F.lit(200.0), F.lit(350.0)).alias("v_lines"), F.lit(2000.0).alias("page_width"), F.array(F.lit(1)).alias("merge_cols"))
    found = tables.vertical_tables(e, draw, mode="guided")
    grid = found.select("doc_id", "page", F.posexplode(F.concat(F.array("columns"), "rows")).alias("row_no", "r"))
    return grid.select("doc_id", "page", "row_no", F.posexplode("r").alias("col_no", "value"))


@query(ORACLES["md_order_cells"])
def sql_order_cells(spark, sf_dir):
    """Cells of the tables in each order's Markdown by the table function, in SQL."""
    sql.register(spark)
    orders_markdown(spark, sf_dir).createOrReplaceTempView("order_texts")
    return spark.sql("SELECT d.doc_id, t.table_no, t.row_no, t.col_no, t.value FROM order_texts d, LATERAL md_tables(d.text, cells => true) t")


@query("""SELECT conv_id, turn, '<!-- Page ' || (turn + 1) || ' -->' AS marker, text[-1:] IN ('.', '!', '?', ';') AS ends, trim(text, ' ' || chr(10)) || ' next' AS joined, substr(text, 1, 300) AS snippet, lower(hex(role)) AS role, CASE WHEN turn < 3 THEN 'error' WHEN turn < 4 THEN 'warn' ELSE 'ok' END AS class FROM conversations""")
def sql_turns(spark, sf_dir):
    """Functions in a plain SQL query over all turns."""
    sql.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("turns")
    return spark.sql("SELECT conv_id, turn, page_marker(CAST(turn + 1 AS INT)) AS marker, ends_sentence(text) AS ends, join_pieces(unicode_trim(text), 'next') AS joined, text_snippet(text) AS snippet, to_lower_hex(role) AS role, confidence_class(turn / 5.5) AS class FROM turns")


# ---- Reading order ----


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) - 1 AS k FROM lineitem),
b AS (SELECT doc_id, k AS region_no, CASE WHEN k = 0 THEN 0 WHEN k % 2 = 1 THEN 1 ELSE 2 END AS part, k FROM i)
SELECT doc_id, 1 AS page, region_no::BIGINT AS region_no, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k DESC) - 1)::INTEGER AS reading_no FROM b""")
def layout_reading_order(spark, sf_dir):
    """A page for each order: a title over both columns, below it the items by turns in the left and the right one, from the
    bottom up. Rows are cut first where the title spans the columns, then columns, then rows."""
    t = table(spark, sf_dir, "lineitem")
    t = t.repartition(t.count() // layout.BOXES_AT_ONCE + 1, "l_orderkey")
    own = t.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy(F.expr(_SEQ))) - 1).cast("long").alias("region_no"))
    k = F.col("region_no")
    title = k == 0
    boxes = own.select("*", F.when(title, 0.0).when(k % 2 == 1, 0.0).otherwise(320.0).alias("x"), F.when(title, 0.0).otherwise(F.lit(5000.0) - 60 * k).alias("y"), F.when(title, 600.0).otherwise(280.0).alias("width"), F.lit(30.0).alias("height"))
    pages_ = own.select("doc_id", "page").distinct().select("*", F.lit(600.0).alias("width_px"), F.lit(1000.0).alias("height_px"))
    return layout.reading_order(boxes, pages_).select("doc_id", "page", "region_no", "reading_no")


# ---- Suppressed detections, and wrapped cells folded back ----


#: SQL for the query that keeps box by box what greedy suppression leaves, in reading order.
ORACLES["layout_suppress"] = f"""WITH {ITEMS}, d AS (SELECT doc_id, page, (item_no % 6)::INTEGER AS class_id, CASE item_no % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'seal' WHEN 2 THEN 'table' WHEN 3 THEN 'title' WHEN 4 THEN 'figure' ELSE 'other' END AS class, item_no % 100 / 100.0 AS score, (item_no % 17)::DOUBLE AS ro,
 least(x, 800) AS x, least(y, 800) AS y, least(x + width * 2, 800) - least(x, 800) AS w, least(y + 40, 800) - least(y, 800) AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY item_no, x, y) - 1 AS n FROM items),
l AS (SELECT doc_id, page, array_agg({{'n': n, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'ro': ro, 'class_id': class_id, 'class': class}} ORDER BY score DESC, n) AS s FROM d WHERE score >= 0.3 AND w > 0 AND h > 0 GROUP BY 1, 2),
k AS (SELECT doc_id, page, list_reduce(s, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_IOU})) > 0 THEN acc ELSE list_append(acc, x) END, list_slice(s, 1, 0)) AS kept FROM l),
u AS (SELECT doc_id, page, unnest(kept) AS r, generate_subscripts(kept, 1) AS i FROM k)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY r.ro, i) - 1)::INTEGER AS region_no, r.n::INTEGER AS row_no, r.class_id, r.score::DOUBLE AS score, r.x, r.y, r.w AS width, r.h AS height, r.ro AS reading_order, r.class FROM u"""

#: Lines cut at the drawn columns, and folded row by row: a row goes on or begins a record.
_FOLDED = f"""WITH RECURSIVE {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS k FROM items),
f AS (SELECT o.*, y AS anchor, 1 AS line_no FROM o WHERE k = 1
UNION ALL SELECT o.*, CASE WHEN abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3) THEN o.y ELSE f.anchor END, f.line_no + (abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3))::INTEGER FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1),
c AS (SELECT doc_id, page, line_no, k, unnest(range(0, length(text))) AS j, text, x, width FROM f),
g AS (SELECT doc_id, page, line_no, k, j, text[j + 1:j + 1] AS ch, x + (j + 0.5) * width / length(text) AS mid FROM c),
v AS (SELECT doc_id, page, line_no, coalesce(string_agg(ch, '' ORDER BY k, j) FILTER (mid < 150), '') AS a, coalesce(string_agg(ch, '' ORDER BY k, j) FILTER (mid >= 150 AND mid < 300), '') AS b, coalesce(string_agg(ch, '' ORDER BY k, j) FILTER (mid >= 300), '') AS z FROM g GROUP BY ALL),
m AS (SELECT doc_id, page, line_no, max(y) AS y, max(font_size) AS font FROM f GROUP BY ALL),
r AS (SELECT m.doc_id, m.page, m.y, m.font, [a, b, z] AS cells, CASE WHEN a <> '' THEN 0 WHEN b <> '' THEN 1 ELSE 2 END AS col, row_number() OVER (PARTITION BY m.doc_id, m.page ORDER BY m.line_no) AS i FROM m JOIN v ON v.doc_id = m.doc_id AND v.page = m.page AND v.line_no = m.line_no),
w AS (SELECT doc_id, page, i, 0 AS rec, y, font, cells, col, false AS goes FROM r WHERE i = 1
UNION ALL SELECT s.doc_id, s.page, s.i, s.rec + (NOT s.on_)::INTEGER, s.y, CASE WHEN s.on_ THEN s.last_font ELSE s.font END, CASE WHEN s.on_ THEN list_transform([1, 2, 3], lambda n: CASE WHEN s.cells[n] = '' THEN s.before[n] WHEN s.before[n] = '' THEN s.cells[n] ELSE s.before[n] || ' ' || s.cells[n] END) ELSE s.cells END, s.col, s.on_
 FROM (SELECT r.*, w.rec, w.font AS last_font, w.cells AS before, NOT (w.y - r.y > w.font * 2.5) AND r.col > 0 AND ((w.col < r.col AND w.cells[r.col + 1] <> '') OR (w.col = r.col AND w.goes)) AS on_ FROM w JOIN r ON r.doc_id = w.doc_id AND r.page = w.page AND r.i = w.i + 1) s),
e AS (SELECT doc_id, page, rec, arg_max(cells, i) AS cells FROM w GROUP BY ALL)"""

ORACLES["tables_vertical"] = f"""{_FOLDED} SELECT doc_id, page, any_value(cells) FILTER (rec = 0) AS columns, coalesce(list(cells ORDER BY rec) FILTER (rec > 0), []) AS "rows" FROM e GROUP BY doc_id, page"""


@query(f"""{_FOLDED} SELECT doc_id, page, rec AS row_no, k.col AS col_no, cells[k.col + 1] AS value FROM e CROSS JOIN (VALUES (0), (1), (2)) k(col)""")
def tables_vertical_cells(spark, sf_dir):
    """Drawn columns, cell by cell, with wrapped cells folded back into the record above."""
    i = items(spark, sf_dir)
    draw = i.select("doc_id", "page").distinct().select("*", F.array(F.lit(150.0), F.lit(300.0)).alias("v_lines"), F.array().cast("array<int>").alias("merge_cols"), F.lit(2000.0).alias("page_width"))
    found = tables.vertical_tables(i, draw)
    grid = found.select("doc_id", "page", F.posexplode(F.concat(F.array("columns"), "rows")).alias("row_no", "r"))
    return grid.select("doc_id", "page", "row_no", F.posexplode("r").alias("col_no", "value"))
