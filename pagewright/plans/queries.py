"""Queries by name; each takes (spark, folder of the tables) and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as G
from ..functions import text as X
from ..operators import catalog, exclusion, filters, layout, lines, markdown, pages, paragraphs, tables, usage
from .inputs import BLOCKS, ITEMS, USAGE, blocks, items, region_markdown, table
from .inputs import usage as usage_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BOX = "struct<x:double,y:double,width:double,height:double>"


def _box(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x, y, w, h), ("x", "y", "width", "height"), strict=True)])


# ---- Markdown ----


@query("""WITH n AS (SELECT n.*, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation n)
SELECT n_regionkey::BIGINT AS doc_id, 0::BIGINT AS "row", 0 AS col, 'label' AS kind, 'Page ' || (n_regionkey + 1) AS str_value, NULL::DOUBLE AS num_value, 'label' AS format FROM n WHERE k = 1
UNION ALL SELECT n_regionkey, 1, c.col, 'header', c.v, NULL, 'header' FROM n, (VALUES (0, 'Key'), (1, 'Nation'), (2, 'Share')) c(col, v) WHERE k = 1
UNION ALL SELECT n_regionkey, k + 1, 0, 'num', NULL, n_nationkey, 'cell' FROM n
UNION ALL SELECT n_regionkey, k + 1, 1, 'text', n_name, NULL, 'cell' FROM n
UNION ALL SELECT n_regionkey, k + 1, 2, 'percent', NULL, n_nationkey * 4 / 100.0, '0.00%' FROM n""")
def md_sheet_cells(spark, sf_dir):
    return markdown.sheet_cells(region_markdown(spark, sf_dir))


@query("""SELECT n_regionkey::BIGINT AS doc_id, 1 AS table_no, (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS row_no, c.col AS col_no,
CASE c.col WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN '**' || n_name || '**' ELSE (n_nationkey * 4) || '%' END AS value FROM nation, (VALUES (0), (1), (2)) c(col)
UNION ALL SELECT r_regionkey, 1, 0, c.col, c.v FROM region, (VALUES (0, 'Key'), (1, 'Nation'), (2, 'Share')) c(col, v) WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def md_parse_cells(spark, sf_dir):
    return markdown.cells(markdown.parse_tables(region_markdown(spark, sf_dir)))


@query("""SELECT n_regionkey::BIGINT AS doc_id, count(*)::BIGINT + 1 AS table_no_rows FROM nation GROUP BY 1""")
def md_blocks(spark, sf_dir):
    found = markdown.parse_blocks(region_markdown(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "table", F.size("rows")).otherwise(1)).alias("table_no_rows"))


@query("""SELECT doc_id, 0::BIGINT AS table_count, 0::BIGINT AS total_rows,
CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END::BIGINT AS total_lines FROM documents""")
def md_analyze_documents(spark, sf_dir):
    return markdown.analyze(table(spark, sf_dir, "documents"))


@query("""SELECT n_regionkey::BIGINT AS doc_id, 1::BIGINT AS table_count, count(*)::BIGINT + 1 AS total_rows, NULL::VARCHAR AS error FROM nation GROUP BY 1""")
def md_export_totals(spark, sf_dir):
    return markdown.export_totals(region_markdown(spark, sf_dir), tables_only=False)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text <> '')
SELECT doc_id, pos::INTEGER AS pos, rtrim(line, chr(13)) AS line FROM l""")
def md_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return markdown.explode_lines(d.withColumn("text", F.concat("text", F.lit("\n"))).filter(F.col("text") != "\n"))


@query()
def md_preview_chunks(spark, sf_dir):
    return markdown.preview_chunks(table(spark, sf_dir, "documents"))


# ---- Text ----


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\x0B\\f]+', ' ', 'g'), '\\n$', '') AS text FROM documents""")
def text_clean_ocr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_ocr(F.col("text")).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS value, CASE WHEN c_acctbal >= 0 THEN 'num' END AS kind, c_nationkey * 4 / 100.0 AS share FROM customer""")
def text_sniff_numbers(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    # Cents as SQL rounds them; minus zero is no negative number, and a negative one keeps its sign below half a cent.
    cents = F.round(F.abs("c_acctbal") * 100) / 100
    n = X.sniff_number(F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.format_string("%.2f", cents)))
    return t.select("c_custkey", n["value"].alias("value"), n["kind"].alias("kind"), X.sniff_number(F.concat(F.col("c_nationkey") * 4, F.lit("%")))["value"].alias("share"))


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS plain, string_split(p_name, ' ') AS words, array_to_string(string_split(p_name, ' '), '|') AS piped FROM part""")
def text_cells_and_links(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("**"), F.col("p_name"), F.lit("** ["), F.col("p_brand"), F.lit("](http://x/y) `"), F.col("p_type"), F.lit("`"))
    row = F.concat(F.lit("| "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    return t.select("p_partkey", X.strip_inline(raw).alias("plain"), X.split_cells(row).alias("words"), F.get(X.split_cells(F.concat(F.lit("| "), F.replace("p_name", F.lit(" "), F.lit("\\|")), F.lit(" |"))), F.lit(0)).alias("piped"))


@query("""SELECT conv_id, turn, length(text)::INTEGER AS n, text[-1:] IN ('.', '!', '?', ';') AS ends FROM conversations""")
def text_sentence_ends(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.length("text").alias("n"), X.ends_sentence(F.col("text")).alias("ends"))


@query("""SELECT event_id, CASE WHEN v < 1000 THEN v || 'ms' WHEN v < 60000 THEN regexp_replace(printf('%.2f', v / 1000.0), '\\.?0+$', '') || 's' WHEN v < 3600000 THEN (v // 60000) || 'min ' || round((v % 60000) / 1000.0)::BIGINT || 's' ELSE (v // 3600000) || 'h ' || (v // 60000 % 60) || 'min' END AS took,
CASE WHEN c < 0.5 THEN 'error' WHEN c < 0.7 THEN 'warn' ELSE 'ok' END AS class FROM (SELECT event_id, 1 + event_id * 1000 AS v, event_id % 10 / 10.0 AS c FROM events)""")
def text_durations(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.select("event_id", X.duration(1 + F.col("event_id") * 1000).alias("took"), X.confidence_class(F.col("event_id") % 10 / 10.0).alias("class"))


# ---- Lines ----


@query(f"""WITH {BLOCKS}, g AS (SELECT *, coalesce((abs(top - lag(top) OVER w) > greatest(height_px * 0.015, 8.0))::INTEGER, 1) AS new FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, block_no, "left"))
SELECT doc_id, page, block_no, (sum(new) OVER (PARTITION BY doc_id, page ORDER BY top, block_no, "left" ROWS UNBOUNDED PRECEDING))::BIGINT AS line_no FROM g""")
def lines_ocr(spark, sf_dir):
    return lines.ocr_lines(blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "line_no")


@query(f"""WITH {BLOCKS}, g AS (SELECT *, coalesce((abs(top - lag(top) OVER w) > greatest(height_px * 0.015, 8.0))::INTEGER, 1) AS new FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, block_no)),
l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY top, block_no ROWS UNBOUNDED PRECEDING) AS line_no FROM g),
c AS (SELECT *, coalesce(("left" - lag("left" + width) OVER (PARTITION BY doc_id, page, line_no ORDER BY "left", block_no) > greatest(width_px * 0.02, 12.0))::INTEGER, 1) AS wide FROM l)
SELECT doc_id, page, block_no, (sum(wide) OVER (PARTITION BY doc_id, page, line_no ORDER BY "left", block_no ROWS UNBOUNDED PRECEDING))::BIGINT AS cell_no FROM c""")
def lines_grid_cells(spark, sf_dir):
    return lines.grid_cells(blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "cell_no")


_FOLD = """WITH RECURSIVE {items}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS k FROM items),
f AS (SELECT doc_id, page, item_no, k, y AS anchor, greatest(font_size, 1) AS size, 1 AS line_no FROM o WHERE k = 1
UNION ALL SELECT o.doc_id, o.page, o.item_no, o.k, CASE WHEN {new} THEN o.y ELSE f.anchor END, CASE WHEN {new} THEN greatest(o.font_size, 1) ELSE f.size END, f.line_no + ({new})::INTEGER FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1)
SELECT doc_id, page, item_no, line_no FROM f"""


#: Text lines put together to pages, with each line's left edge.
PAGE_TEXT = """WITH RECURSIVE {items}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS k FROM items),
f AS (SELECT o.*, y AS anchor, greatest(font_size, 1) AS size, 1 AS line_no FROM o WHERE k = 1
UNION ALL SELECT o.*, CASE WHEN abs(o.y - f.anchor) > greatest(0.5 * f.size, 3) THEN o.y ELSE f.anchor END, CASE WHEN abs(o.y - f.anchor) > greatest(0.5 * f.size, 3) THEN greatest(o.font_size, 1) ELSE f.size END, f.line_no + (abs(o.y - f.anchor) > greatest(0.5 * f.size, 3))::INTEGER FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1),
l AS (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY k) AS line, min(x) AS x0 FROM f GROUP BY ALL),
p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS markdown, list(x0 ORDER BY line_no) AS meta FROM l GROUP BY ALL)
{select}"""


@query(_FOLD.format(items=ITEMS, new="abs(o.y - f.anchor) > greatest(0.5 * f.size, 3)"))
def lines_text_layer(spark, sf_dir):
    return lines.text_lines(items(spark, sf_dir)).select("doc_id", "page", "item_no", "line_no")


@query(_FOLD.format(items=ITEMS, new="abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3)"))
def lines_drawn_table(spark, sf_dir):
    return lines.table_lines(items(spark, sf_dir)).select("doc_id", "page", "item_no", "line_no")


@query(PAGE_TEXT.format(items=ITEMS, select="SELECT doc_id, page, markdown, len(meta)::INTEGER AS lines FROM p"))
def lines_page_text(spark, sf_dir):
    return lines.page_text(lines.line_table(lines.text_lines(items(spark, sf_dir)))).select("doc_id", "page", "markdown", F.size("line_meta").alias("lines"))


@query(f"""WITH {ITEMS}, m AS (SELECT doc_id, page, x AS x0, x + width AS x1, font_size, row_number() OVER (PARTITION BY doc_id, page ORDER BY item_no, x, y) AS line_no FROM items),
p AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS l, lag(x1) OVER w AS px1, lag(font_size) OVER w AS pf FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))
SELECT doc_id, page, min(x0) AS block_left, greatest(max(x1) - min(x0), 1.0) AS text_width, bool_or(coalesce(x0 - l >= 3.5 * font_size AND x0 <= px1 + 0.5 * pf, false)) AS column_layout FROM p GROUP BY 1, 2""")
def lines_page_geometry(spark, sf_dir):
    i = items(spark, sf_dir)
    n = F.row_number().over(W.Window.partitionBy("doc_id", "page").orderBy("item_no", "x", "y"))
    return lines.page_geometry(i.select("doc_id", "page", F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), "font_size", n.alias("line_no")))


# ---- Geometry, exclusion, regions ----

_RECTS = [(100, 100, 120, 200), (300, 400, 80, 300)]


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no FROM items WHERE NOT EXISTS (SELECT 1 FROM (VALUES (100, 100, 120, 200), (300, 400, 80, 300)) r(rx, ry, rw, rh) WHERE x < rx + rw AND rx < x + width AND y < ry + rh AND ry < y + greatest(height, font_size))""")
def exclude_hits(spark, sf_dir):
    i = items(spark, sf_dir)
    rects = F.array(*[_box(*r) for r in _RECTS])
    return i.filter(~exclusion.hits_box(rects, F.col("x"), F.col("y"), F.col("width"), F.greatest("height", "font_size"))).select("doc_id", "page", "item_no")


@query(f"""WITH {ITEMS}, r(rx, ry, rw, rh) AS (VALUES (100, 100, 120, 200), (300, 400, 80, 300)),
h AS (SELECT *, EXISTS (SELECT 1 FROM r WHERE x < rx + rw AND rx < x + width AND y < ry + rh AND ry < y + greatest(height, font_size)) AS hit FROM items),
c AS (SELECT doc_id, page, item_no, x, y, hit, i, substr(text, i + 1, 1) AS ch, NOT EXISTS (SELECT 1 FROM r WHERE y < ry + rh AND ry < y + greatest(height, font_size) AND x + i * (width / length(text)) < rx + rw AND x + (i + 1) * (width / length(text)) > rx) AS keep FROM h, (SELECT unnest(range(0, 12)) AS i) WHERE i < length(text))
SELECT doc_id, page, item_no, x, y, count(*)::BIGINT AS kept FROM c WHERE keep OR NOT hit GROUP BY ALL""")
def exclude_split(spark, sf_dir):
    i = items(spark, sf_dir)
    filters = i.select("doc_id", "page").distinct().withColumn("rects", F.array(*[_box(*r) for r in _RECTS]))
    parts = exclusion.exclude_items(i.withColumns({"x_in": F.col("x"), "y_in": F.col("y")}), filters)
    return parts.groupBy("doc_id", "page", "item_no", F.col("x_in").alias("x"), F.col("y_in").alias("y")).agg(F.sum(F.length("text")).cast("long").alias("kept"))


_REGIONS = [(0, 0, 300, 842), (0, 0, 600, 400), (300, 400, 300, 442), (100, 100, 100, 100)]


@query(f"""WITH {BLOCKS}, r(n, rx, ry, rw, rh) AS (VALUES (0, 0, 0, 300, 842), (1, 0, 0, 600, 400), (2, 300, 400, 300, 442), (3, 100, 100, 100, 100))
SELECT b.doc_id, b.page, b.block_no, (SELECT n FROM r WHERE b."left" + b.width / 2 BETWEEN rx AND rx + rw AND b.top + b.height / 2 BETWEEN ry AND ry + rh ORDER BY rw * rh, n LIMIT 1) AS region_no FROM blocks b""")
def layout_assign_regions(spark, sf_dir):
    b = blocks(spark, sf_dir)
    pages_ = b.select("doc_id", "page").distinct()
    regions = pages_.select("doc_id", "page", F.posexplode(F.array(*[_box(*r) for r in _REGIONS])).alias("region_no", "r")).select("doc_id", "page", "region_no", "r.*")
    return layout.assign_regions(b, regions).select("doc_id", "page", "block_no", "region_no")


@query()
def layout_assemble(spark, sf_dir):
    b = blocks(spark, sf_dir)
    pages_ = b.select("doc_id", "page", "width_px", "height_px").distinct()
    kinds = F.array(*map(F.lit, ["text", "title", "table", "header"]))
    regions = pages_.select("doc_id", "page", F.posexplode(F.array(*[_box(*r) for r in _REGIONS])).alias("region_no", "r")).select("doc_id", "page", "region_no", "r.*", F.get(kinds, F.col("region_no")).alias("class"))
    return layout.assemble(b.drop("width_px", "height_px"), regions, pages_)


def _detections(spark, sf_dir):
    i = items(spark, sf_dir)
    row = F.struct("item_no", "x", "y", F.array((F.col("item_no") % 6).cast("double"), (F.col("item_no") % 100 / 100.0), F.col("x"), F.col("y"), F.col("x") + F.col("width") * 2, F.col("y") + 40, (F.col("item_no") % 17).cast("double")).alias("d"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["d"]))
    raw = i.groupBy("doc_id", "page").agg(flat.alias("data"))
    fixed = {"score_threshold": F.lit(0.3), "classes": F.array(*map(F.lit, ["text", "seal", "table", "doc_title", "image"])), "bucket_map": F.create_map().cast("map<string,string>"), "input_width": F.lit(800), "input_height": F.lit(800), "width_px": F.lit(800), "height_px": F.lit(800), "keep_ratio": F.lit(False)}
    return raw.withColumns(fixed)


@query(f"""WITH {ITEMS} SELECT doc_id, page, (item_no % 6)::INTEGER AS class_id, CASE item_no % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'seal' WHEN 2 THEN 'table' WHEN 3 THEN 'title' WHEN 4 THEN 'figure' ELSE 'other' END AS class,
least(x, 800) AS x, least(y, 800) AS y, count(*)::BIGINT AS n FROM items WHERE item_no % 100 / 100.0 >= 0.3 AND least(x + width * 2, 800) > least(x, 800) AND least(y + 40, 800) > least(y, 800) GROUP BY ALL""")
def layout_decode(spark, sf_dir):
    d = layout.decode_detections(_detections(spark, sf_dir))
    return d.groupBy("doc_id", "page", "class_id", "class", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query()
def layout_suppress(spark, sf_dir):
    return layout.suppress(layout.decode_detections(_detections(spark, sf_dir)))


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, (CASE WHEN y < 842 THEN floor(y / 200) END)::INTEGER AS band, (CASE WHEN x + width / 2 < 600 THEN floor((x + width / 2) / 150) END)::INTEGER AS col FROM items""")
def geometry_bands(spark, sf_dir):
    bounds = lambda *v: F.array(*[F.lit(float(b)) for b in v])
    return items(spark, sf_dir).select("doc_id", "page", "item_no", G.band_of(bounds(0, 200, 400, 600, 800, 842), F.col("y")).alias("band"), G.band_of(bounds(0, 150, 300, 450, 600), F.col("x") + F.col("width") / 2).alias("col"))


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, x / 2 AS px, (842 - (y + height)) / 2 AS py, greatest(height / 2, 1.0) AS font, CASE WHEN height >= 42.1 THEN 1 WHEN height >= 21.05 THEN 2 ELSE 3 END AS level FROM items""")
def geometry_points(spark, sf_dir):
    i = items(spark, sf_dir)
    p = G.pixel_to_point(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(842.0), F.lit(2.0))
    return i.select("doc_id", "page", "item_no", p["x"].alias("px"), p["y"].alias("py"), p["font_size"].alias("font"), G.title_level(F.col("height"), F.lit(842.0)).alias("level"))


@query(f"""WITH {ITEMS} SELECT DISTINCT doc_id, page, 'vertical' AS kind FROM items WHERE page = 1 UNION ALL SELECT DISTINCT doc_id, page, 'grid' FROM items WHERE page = 2 AND y + font_size / 2 < 842""")
def tables_drawn(spark, sf_dir):
    i = items(spark, sf_dir)
    reals = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    draw = i.select("doc_id", "page").distinct().select("doc_id", "page", reals(150, 300).alias("v_lines"), F.when(F.col("page") == 2, reals(400)).otherwise(F.array().cast("array<double>")).alias("h_lines"), F.array().cast(f"array<{BOX}>").alias("rects"), F.array().cast("array<int>").alias("merge_cols"), F.lit(2000.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    return tables.draw_tables(i.select("doc_id", "page", "item_no", "text", "x", "y", "width", "font_size"), draw).select("doc_id", "page", "kind")


@query()
def tables_vertical(spark, sf_dir):
    i = items(spark, sf_dir)
    draw = i.select("doc_id", "page").distinct().select("doc_id", "page", F.array(F.lit(150.0), F.lit(300.0)).alias("v_lines"), F.array().cast("array<int>").alias("merge_cols"), F.lit(2000.0).alias("page_width"))
    return tables.vertical_tables(i, draw)


# ---- Pages ----


@query("""WITH s AS (SELECT o_orderkey, 1 + o_custkey % 5 AS a, 3 + o_custkey % 9 AS b, 30 - o_custkey % 20 AS c, 20 AS n FROM orders)
SELECT o_orderkey, list_sort(list_distinct(list_filter(list_concat(range(least(a, b), greatest(a, b) + 1), range(c, c + 5), [99]), lambda p: p >= 1 AND p <= n)))::INTEGER[] AS pages FROM s""")
def pages_parse_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    spec = F.concat(1 + F.col("o_custkey") % 5, F.lit("-"), 3 + F.col("o_custkey") % 9, F.lit(" , x, "), 34 - F.col("o_custkey") % 20, F.lit("-"), 30 - F.col("o_custkey") % 20, F.lit(",99"))
    return o.select("o_orderkey", pages.parse_range(spec, F.lit(20)).alias("pages"))


@query("""SELECT l_orderkey AS doc_id, list_sort(list_distinct(array_agg(l_linenumber) FILTER (l_returnflag <> 'N')))::INTEGER[] AS ocr_pages FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'N') > 0""")
def pages_ocr_set(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    own = t.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("r"), F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("a"))
    return own.select("doc_id", pages.ocr_pages(F.col("r"), F.col("a")).alias("ocr_pages")).filter(F.size("ocr_pages") > 0)


@query("""SELECT conv_id AS doc_id, string_agg('<!-- Page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || CASE WHEN turn % 4 = 3 THEN '<!-- OCR skipped (page ' || (turn + 1) || '): user -->' WHEN turn % 4 = 1 THEN 'ocr ' || turn ELSE trim(text, ' ' || chr(10)) END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def pages_hybrid(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "turn", F.col("text").alias("markdown"))
    results = c.filter("turn % 4 = 1").select("doc_id", "page", F.concat(F.lit("ocr "), F.col("turn")).alias("ocr_markdown"))
    skipped = c.filter("turn % 4 = 3").select("doc_id", "page", F.lit("user").alias("reason"))
    return pages.assemble(pages.hybrid(c, results, skipped))


#: Documents of the pages that are ``own``; of these, ``away`` have no text, and pages of the user need recognition.
_CONVERTED = """SELECT conv_id AS doc_id, coalesce(string_agg('<!-- Page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || CASE WHEN away THEN '' ELSE trim(text, ' ' || chr(10)) END, chr(10) || chr(10) ORDER BY turn) FILTER (own), '') AS markdown,
coalesce(list_sort(array_agg((turn + 1)::INTEGER) FILTER (own AND (role = 'user' OR away))), []) AS ocr_pages, coalesce(list_sort(array_agg((turn + 1)::INTEGER) FILTER (own AND (role = 'user' OR away))), []) AS skipped_pages FROM c GROUP BY 1"""


def _turns(spark, sf_dir):
    """Turns as pages; every fifth has no text, blank or null."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 5
    text = F.when(k == 3, F.lit(" \n")).when(k == 4, None).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), text.alias("markdown"), F.when(F.col("role") == "user", True).when(k != 1, False).alias("needs_ocr"))


@query(f"""WITH c AS (SELECT *, true AS own, turn % 5 >= 3 AS away FROM conversations) {_CONVERTED}""")
def pages_convert(spark, sf_dir):
    own = _turns(spark, sf_dir)
    return pages.convert(own, own.groupBy("doc_id").agg(F.max("page").alias("page_count")).withColumn("page_range", F.lit("1-999999")))


@query(f"""WITH c AS (SELECT *, CASE conv_id % 4 WHEN 1 THEN turn >= 1 WHEN 2 THEN turn <> 1 ELSE true END AS own, turn % 5 >= 3 AS away FROM conversations) {_CONVERTED}""")
def pages_convert_whole(spark, sf_dir):
    own = _turns(spark, sf_dir)
    k = F.col("doc_id") % 4
    page_range = F.when(k == 1, "2-999999").when(k == 2, "1,999999-3").when(k == 3, "none")
    return pages.convert(own, own.groupBy("doc_id").agg(F.max("page").alias("page_count")).withColumn("page_range", page_range))


# ---- Usage, merges ----

_USAGE_COLUMNS = """least(coalesce(sum(files), 0), 4294967295)::BIGINT AS file_count, least(coalesce(sum(pages), 0), 4294967295)::BIGINT AS page_count, least(coalesce(sum(ocr), 0), 4294967295)::BIGINT AS ocr_page_count, coalesce(sum(ms), 0)::BIGINT AS total_ms,
coalesce(sum(files) FILTER (kind IN ('pdf', 'drawTable')), 0)::BIGINT AS pdf_file_count, coalesce(sum(pages) FILTER (kind IN ('pdf', 'drawTable')), 0)::BIGINT AS pdf_page_count, coalesce(sum(ocr) FILTER (kind IN ('pdf', 'drawTable')), 0)::BIGINT AS pdf_ocr_page_count,
coalesce(sum(files) FILTER (kind NOT IN ('pdf', 'drawTable')), 0)::BIGINT AS image_file_count, coalesce(sum(ocr) FILTER (engine = 'local'), 0)::BIGINT AS local_ocr_page_count, coalesce(sum(ocr) FILTER (engine = 'ai'), 0)::BIGINT AS ai_ocr_page_count"""


@query(f"""WITH {USAGE} SELECT 'total' AS period, {_USAGE_COLUMNS} FROM usage UNION ALL SELECT 'month', {_USAGE_COLUMNS} FROM usage WHERE date LIKE '2024-01%' UNION ALL SELECT 'today', {_USAGE_COLUMNS} FROM usage WHERE date = '2024-01-15'""")
def usage_stats(spark, sf_dir):
    return usage.usage_stats(usage_log(spark, sf_dir), "2024-01-15")


@query(f"""WITH {USAGE} SELECT date, kind, sum(files)::BIGINT AS file_count, sum(pages)::BIGINT AS page_count, sum(ocr)::BIGINT AS ocr_page_count, sum(ms)::BIGINT AS total_ms FROM usage GROUP BY 1, 2""")
def usage_by_day(spark, sf_dir):
    from ..streaming.session import rolling_usage

    return rolling_usage(usage_log(spark, sf_dir))


@query("""SELECT l_orderkey AS doc_id, count(*)::BIGINT AS table_count, sum(l_linenumber)::BIGINT AS total_rows, list_sort(list_distinct(array_agg(l_linenumber)))::INTEGER[] AS ocr_pages, round(avg(l_discount), 6) AS ocr_confidence FROM lineitem GROUP BY 1""")
def usage_merge_results(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    batches = t.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("table_count"), F.col("l_linenumber").alias("total_rows"), F.array("l_linenumber").alias("ocr_pages"), F.array().cast("array<int>").alias("empty_text_pages"), F.array().cast("array<int>").alias("image_pages"), F.col("l_discount").alias("ocr_confidence"))
    found = usage.merge_results(batches)
    return found.select("doc_id", "table_count", "total_rows", "ocr_pages", F.round("ocr_confidence", 6).alias("ocr_confidence"))


# ---- Catalog ----


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)""")
def catalog_new_paths(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0").select(F.concat(F.lit("c/"), F.col("o_custkey")).alias("path"))
    dropped = table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey")).alias("path"), "c_custkey", "c_name")
    return catalog.new_paths(dropped, known).select("c_custkey", "c_name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 25 >= 25 THEN 'ignored' WHEN p_size = p_partkey % 25 THEN 'imported' ELSE 'failed' END AS status FROM part""")
def catalog_inventory(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("nation_"), F.col("p_partkey") % 25).alias("name"), F.col("p_size").cast("long").alias("size"), F.lit("aa").alias("sha256"))
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("size"), F.lit("AA").alias("sha256"), F.lit("t").alias("target"), F.lit("g").alias("group_id"))
    return catalog.match_inventory(files, known).select("p_partkey", "status")


@query("""SELECT 'n' || n_nationkey AS id, n_nationkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS name, 'http://' || n_nationkey AS base_url FROM (SELECT n_nationkey, n_name FROM nation)""")
def catalog_vendors(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    models = F.array().cast("array<struct<id:string,name:string,default:boolean>>").alias("models")
    vid = F.concat(F.lit("n"), F.col("n_nationkey")).alias("id")
    existing = n.select(vid, F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("http://"), F.col("n_nationkey")).alias("base_url"), models)
    imported = n.select(vid, F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("new "), F.col("n_name"))).otherwise("").alias("name"), F.lit("").alias("base_url"), models)
    found = catalog.upsert_vendors(existing, imported)
    return found.select("id", (F.col("ord") - 1).alias("ord"), "name", "base_url")


@query("""SELECT p_brand, list_sort(array_agg(p_name || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.md')) AS files FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name) AS k FROM part) GROUP BY 1""")
def catalog_unique_names(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_brand", "p_name")
    named = catalog.unique_rows(own, "p_name", ["p_name"], ("p_brand",))
    return named.groupBy("p_brand").agg(F.array_sort(F.collect_list("unique")).alias("files"))


# ---- Filters and page building ----


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, text FROM items WHERE item_type IN ('Text', 'FormField') """)
def filter_text_items(spark, sf_dir):
    return filters.text_items(items(spark, sf_dir), [1, 2]).select("doc_id", "page", "item_no", "text")


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, text FROM items WHERE item_type IN ('Text', 'FormField')""")
def filter_text_items_whole(spark, sf_dir):
    return filters.text_items(items(spark, sf_dir)).select("doc_id", "page", "item_no", "text")


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, x - 10 AS x, y - 20 AS y FROM items WHERE item_type IN ('Text', 'FormField')""")
def filter_table_elements(spark, sf_dir):
    i = items(spark, sf_dir)
    origins = i.select("doc_id", "page").distinct().withColumns({"page_x": F.lit(10.0), "page_y": F.lit(20.0)})
    return filters.table_elements(i, origins).select("doc_id", "page", "item_no", "x", "y")


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, x, y, width, font_size AS height FROM items WHERE item_type = 'Image' AND width > 0 AND font_size > 0""")
def filter_image_boxes(spark, sf_dir):
    return filters.image_boxes(items(spark, sf_dir))


@query(PAGE_TEXT.format(items=f"raw AS (WITH {ITEMS} SELECT * FROM items), items AS (SELECT * FROM raw WHERE item_type <> 'Image')", select="""SELECT o.doc_id, o.page, CASE WHEN same THEN 'old' ELSE markdown END AS markdown, CASE WHEN NOT same THEN len(meta)::INTEGER END AS lines
FROM (SELECT r.doc_id, r.page, p.markdown, p.meta, p.markdown IS NULL OR r.doc_id % 5 = 0 OR r.doc_id % 7 = 0 AS same FROM (SELECT DISTINCT doc_id, page FROM raw) r LEFT JOIN p ON p.doc_id = r.doc_id AND p.page = r.page) o"""))
def pages_rebuild_text(spark, sf_dir):
    i = items(spark, sf_dir)
    pages_ = i.select("doc_id", "page").distinct().withColumns({"markdown": F.lit("old"), "needs_ocr": F.col("doc_id") % 5 == 0, "has_table": F.col("doc_id") % 7 == 0})
    return filters.rebuild_text_pages(pages_, i).select("doc_id", "page", "markdown", F.size("line_meta").alias("lines"))


@query()
def pages_recognised_text(spark, sf_dir):
    return filters.ocr_page_text(blocks(spark, sf_dir))


@query("""SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 6)::INTEGER AS round FROM conversations WHERE turn % 3 <> 0""")
def pages_rounds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"markdown": F.lit(" "), "page": F.col("turn")})
    left = filters.still_to_recognise(c, c.filter("turn % 3 = 0"), ("conv_id", "page"))
    return filters.batches(left, keys=("conv_id", "page")).select("conv_id", "turn", "round")


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name ELSE substr(c_name, 1, 6) || '…' || right(c_name, 5) END AS short, c_mktsegment LIKE 'B%' AS inside, lower(hex(c_name)) AS hex FROM customer""")
def text_names(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", X.display_name(F.col("c_name"), 12).alias("short"), X.is_inside(F.concat(F.lit("/d/"), F.left("c_mktsegment", F.lit(1)), F.lit("/x")), F.lit("/d/B/")).alias("inside"), X.to_hex(F.col("c_name").cast("binary")).alias("hex"))


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def events_by_window(spark, sf_dir):
    from ..streaming.session import windowed_events

    return windowed_events(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 2))


# ---- More of the catalog, tables and folds ----


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_size FROM part)""")
def catalog_missing_files(spark, sf_dir):
    have = table(spark, sf_dir, "part").select(F.concat(F.lit("d/"), F.col("p_size")).alias("path"))
    return catalog.missing_files(table(spark, sf_dir, "supplier").withColumn("path", F.concat(F.lit("d/"), F.col("s_suppkey"))), have).select("s_suppkey", "s_name")


@query("""SELECT p_brand AS group_id, sum(p_size)::BIGINT AS size, bool_and(p_partkey % 9 <> 4) AS installed FROM part GROUP BY 1""")
def catalog_group_state(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("target"))
    return catalog.group_state(p, p.filter("target % 9 <> 4"))


@query("""SELECT id, 'm' || id AS model FROM (SELECT s_suppkey AS id, s_acctbal FROM supplier) WHERE id % 4 = 3 ORDER BY id LIMIT 1""")
def catalog_resolve_provider(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    model = F.struct(F.concat(F.lit("m"), F.col("s_suppkey")).alias("id"), F.lit("n").alias("name"), (F.col("s_suppkey") % 4 == 3).alias("default"))
    vendors = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("int").alias("ord"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("http://x").alias("base_url"), F.array(model).alias("models"))
    return catalog.resolve_provider(vendors)


@query("""SELECT event_id FROM events WHERE epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) < 1800000 AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id::VARCHAR LIMIT 32""")
def catalog_evict_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("ts <= timestamp'2024-01-20 00:00:00'")
    own = e.select(F.col("event_id").cast("string").alias("session_id"), F.unix_millis(F.to_timestamp("ts")).alias("start_ms"), "event_id")
    return catalog.evict_sessions(own, 1705708800000).select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0""")
def catalog_exportable(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), (F.col("o_custkey") % 3).alias("table_count"))
    return catalog.exportable(jobs, tables_only=True).select("o_orderkey")


@query("""SELECT count(*) FILTER (o_orderstatus = 'O')::BIGINT AS queued, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS converting, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, 0::BIGINT AS error, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS total_ms FROM orders""")
def usage_status_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "converting").otherwise("done")
    return usage.status_counts(o.select(name.alias("status"), F.col("o_custkey").alias("total_ms")))


@query("""SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN range(1, 1 + greatest(m, 3)) ELSE pages END)::INTEGER AS page FROM (SELECT l_orderkey AS doc_id, max(1 + l_linenumber % 2) AS m, list_distinct(array_agg(1 + l_linenumber % 2)) AS pages FROM lineitem GROUP BY 1)""")
def tables_expand_template(spark, sf_dir):
    own = items(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("last_page"), F.array_distinct(F.collect_list("page")).alias("pages"))
    draw = own.select("doc_id", F.explode("pages").alias("page"), (F.col("doc_id") % 2 == 0).alias("use_for_all_pages"), F.lit(None).cast("int").alias("max_pages"), F.lit(3).alias("total_pages"))
    return tables.expand_template(draw, own.select("doc_id", "last_page")).select("doc_id", F.col("page").cast("int").alias("page"))


@query(f"""WITH {ITEMS} SELECT doc_id, page, bool_or(150 <= x + width + 1 AND 300 >= x - 1) AS touched FROM items WHERE item_type = 'Image' GROUP BY 1, 2""")
def tables_touch_images(spark, sf_dir):
    boxes = filters.image_boxes(items(spark, sf_dir)).groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("images"))
    none = F.array().cast("array<double>")
    return boxes.select("doc_id", "page", tables.lines_touch_image(F.array(F.lit(150.0), F.lit(300.0)), none, F.array().cast(f"array<{BOX}>"), F.col("images")).alias("touched"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [2] ELSE [1] END AS kept FROM nation""")
def tables_remap_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    reals = lambda *v: F.array(*[F.lit(float(x)) if not hasattr(x, "cast") else x.cast("double") for x in v])
    new = F.when(F.col("n_nationkey") % 2 == 0, reals(0, 50, 100, 200)).otherwise(reals(0, 110, 200))
    return n.select("n_nationkey", tables.remap_merge_columns(reals(0, 100, 200), new, F.array(F.lit(1))).alias("kept"))


@query(f"""WITH {ITEMS} SELECT doc_id, page, sum(length(text))::BIGINT AS letters FROM items GROUP BY 1, 2""")
def tables_vertical_letters(spark, sf_dir):
    i = items(spark, sf_dir)
    draw = i.select("doc_id", "page").distinct().select("doc_id", "page", F.array(F.lit(150.0), F.lit(300.0)).alias("v_lines"), F.array().cast("array<int>").alias("merge_cols"), F.lit(2000.0).alias("page_width"))
    found = tables.vertical_tables(i, draw)
    return found.select("doc_id", "page", F.length(F.replace(F.array_join(F.flatten(F.concat(F.array("columns"), "rows")), ""), F.lit(" "))).cast("long").alias("letters"))


@query(f"""WITH {ITEMS} SELECT doc_id, page, (sum(length(text)) + count(*) - 1)::INTEGER AS n FROM items GROUP BY 1, 2""")
def lines_page_length(spark, sf_dir):
    return lines.page_text(lines.line_table(lines.text_lines(items(spark, sf_dir)))).select("doc_id", "page", F.length("markdown").alias("n"))


_IOU = "CASE WHEN k.w * k.h + x.w * x.h - {i} > 0 THEN {i} / (k.w * k.h + x.w * x.h - {i}) ELSE 0 END > 0.5".format(i="(greatest(least(k.x + k.w, x.x + x.w) - greatest(k.x, x.x), 0) * greatest(least(k.y + k.h, x.y + x.h) - greatest(k.y, x.y), 0))")


@query(f"""WITH {ITEMS}, d AS (SELECT doc_id, page, item_no, x AS ix, y AS iy, item_no % 100 / 100.0 AS score, (item_no % 17)::DOUBLE AS ro, least(x, 800) AS x, least(y, 800) AS y, least(x + width * 2, 800) - least(x, 800) AS w, least(y + 40, 800) - least(y, 800) AS h,
row_number() OVER (PARTITION BY doc_id, page ORDER BY item_no, x, y) AS n FROM items),
l AS (SELECT doc_id, page, array_agg({{'n': n, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY score DESC, n) AS s FROM d WHERE score >= 0.3 AND w > 0 AND h > 0 GROUP BY 1, 2)
SELECT doc_id, page, len(list_reduce(s, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_IOU})) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(n BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]))::BIGINT AS kept FROM l""")
def layout_suppress_counts(spark, sf_dir):
    kept = layout.suppress(layout.decode_detections(_detections(spark, sf_dir)))
    return kept.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("kept"))


#: Documents as lists of lines; ``keep``: texts of one line and table pages, which stay as they are.
_PAGES = """l AS (SELECT doc_id, list_transform(CASE WHEN text[-1:] = chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END, lambda x: rtrim(x, chr(13))) AS w, text FROM documents),
g AS (SELECT doc_id, text, w, list_filter(list_transform(w, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS f FROM l),
p AS (SELECT doc_id, text, w, list_sort(list_transform(f, lambda x: length(x)))[len(f) // 2 + 1] AS med, len(w) <= 1 OR (len(f) > 0 AND (2 * len(list_filter(f, lambda x: x[1] = '|')) >= len(f) OR len(list_filter(f, lambda x: x[1] = '|' AND contains(x, '---'))) > 0)) AS keep FROM g)"""
_JOIN = """SELECT doc_id, CASE WHEN keep THEN text ELSE array_to_string(list_reduce(list_transform(w, lambda x: [x]), lambda a, b:
 CASE WHEN trim(b[1], ' ') = '' OR trim(a[-1], ' ') = '' OR trim(b[1], ' ')[1] = '|' OR trim(a[-1], ' ')[1] = '|' {hard} THEN list_concat(a, b)
 WHEN regexp_matches(trim(a[-1], ' '), '[A-Za-z]-$') AND regexp_matches(b[1], '^ *[a-z]') THEN list_append(a[:-2], trim(a[-1], ' ')[:-2] || ltrim(b[1], ' '))
 ELSE list_append(a[:-2], trim(a[-1], ' ') || ' ' || ltrim(b[1], ' ')) END), chr(10)) END AS text FROM p"""
_HARD = """OR regexp_matches(trim(a[-1], ' '), '[.。！？…；;!?」』]$') OR b[1][1:2] = '  ' OR regexp_matches(trim(a[-1], ' '), '[:：]$') OR (med > 0 AND length(trim(a[-1], ' ')) * 2 < med)
 OR regexp_matches(trim(b[1], ' '), '^(?:[#>|*+•·○■▪●◦-]|```|~~~|[①-⑮⑴-⑽]|[0-9]+\\.\\s|[0-9]+[、)）:：]|[(（][0-9]+[)）]|[A-Za-z]\\.\\s)')"""


@query(f"WITH {_PAGES} {_JOIN.format(hard='')}")
def text_paragraphs_none(spark, sf_dir):
    return paragraphs.join_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "none")


@query(f"WITH {_PAGES} {_JOIN.format(hard=_HARD)}")
def text_paragraphs_smart(spark, sf_dir):
    return paragraphs.join_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "smart")


@query(f"""WITH {ITEMS}, t AS (SELECT doc_id, page, sum(length(text)) + count(*) - 1 AS n FROM items WHERE item_type <> 'Image' GROUP BY 1, 2)
SELECT doc_id, page, (CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR n IS NULL THEN 3 ELSE n END)::INTEGER AS n FROM (SELECT DISTINCT doc_id, page FROM items) LEFT JOIN t USING (doc_id, page)""")
def pages_rebuild_lengths(spark, sf_dir):
    return pages_rebuild_text(spark, sf_dir).select("doc_id", "page", F.length("markdown").alias("n"))


@query("""SELECT doc_id, text FROM documents""")
def md_preview_whole(spark, sf_dir):
    """The chunks of every document put together again."""
    chunks = md_preview_chunks(spark, sf_dir)
    return chunks.groupBy("doc_id").agg(lines.ordered_text(F.col("content"), F.col("chunk_no"), sep="\n").alias("text"))


def _letters(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page", (F.length("markdown") - F.length(F.replace("markdown", F.lit("P")))).alias("n"))


_BLOCK_COUNT = f"""WITH {ITEMS} SELECT doc_id, page, count(*)::INTEGER AS n FROM items GROUP BY 1, 2"""


@query(_BLOCK_COUNT)
def layout_assemble_letters(spark, sf_dir):
    """Every block's text is somewhere on its page (each holds one P)."""
    return _letters(layout_assemble(spark, sf_dir))


@query(_BLOCK_COUNT)
def pages_recognised_letters(spark, sf_dir):
    return _letters(pages_recognised_text(spark, sf_dir))


from . import wide, whole  # noqa: E402, F401 - add their queries
