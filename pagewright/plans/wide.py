"""Queries that compare cells and text, not counts, over inputs that grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import exclusion, filters, layout, markdown, pages, tables
from ..sources import files
from .inputs import BLOCKS, ITEMS, blocks, items, table
from .queries import BOX, query

#: Line numbers repeat within an order: a number that tells apart items that differ in what is asked of them, the same in SQL.
_SEQ = "((l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT))"

# ---- Markdown: a document for each order ----


def orders_markdown(spark, sf_dir):
    """(doc_id, text): a line, a page marker, a table of the order's items, a fenced block that looks like a table, and a
    second table. Of the items' rows even ones are short and every third one is too long."""
    t = table(spark, sf_dir, "lineitem")
    part, rest = F.concat(F.lit("| "), F.col("l_linenumber"), F.lit(" | **P"), F.col("l_partkey"), F.lit("** |")), F.concat(F.lit(" "), F.col("l_quantity").cast("int"), F.lit("% | "), "l_returnflag", F.lit("\\|x |"))
    row = F.concat(part, F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(rest), F.when(F.col("l_linenumber") % 6 == 3, " more |").otherwise(""))
    own = t.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.expr(_SEQ).alias("n"), row.alias("r")))), lambda x: x["r"]).alias("rows"))
    key = F.col("l_orderkey")
    lines = F.concat(
        F.array(F.concat(F.lit("Order "), key), F.concat(F.lit("<!-- Page "), 1 + key % 3, F.lit(" -->")), F.lit(""), F.lit("| Line | Part | Share | Flag |"), F.lit("|:--|---|--:|---|")), "rows",
        F.array(*map(F.lit, ["```", "| not | a table |", "| --- | --- |", "```"])), F.array(F.lit("| Items |"), F.lit("| --- |"), F.concat(F.lit("| "), F.size("rows"), F.lit(" |"))),
    )
    return own.select(key.alias("doc_id"), F.array_join(lines, "\n").alias("text"))


_ROWS = f"""l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) AS k, l_partkey AS part, l_quantity::INTEGER AS qty, l_returnflag AS flag, l_linenumber % 2 = 0 AS short FROM lineitem),
d AS (SELECT doc_id, count(*) AS n, 1 + doc_id % 3 AS page FROM l GROUP BY doc_id)"""


@query(f"""WITH {_ROWS} SELECT doc_id, 1 AS table_no, k::INTEGER AS row_no, c.col AS col_no, CASE c.col WHEN 0 THEN n::VARCHAR WHEN 1 THEN '**P' || part || '**' WHEN 2 THEN CASE WHEN short THEN '' ELSE qty || '%' END ELSE CASE WHEN short THEN '' ELSE flag || '|x' END END AS value FROM l, (VALUES (0), (1), (2), (3)) c(col)
UNION ALL SELECT doc_id, 1, 0, c.col, c.v FROM d, (VALUES (0, 'Line'), (1, 'Part'), (2, 'Share'), (3, 'Flag')) c(col, v)
UNION ALL SELECT doc_id, 2, r.k, 0, CASE r.k WHEN 0 THEN 'Items' ELSE n::VARCHAR END FROM d, (VALUES (0), (1)) r(k)""")
def md_order_cells(spark, sf_dir):
    return markdown.cells(markdown.parse_tables(orders_markdown(spark, sf_dir)))


@query(f"""WITH {_ROWS} SELECT doc_id, table_no, page, columns, "rows" FROM (
SELECT doc_id, 1 AS table_no, page::BIGINT AS page, ['Line', 'Part', 'Share', 'Flag'] AS columns, (SELECT list([n::VARCHAR, '**P' || part || '**', CASE WHEN short THEN '' ELSE qty || '%' END, CASE WHEN short THEN '' ELSE flag || '|x' END] ORDER BY k) FROM l WHERE l.doc_id = d.doc_id) AS "rows" FROM d
UNION ALL SELECT doc_id, 2, page, ['Items'], [[n::VARCHAR]] FROM d)""")
def md_order_tables(spark, sf_dir):
    return markdown.parse_tables(orders_markdown(spark, sf_dir)).drop("pos")


@query(f"""WITH {_ROWS} SELECT doc_id, 0::BIGINT AS "row", 0 AS col, 'label' AS kind, 'Page ' || page AS str_value, NULL::DOUBLE AS num_value, 'label' AS format FROM d
UNION ALL SELECT doc_id, 1, c.col, 'header', c.v, NULL, 'header' FROM d, (VALUES (0, 'Line'), (1, 'Part'), (2, 'Share'), (3, 'Flag')) c(col, v)
UNION ALL SELECT doc_id, k + 1, 0, 'num', NULL, n, 'cell' FROM l
UNION ALL SELECT doc_id, k + 1, 1, 'text', 'P' || part, NULL, 'cell' FROM l
UNION ALL SELECT doc_id, k + 1, 2, CASE WHEN short THEN 'text' ELSE 'percent' END, CASE WHEN short THEN '' END, CASE WHEN NOT short THEN qty / 100.0 END, CASE WHEN short THEN 'cell' ELSE '0.00%' END FROM l
UNION ALL SELECT doc_id, k + 1, 3, 'text', CASE WHEN short THEN '' ELSE flag || '|x' END, NULL, 'cell' FROM l
UNION ALL SELECT doc_id, n + 3, 0, 'label', 'Page ' || page, NULL, 'label' FROM d UNION ALL SELECT doc_id, n + 4, 0, 'header', 'Items', NULL, 'header' FROM d UNION ALL SELECT doc_id, n + 5, 0, 'num', NULL, n, 'cell' FROM d""")
def md_order_sheet(spark, sf_dir):
    return markdown.sheet_cells(orders_markdown(spark, sf_dir))


@query(f"""WITH {_ROWS} SELECT doc_id, b.k AS block_no, b.kind, CASE b.k WHEN 1 THEN 'Order ' || doc_id ELSE b.line END AS line, CASE WHEN b.kind = 'table' THEN page END::BIGINT AS page FROM d,
(VALUES (1, 'line', NULL), (2, 'table', NULL), (3, 'line', '```'), (4, 'line', '| not | a table |'), (5, 'line', '| --- | --- |'), (6, 'line', '```'), (7, 'table', NULL)) b(k, kind, line)""")
def md_order_blocks(spark, sf_dir):
    return markdown.parse_blocks(orders_markdown(spark, sf_dir)).select("doc_id", "block_no", "kind", "line", "page")


@query(f"""WITH {_ROWS} SELECT doc_id, 2::BIGINT AS table_count, (n + 1)::BIGINT AS total_rows, (n + 12)::BIGINT AS total_lines FROM d""")
def md_order_analysis(spark, sf_dir):
    return markdown.analyze(orders_markdown(spark, sf_dir))


@query(f"""WITH {_ROWS} SELECT doc_id, 2::BIGINT AS table_count, (n + 6)::BIGINT AS total_rows, NULL::VARCHAR AS error FROM d""")
def md_order_export(spark, sf_dir):
    return markdown.export_totals(orders_markdown(spark, sf_dir), tables_only=False)


#: The chunks of every document: a line count at most, or the last blank line before, else the first one after it.
_CHUNKS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n, NOT regexp_full_match(text, '[\\s\\x0B\\x85\\p{Z}]*') AND len(string_split(text, chr(10))) > 200 AS long FROM documents),
b AS (SELECT doc_id, n, list_filter(range(0, n), lambda i: regexp_full_match(l[i + 1], '[\\s\\x0B\\x85\\p{Z}]*')) AS blank FROM l WHERE long),
s AS (SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS a, (SELECT CASE WHEN 200 < n THEN coalesce(list_max(list_filter(blank, lambda i: i BETWEEN 160 AND 199)) + 1, list_min(list_filter(blank, lambda i: i BETWEEN 200 AND least(n - 1, 239))), 200) ELSE n END)::BIGINT AS z FROM b
UNION ALL SELECT doc_id, chunk_no + 1, z, CASE WHEN z + 200 < n THEN coalesce(list_max(list_filter(blank, lambda i: i BETWEEN z + 160 AND z + 199)) + 1, list_min(list_filter(blank, lambda i: i BETWEEN z + 200 AND least(n - 1, z + 239))), z + 200) ELSE n END::BIGINT FROM s JOIN b USING (doc_id) WHERE z < n)"""


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_no, '' AS marker, array_to_string(l[a + 1:z], chr(10)) AS content FROM s JOIN l USING (doc_id) UNION ALL SELECT doc_id, 0, '', array_to_string(l, chr(10)) FROM l WHERE NOT long
UNION ALL SELECT 10000000 + l_orderkey, c.k, CASE c.k WHEN 0 THEN '' ELSE '<!-- Page ' || (1 + l_orderkey % 3) || ' -->' END, CASE c.k WHEN 0 THEN 'Order ' || l_orderkey || chr(10) ELSE chr(10) || count(*) || ' items' END FROM lineitem, (VALUES (0), (1)) c(k) GROUP BY l_orderkey, c.k""")
def md_chunk_text(spark, sf_dir):
    """Chunks word by word: every document, short or long, and orders that a page marker cuts in two."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = t.select((10_000_000 + F.col("l_orderkey")).alias("doc_id"), F.concat(F.lit("Order "), "l_orderkey", F.lit("\n<!-- Page "), 1 + F.col("l_orderkey") % 3, F.lit(" -->\n"), "n", F.lit(" items")).alias("text"))
    return markdown.preview_chunks(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(orders))


# ---- Drawn tables, cell by cell ----


def _draw(i, v=(), h=(), rects=()):
    reals = lambda values: F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
    box = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(r, ("x", "y", "width", "height"), strict=True)]) for r in rects]).cast(f"array<{BOX}>")
    return i.select("doc_id", "page").distinct().select("doc_id", "page", reals(v).alias("v_lines"), reals(h).alias("h_lines"), box.alias("rects"), F.array().cast("array<int>").alias("merge_cols"), F.lit(2000.0).alias("page_width"), F.lit(842.0).alias("page_height"))


def _elements(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", "page", "item_no", "text", "x", "y", "width", "font_size")


def _exploded(found, *keys):
    grid = found.select(*keys, F.posexplode(F.concat(F.array("columns"), "rows")).alias("row_no", "r"))
    return grid.select(*keys, "row_no", F.posexplode("r").alias("col_no", "value"))


#: Items with ``part``, the band or box that a table line lies within, folded into lines.
_LINED = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, part ORDER BY y DESC, x, item_no) AS k FROM e),
f AS (SELECT o.*, y AS anchor, 1 AS line_no FROM o WHERE k = 1
UNION ALL SELECT o.*, CASE WHEN abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3) THEN o.y ELSE f.anchor END, f.line_no + (abs(o.y - f.anchor) >= greatest(0.4 * o.font_size, 3))::INTEGER FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.part = f.part AND o.k = f.k + 1)"""


@query(f"""WITH RECURSIVE {ITEMS}, e AS (SELECT *, CASE WHEN y + font_size / 2 < 400 THEN 1 ELSE 0 END AS part FROM items WHERE y + font_size / 2 < 842), {_LINED},
c AS (SELECT doc_id, page, part, line_no, k, unnest(range(0, length(text))) AS j, text, x, width FROM f),
g AS (SELECT *, text[j + 1:j + 1] AS ch, x + (j + 0.5) * width / length(text) AS mid FROM c),
l AS (SELECT doc_id, page, part, line_no, CASE WHEN mid < 150 THEN 0 WHEN mid < 300 THEN 1 ELSE 2 END AS col, string_agg(ch, '' ORDER BY k, j) AS v FROM g GROUP BY ALL),
b AS (SELECT doc_id, page, part, col, string_agg(v, ' ' ORDER BY line_no) AS v FROM l GROUP BY ALL)
SELECT doc_id, page, r.part AS row_no, c.col AS col_no, coalesce(v, '') AS value FROM (SELECT DISTINCT doc_id, page FROM e) CROSS JOIN (VALUES (0), (1)) r(part) CROSS JOIN (VALUES (0), (1), (2)) c(col) LEFT JOIN b USING (doc_id, page, part, col)""")
def tables_grid_cells(spark, sf_dir):
    i = _elements(spark, sf_dir)
    return _exploded(tables.grid_tables(i, _draw(i, (300, 150, 300), (400,))), "doc_id", "page")


@query(f"""WITH RECURSIVE {ITEMS}, r(part, rx, ry, rw, rh) AS (VALUES (0, 100, 100, 200, 300), (1, 250, 300, 250, 500)),
e AS (SELECT items.*, part FROM items, r WHERE x < rx + rw AND rx < x + width AND y < ry + rh AND ry < y + font_size), {_LINED},
n AS (SELECT doc_id, page, part, count(*) AS n FROM f WHERE line_no = 1 GROUP BY ALL),
i AS (SELECT doc_id, page, part, line_no, row_number() OVER (PARTITION BY doc_id, page, part, line_no ORDER BY k) - 1 AS col, text FROM f),
one AS (SELECT doc_id, page, part, line_no, string_agg(text, ' ' ORDER BY col) AS v FROM i GROUP BY ALL),
g AS (SELECT doc_id, page, part, line_no, unnest(range(0, n)) AS col, n FROM (SELECT DISTINCT doc_id, page, part, line_no FROM f) JOIN n USING (doc_id, page, part))
SELECT doc_id, page, part AS rect_no, line_no - 1 AS row_no, col::INTEGER AS col_no, CASE WHEN n = 1 THEN one.v ELSE coalesce(i.text, '') END AS value FROM g LEFT JOIN i USING (doc_id, page, part, line_no, col) LEFT JOIN one USING (doc_id, page, part, line_no)""")
def tables_rectangle_cells(spark, sf_dir):
    i = _elements(spark, sf_dir)
    found = tables.rectangle_tables(i, _draw(i, rects=((100, 100, 200, 300), (250, 300, 250, 500))))
    return _exploded(found, "doc_id", "page", "rect_no")


@query(f"""WITH {BLOCKS}, p AS (SELECT DISTINCT doc_id, page FROM blocks),
e AS (SELECT *, CASE WHEN top + height / 2 < 421 THEN 0 ELSE 1 END AS band, CASE WHEN "left" + width / 2 < 149.999 THEN 0 WHEN "left" + width / 2 < 599.999 THEN 1 END AS col FROM blocks WHERE top + height / 2 < 842),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, band ORDER BY top, "left", block_no) AS k FROM e)
SELECT p.doc_id, p.page, b.band AS row_no, c.col AS col_no, length(coalesce(replace(string_agg(text, '' ORDER BY k), ' ', ''), ''))::INTEGER AS letters FROM p, (VALUES (0), (1)) b(band), (VALUES (0), (1)) c(col) LEFT JOIN o ON o.doc_id = p.doc_id AND o.page = p.page AND o.band = b.band AND o.col = c.col
WHERE p IN (SELECT (doc_id, page) FROM (SELECT DISTINCT doc_id, page FROM e WHERE col IS NOT NULL)) GROUP BY ALL""")
def tables_image_letters(spark, sf_dir):
    b = blocks(spark, sf_dir)
    draw = b.select("doc_id", "page").distinct().select("doc_id", "page", F.array(F.lit(25.0)).alias("v_percents"), F.array(F.lit(50.0)).alias("h_percents"), F.lit(600).alias("width_px"), F.lit(842).alias("height_px"), F.array().cast("array<int>").alias("merge_cols"))
    found = _exploded(tables.image_tables(b.drop("width_px", "height_px"), draw), "doc_id", "page")
    return found.select("doc_id", "page", "row_no", "col_no", F.length(F.replace("value", F.lit(" "), F.lit(""))).alias("letters"))


_MERGED = f"t AS (SELECT l_orderkey AS doc_id, {_SEQ} AS table_no, 1 + l_linenumber // 3 AS page, l_partkey AS part, l_quantity::INTEGER AS qty FROM lineitem WHERE l_orderkey % 5 <> 0)"


@query(f"""WITH {_MERGED}, m AS (SELECT doc_id, string_agg(CASE WHEN prev IS NULL THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || CASE WHEN prev = page THEN '' ELSE '<!-- Page ' || page || ' -->' || chr(10) || chr(10) END
 || '| Part | Qty |' || chr(10) || '| --- | --- |' || chr(10) || '| P' || part || ' | ' || qty || ' |' || chr(10), '' ORDER BY table_no) AS drawn FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY table_no) AS prev FROM t) GROUP BY doc_id)
SELECT o_orderkey AS doc_id, CASE WHEN drawn IS NULL THEN CASE o_custkey % 3 WHEN 0 THEN '  Order ' || o_orderkey || chr(10) WHEN 1 THEN ' ' || chr(10) ELSE '' END WHEN o_custkey % 3 <> 0 THEN drawn
 ELSE 'Order ' || o_orderkey || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- Draw lines to extract tables -->' || chr(10) || chr(10) || drawn END AS text FROM orders LEFT JOIN m ON doc_id = o_orderkey""")
def tables_merge_text(spark, sf_dir):
    """Drawn tables appended to texts that are blank, null or in need of trimming."""
    t = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 5 != 0)
    cells = F.array(F.concat(F.lit("P"), "l_partkey"), F.col("l_quantity").cast("int").cast("string"))
    drawn = t.select(F.col("l_orderkey").alias("doc_id"), F.expr(_SEQ).alias("table_no"), (1 + F.floor(F.col("l_linenumber") / 3)).cast("int").alias("page"), F.array(F.lit("Part"), F.lit("Qty")).alias("columns"), F.array(cells).alias("rows"))
    text = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("  Order "), "o_orderkey", F.lit("\n"))).when(F.col("o_custkey") % 3 == 1, " \n")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return tables.merge_into_markdown(docs, drawn)


@query(f"""WITH {_MERGED} SELECT doc_id, count(DISTINCT page)::BIGINT AS pages FROM t GROUP BY doc_id""")
def tables_drawn_pages(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 5 != 0)
    return tables.drawn_pages(t.select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("l_linenumber") / 3).alias("page")))


# ---- Exclusions ----


def _spec(spark, sf_dir):
    """Each order's specification: boxes on page 1, half of the orders with an entry for page 2 that has none."""
    one = f"named_struct('page', 1, 'rects', array(named_struct('x', 100D, 'y', 100D, 'width', 120D, 'height', 200D), named_struct('x', 500D, 'y', 800D, 'width', 200D, 'height', 100D), named_struct('x', 700D, 'y', 0D, 'width', 5D, 'height', 5D)), 'page_width', 600D, 'page_height', 842D, 'page_x', 5D, 'page_y', 7D)"  # noqa: F541
    two = f"named_struct('page', 2, 'rects', cast(array() as array<{BOX}>), 'page_width', 600D, 'page_height', 842D, 'page_x', 5D, 'page_y', 7D)"
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.expr(f"array({one}, {two})")).otherwise(F.expr(f"array({one})")).alias("pages"), (F.col("o_custkey") % 3 == 0).alias("use_for_all_pages"), F.lit(None).cast("int").alias("total_pages"))


@query("""SELECT o_orderkey AS doc_id, p.n AS page, r.x, r.y, r.w AS width, r.h AS height FROM orders, (VALUES (1), (2), (3)) p(n), (VALUES (105.0::DOUBLE, 107.0::DOUBLE, 120.0::DOUBLE, 200.0::DOUBLE), (505, 807, 100, 42)) r(x, y, w, h)
WHERE p.n = 1 OR (o_custkey % 3 = 0 AND NOT (p.n = 2 AND o_orderkey % 2 = 0))""")
def exclude_page_filters(spark, sf_dir):
    """The boxes that hold for each page: its own, none where its own entry is empty, or those of the template."""
    spec = _spec(spark, sf_dir)
    found = exclusion.page_filters(spec, spec.select("doc_id", F.lit(3).alias("page_count")))
    return found.select("doc_id", "page", F.explode("rects").alias("r")).select("doc_id", "page", "r.*")


@query("""SELECT o_orderkey AS doc_id, 3 AS rects, CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [1] END AS before, [2] AS after FROM orders""")
def exclude_replace_page(spark, sf_dir):
    """Counts of boxes, and the pages of a specification once page 1 has lost its boxes and page 2 has got one."""
    spec = _spec(spark, sf_dir)
    entry = lambda page, boxes: F.expr(f"named_struct('page', {page}, 'rects', cast({boxes} as array<{BOX}>), 'page_width', 600D, 'page_height', 842D, 'page_x', 5D, 'page_y', 7D)")
    after = exclusion.with_page_rects(exclusion.with_page_rects(F.col("pages"), entry(1, "array()")), entry(2, "array(named_struct('x', 1D, 'y', 1D, 'width', 1D, 'height', 1D))"))
    return exclusion.count_rects(spec).join(spec.select("doc_id", F.transform("pages", lambda p: p["page"]).alias("before"), F.transform(after, lambda p: p["page"]).alias("after")), "doc_id")


# ---- Small functions over whole tables ----


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] END AS gaps, CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE '```' || chr(10) || p_name END AS bare,
replace(p_name, ' ', '\\|') AS escaped, p_name[1:5] AS snip, p_partkey % 2 = 1 AS cjk, p_partkey % 4 = 1 OR p_partkey % 4 = 2 AS block FROM part""")
def text_part_names(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    gap = F.when(k % 2 == 0, "   ").otherwise(" ")
    fenced = F.when(k % 3 == 0, F.concat(F.lit("```md\n"), "p_name", F.lit("\n"), "p_brand", F.lit("\n```\n"))).when(k % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit("\n"))).otherwise(F.concat(F.lit("```\n"), "p_name"))
    marked = F.concat(F.when(k % 4 == 0, "第、").when(k % 4 == 1, "第一章 ").when(k % 4 == 2, "1. ").otherwise("1.5 "), F.col("p_name"))
    return t.select("p_partkey", X.column_gaps(F.concat("p_brand", gap, "p_type")).alias("gaps"), X.strip_fence(fenced).alias("bare"), X.escape_cell(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("escaped"), X.snippet(F.col("p_name"), 5).alias("snip"), X.is_cjk(F.when(k % 2 == 1, "字").otherwise("x")).alias("cjk"), X.starts_block(marked).alias("block"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'ai' ELSE NULL END AS engine, CASE o_orderkey % 4 WHEN 0 THEN 'smart' WHEN 1 THEN 'none' ELSE 'guided' END AS paragraphs, CASE o_orderkey % 4 WHEN 2 THEN 'paddle' ELSE 'off' END AS layout,
'http://h' || o_custkey || CASE o_orderkey % 4 WHEN 3 THEN '/chat/completions' ELSE '/v1/chat/completions' END AS url, strftime(o_orderdate, '%Y-%m') AS "month", CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE chr(10) || 'At: ' || o_orderkey % 4 || '.0%, ' || o_orderkey % 4 * 10 || '.5%' END AS places FROM orders""")
def text_order_settings(spark, sf_dir):
    t, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), k.cast("int"))
    base = F.concat(F.lit(" http://h"), "o_custkey", pick("", "/", "/v1/", "/chat/completions"))
    places = F.when(k == 0, F.array().cast("array<double>")).otherwise(F.array(k.cast("double"), k * 10 + 0.5))
    return t.select("o_orderkey", X.engine_of(pick("localAll", "aiHybrid", "off", "none")).alias("engine"), X.paragraph_mode(pick(" Unwrap", "single", "x", "")).alias("paragraphs"), X.layout_mode(pick("", "off", " MNN ", "x")).alias("layout"), X.completions_url(base).alias("url"), X.month(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month"), X.describe_positions("At", places).alias("places"))


@query(f"""WITH {ITEMS} SELECT doc_id, page, item_no, CASE WHEN w >= 4 AND h >= 4 THEN x0 END AS rx, CASE WHEN w >= 4 AND h >= 4 THEN w END AS rw, CASE WHEN w >= 4 AND h >= 4 THEN h END AS rh, least(x * 2 / 600 * 100, 100.0) AS percent,
greatest(least(w, 16), 1) AS concurrency FROM (SELECT *, greatest(x::BIGINT - 20, 0) AS x0, least(x::BIGINT - 20 + 100, 300) - greatest(x::BIGINT - 20, 0) AS w, least(y::BIGINT + 50, 500) - y::BIGINT AS h FROM items)""")
def geometry_regions(spark, sf_dir):
    i = items(spark, sf_dir)
    x, y = F.col("x").cast("long") - 20, F.col("y").cast("long")
    n = lambda v: F.lit(v).cast("long")
    w = F.least(x + 100, n(300)) - F.greatest(x, n(0))
    own = i.withColumns({"r": G.clamp_region(x, y, n(100), n(50), n(300), n(500)), "concurrency": w, "threads": n(0), "opacity": n(0)})
    return files.clamp_settings(own).select("doc_id", "page", "item_no", F.col("r.x").alias("rx"), F.col("r.width").alias("rw"), F.col("r.height").alias("rh"), F.get(G.line_percents(F.array("x"), F.lit(2.0), F.lit(600.0)), F.lit(0)).alias("percent"), "concurrency")


@query(f"""WITH {ITEMS}, c AS (SELECT doc_id, page, item_no, item_no % 10 / 10.0 AS conf, item_no % 4 = 0 AS empty, item_no % 6 AS k FROM items),
b AS (SELECT DISTINCT doc_id, page, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'title' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'header' END AS bucket, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE k + 1 END AS o FROM c WHERE k < 5)
SELECT doc_id, page, coalesce(round(avg(conf) FILTER (NOT empty), 6), 0.0)::DOUBLE AS confidence, coalesce((SELECT list(bucket ORDER BY o) FROM b WHERE b.doc_id = c.doc_id AND b.page = c.page), []) AS buckets FROM c GROUP BY doc_id, page""")
def layout_page_measures(spark, sf_dir):
    """Mean confidence of blocks with text, and the buckets of a page's classes in their fixed order."""
    i = items(spark, sf_dir)
    b = i.select("doc_id", "page", F.when(F.col("item_no") % 4 == 0, " ").otherwise("t").alias("text"), (F.col("item_no") % 10 / 10.0).alias("confidence"), F.get(F.array(*map(F.lit, ["abstract", "Doc_Title", "table", "chart", "header", "stamp"])), (F.col("item_no") % 6).cast("int")).alias("class"))
    kinds = b.groupBy("doc_id", "page").agg(layout.distinct_buckets(F.collect_list("class")).alias("buckets"))
    return layout.mean_confidence(b).withColumn("confidence", F.round("confidence", 6)).join(kinds, ["doc_id", "page"])


# ---- Pages ----


@query(f"""WITH a AS (SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, {_SEQ} AS seq, l_partkey AS part, l_quantity / 50.0 AS conf FROM lineitem),
m AS (SELECT doc_id, round(avg(conf), 6) AS mean FROM a GROUP BY doc_id) SELECT doc_id, page, 'P' || arg_max(part, seq) AS ocr_markdown, arg_max(conf, seq)::DOUBLE AS confidence, mean::DOUBLE AS mean FROM a JOIN m USING (doc_id) GROUP BY doc_id, page, mean""")
def pages_attempts(spark, sf_dir):
    """The last recognition of each page, and the mean confidence over all attempts."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (1 + F.col("l_linenumber") % 2).alias("page"), F.expr(_SEQ).alias("seq"), F.concat(F.lit("P"), "l_partkey").alias("ocr_markdown"), (F.col("l_quantity") / 50.0).alias("confidence"))
    mean = pages.confidence_of_attempts(a).select("doc_id", F.round("confidence", 6).alias("mean"))
    return pages.latest_results(a).join(mean, "doc_id")


@query("""SELECT conv_id AS doc_id, 'scanned' AS kind, 0.5::DOUBLE AS confidence, list_sort(list_distinct(list_append(coalesce(list(turn::INTEGER) FILTER (turn % 3 = 0), []), 1))) AS ocr_pages FROM conversations GROUP BY conv_id""")
def pages_detect(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.col("text")).alias("markdown"))
    found = own.select("doc_id").distinct().select("doc_id", F.lit("scanned").alias("kind"), F.lit(0.5).alias("confidence"), F.array(F.lit(1)).alias("ocr_pages"))
    return pages.detect_status(found, own)


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) AS n, l_partkey AS part, l_linenumber % 4 <> 2 AS has FROM lineitem)
SELECT doc_id, string_agg('<!-- Image ' || n || ' -->' || chr(10) || chr(10) || 'P' || part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS markdown FROM i WHERE has GROUP BY doc_id""")
def pages_merge_images(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") % 4 == 2, " \n").otherwise(F.concat(F.lit(" P"), "l_partkey", F.lit("\n")))
    return pages.merge_images(t.select(F.col("l_orderkey").alias("doc_id"), F.expr(_SEQ).alias("item_no"), text.alias("markdown")))


@query("""SELECT o_orderkey AS doc_id, greatest(coalesce(max(l_linenumber), 0), CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END)::INTEGER AS last_page FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def pages_last(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, 4).alias("total_pages"))
    return pages.max_page(t, docs)


@query("""SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 2 = 0 THEN 'new' END AS image, CASE WHEN turn % 2 = 0 THEN 2.5 END::DOUBLE AS render_scale FROM conversations""")
def pages_images(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    images = c.filter("page % 2 = 0").select("doc_id", "page", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("new").alias("image"), F.lit(2.5).alias("render_scale")), F.struct(F.lit(0).alias("seq"), F.lit("old").alias("image"), F.lit(2.0).alias("render_scale")))).alias("i"))
    return filters.page_images(c, images.select("doc_id", "page", "i.*")).select("doc_id", "page", "image", "render_scale")
