"""Operators on the fixtures' cases."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog, exclusion, layout, lines, markdown, pages, paragraphs, tables, usage

RECT = "struct<x:double,y:double,width:double,height:double>"
FENCED = "```md\n| Not | Real |\n|---|---|\n| 0 | 0 |\n```"
MARKDOWN = {
    1: ("| Col A | Col B |\n|-------|-------|\n| 1     | x     |\n| 2     | y     |\n", [(None, ["Col A", "Col B"], [["1", "x"], ["2", "y"]])]),
    2: (f"intro\n\n{FENCED}\n\n| Real | Column |\n|------|--------|\n| 1    | x      |\n", [(None, ["Real", "Column"], [["1", "x"]])]),
    3: ("~~~\n| A | B |\n|---|---|\n| 1 | 2 |\n~~~\n", []),
    4: ("p\n| H1 |\n|---|\n| a |\n\nq\n| H1 | H2 | H3 |\n|:---:|---|---|\n| 1 | 2 | 3 |\n", [(None, ["H1"], [["a"]]), (None, ["H1", "H2", "H3"], [["1", "2", "3"]])]),
    5: ("| A | B |\n|---|---|\n| a\\|b |\n", [(None, ["A", "B"], [["a|b", ""]])]),
    6: ("| A | B |\n| 1 | 2 |\n", []),
    7: ("<!-- Page 1 -->\n| A |\n|---|\n| a |\n<!-- Page 3 -->\n| B |\n|---|\n| b |\n", [(1, ["A"], [["a"]]), (3, ["B"], [["b"]])]),
    8: ("<!-- 第 2 页 -->\n\n| A |\n|---|\n| a |\n", [(2, ["A"], [["a"]])]),
    10: ("<!-- OCR skipped (page 2): x -->\n| A |\n|---|\n| a |\n", [(None, ["A"], [["a"]])]),
    11: ("| stray |\n| A | B |\n|---|---|\n| 1 | 2 | 3 |\n|---|---|\n| 4 |\n", [(None, ["A", "B"], [["1", "2"], ["---", "---"], ["4", ""]])]),
    12: ("", []),
}


def test_parse_tables(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in MARKDOWN.items()], "doc_id long, text string")
    found = {}
    for r in markdown.parse_tables(docs).orderBy("doc_id", "table_no").collect():
        found.setdefault(r["doc_id"], []).append((r["page"], r["columns"], r["rows"]))
    assert found == {k: v[1] for k, v in MARKDOWN.items() if v[1]}
    blocks = [r["line"] for r in markdown.parse_blocks(docs.filter("doc_id = 11")).orderBy("block_no").collect()]
    assert blocks == ["| stray |", None]


def test_analyze_and_export(spark):
    docs = spark.createDataFrame([(1, "intro paragraph\n\n| A |\n|---|\n| 1 |\n\noutro text"), (2, "no table"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["table_count"], r["total_rows"], r["total_lines"]) for r in markdown.analyze(docs).collect()}
    assert got == {1: (1, 1, 7), 2: (0, 0, 1), 3: (0, 0, 0)}
    got = {r["doc_id"]: (r["table_count"], r["total_rows"], r["error"]) for r in markdown.export_totals(docs, tables_only=False).collect()}
    assert got == {1: (1, 3, None), 2: (0, 1, None), 3: (0, 0, "No content found in Markdown")}
    assert {r["error"] for r in markdown.export_totals(docs.filter("doc_id = 2")).collect()} == {"Table not found in Markdown"}


def test_sheet_cells(spark):
    docs = spark.createDataFrame([(1, "| A |\n|---|\n| **12%** |\n\n<!-- Page 4 -->\n| B | C |\n|---|---|\n| x | 7 |\n")], "doc_id long, text string")
    got = {(r["row"], r["col"]): (r["kind"], r["str_value"], r["num_value"]) for r in markdown.sheet_cells(docs).collect()}
    assert got == {(0, 0): ("label", "Table 1", None), (1, 0): ("header", "A", None), (2, 0): ("percent", None, 0.12), (4, 0): ("label", "Page 4", None), (5, 0): ("header", "B", None), (5, 1): ("header", "C", None), (6, 0): ("text", "x", None), (6, 1): ("num", None, 7.0)}


def test_preview_chunks(spark):
    long = "\n".join("" if i == 190 else f"l{i}" for i in range(450))
    docs = spark.createDataFrame([(1, long), (2, "a\n<!-- Page 2 -->\nb"), (3, "short")], "doc_id long, text string")
    got = {}
    for r in markdown.preview_chunks(docs).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append((r["marker"], r["content"]))
    assert [c.count("\n") + 1 for _, c in got[1]] == [191, 200, 59] and "\n".join(c for _, c in got[1]) == long
    assert got[2] == [("", "a\n"), ("<!-- Page 2 -->", "\nb")] and got[3] == [("", "short")]


def items(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, t, float(x), float(y), float(w), 12.0, 12.0, "Text") for i, (t, x, y, w) in enumerate(rows)], "doc_id long, page int, item_no long, text string, x double, y double, width double, height double, font_size double, item_type string")


def grid_items(spark):
    return items(spark, [(t, x, y, 24) for y, row in ((800, ("姓名", "年龄", "城市")), (780, ("张三", "28", "北京")), (760, ("李四", "35", "上海"))) for t, x in zip(row, (72, 240, 360), strict=True)])


def test_text_lines(spark):
    rows = lines.line_table(lines.text_lines(grid_items(spark)), separator="|")
    assert lines.page_text(rows).first()["markdown"] == "姓名|年龄|城市\n张三|28|北京\n李四|35|上海"
    assert lines.gfm_page(rows).first()["markdown"] == "| 姓名 | 年龄 | 城市 |\n| --- | --- | --- |\n| 张三 | 28 | 北京 |\n| 李四 | 35 | 上海 |"
    merged = items(spark, [("Name", 72, 790, 24), ("Age", 190, 790, 24), ("Alice    28    Beijing", 72, 770, 200)])
    assert lines.page_text(lines.line_table(lines.text_lines(merged), separator="|")).first()["markdown"] == "Name|Age\nAlice|28|Beijing"


def test_anchor_and_gap_differ(spark):
    own = items(spark, [("a", 0, 800, 5), ("b", 0, 796, 5), ("c", 0, 792, 5), ("d", 0, 780, 5)])
    assert [r["line_no"] for r in lines.text_lines(own).orderBy("seq").collect()] == [1, 1, 2, 3]
    blocks = own.select("doc_id", "page", F.col("item_no").alias("block_no"), "text", F.col("x").alias("left"), (-F.col("y")).alias("top"), F.lit(100).alias("height_px"))
    assert [r["line_no"] for r in lines.ocr_lines(blocks).orderBy("block_no").collect()] == [1, 1, 1, 2]


def test_exclusion(spark):
    spec = spark.createDataFrame([(1, True, None, [(1, [(0.0, 700.0, 595.0, 142.0)], 0.0, 0.0, 595.0, 842.0), (2, [], 0.0, 0.0, 595.0, 842.0)])], f"doc_id long, use_for_all_pages boolean, total_pages int, pages array<struct<page:int,rects:array<{RECT}>,page_x:double,page_y:double,page_width:double,page_height:double>>")
    counts = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    filters = exclusion.page_filters(spec, counts)
    assert sorted(r["page"] for r in filters.collect()) == [1, 3]
    got = exclusion.exclude_items(items(spark, [("header", 72, 780, 40), ("body", 72, 600, 40)]), filters)
    assert [r["text"] for r in got.collect()] == ["body"]
    band = spark.createDataFrame([(1, 1, [(120.0, 0.0, 20.0, 842.0)])], f"doc_id long, page int, rects array<{RECT}>")
    got = exclusion.exclude_items(items(spark, [("AB  CD", 100, 770, 60)]), band).orderBy("part_no").collect()
    assert [(r["text"], r["x"]) for r in got] == [("AB", 100.0), ("CD", 140.0)]
    two = spark.createDataFrame([(1, 1, [(0.0, 700.0, 20.0, 100.0), (50.0, 0.0, 20.0, 100.0)])], f"doc_id long, page int, rects array<{RECT}>")
    strict = exclusion.exclude_items(items(spark, [("abcdefghij", 0, 750, 100)]), two, strict_reference=True).orderBy("part_no").collect()
    assert [r["text"] for r in strict] == ["cde", "hij"]
    sane = exclusion.exclude_items(items(spark, [("abcdefghij", 0, 750, 100)]), two).collect()
    assert [r["text"] for r in sane] == ["cdefghij"]


def test_rebuild_pages(spark):
    pages_ = spark.createDataFrame([(1, 1, "old", False, False), (1, 2, "keep", False, False)], "doc_id long, page int, markdown string, needs_ocr boolean, has_table boolean")
    cut = spark.createDataFrame([(1, 1, [(340.0, 0.0, 260.0, 900.0)])], f"doc_id long, page int, rects array<{RECT}>")
    got = {r["page"]: r["markdown"] for r in exclusion.rebuild_pages(pages_, grid_items(spark), cut).collect()}
    assert got == {1: "姓名 年龄\n张三 28\n李四 35", 2: "keep"}
    got = exclusion.rebuild_pages(pages_.withColumn("has_table", F.lit(True)), grid_items(spark), cut).filter("page = 1").first()["markdown"]
    assert got == "| 姓名 | 年龄 |\n| --- | --- |\n| 张三 | 28 |\n| 李四 | 35 |"


def joined(spark, own, meta=None, mode="smart"):
    rows = spark.createDataFrame([(1, 1, "\n".join(own), [tuple(map(float, m)) for m in meta] if meta else None)], "doc_id long, page int, markdown string, line_meta array<struct<y:double,font_size:double,x0:double,x1:double>>")
    return paragraphs.join_pages(rows, mode).first()["markdown"]


def test_paragraphs(spark):
    assert joined(spark, ["第一行内容。", "第二行内容。", "第三行内容。"], [(800, 12, 72, 520), (786, 12, 72, 520), (772, 12, 72, 520)]) == "第一行内容。第二行内容。第三行内容。"
    assert joined(spark, ["This is the first", "inter-", "national standard."], [(800, 12, 72, 500), (786, 12, 72, 400), (772, 12, 72, 500)]) == "This is the first international standard."
    assert joined(spark, ["上一段结尾", "    这是一个缩进的新段落。"], [(800, 12, 72, 300), (786, 12, 96, 300)]) == "上一段结尾\n    这是一个缩进的新段落。"
    assert joined(spark, ["正文一行内容", "1. 第一", "2. 第二"]) == "正文一行内容\n1. 第一\n2. 第二"
    assert joined(spark, ["It is John's", "book, page one."]) == "It is John's book, page one."
    assert joined(spark, ["idx,desc", "1,this", "is", "test"], [(800, 12, 100, 340), (786, 12, 100, 340), (772, 12, 300, 315), (758, 12, 300, 340)]) == "idx,desc\n1,this is test"
    assert joined(spark, ["第一行", "第二行", "第三行"], mode="none") == "第一行第二行第三行"
    assert joined(spark, ["第一行", "第二行", "第三行"], mode="guided") == "第一行\n第二行\n第三行"
    assert joined(spark, ["| a |", "|---|", "| b |"]) == "| a |\n|---|\n| b |"
    fenced = ["prose", "```", "code", "code", "```", "prose"]
    assert joined(spark, fenced) == "\n".join(fenced)


def elements(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, float(x), float(y), 6.0 * len(t), 12.0) for i, (t, x, y) in enumerate(rows)], "doc_id long, page int, item_no long, text string, x double, y double, width double, font_size double")


def draw(spark, v, h=(), merge=(), width=600.0, height=842.0):
    return spark.createDataFrame([(1, 1, [float(x) for x in v], [float(x) for x in h], [], list(merge), width, height)], f"doc_id long, page int, v_lines array<double>, h_lines array<double>, rects array<{RECT}>, merge_cols array<int>, page_width double, page_height double")


WRAPPED = [("idx", 20, 800), ("desc", 220, 800), ("1", 20, 785), ("this", 220, 785), ("is", 220, 770), ("test", 220, 755)]


def test_vertical_tables(spark):
    def run(rows, mode="smart", v=(200,), merge=()):
        r = tables.vertical_tables(elements(spark, rows), draw(spark, v, merge=merge), mode).first()
        return r["columns"], r["rows"]

    assert run(WRAPPED) == (["idx", "desc"], [["1", "this is test"]])
    assert run(WRAPPED, "guided") == (["idx", "desc"], [["1", "this"], ["", "is"], ["", "test"]])
    assert run(WRAPPED, "guided", merge=[1]) == (["idx", "desc"], [["1", "this is test"]])
    assert run([*WRAPPED, ("2", 20, 740), ("that", 220, 740), ("note", 220, 700)]) == (["idx", "desc"], [["1", "this is test"], ["2", "that"], ["", "note"]])
    assert run([("value", 220, 800), ("a", 220, 785), ("b", 220, 770)]) == (["", "value"], [["", "a"], ["", "b"]])


def test_grid_and_rectangles(spark):
    own = elements(spark, [("姓名", 10, 120), ("年龄", 60, 120), ("张三", 10, 70), ("28", 60, 70)])
    r = tables.grid_tables(own, draw(spark, [45], [100], width=100.0, height=150.0)).first()
    assert (r["columns"], r["rows"]) == (["姓名", "年龄"], [["张三", "28"]])
    boxes = draw(spark, []).withColumn("rects", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(200.0).alias("height"))))
    r = tables.rectangle_tables(own, boxes).first()
    assert (r["columns"], r["rows"]) == (["姓名"], [["张三"]])


def test_image_tables(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "Name", 5.0, 5.0, 20.0, 10.0), (1, 1, 1, "Age", 60.0, 5.0, 20.0, 10.0), (1, 1, 2, "Al", 5.0, 40.0, 20.0, 10.0), (1, 1, 3, "28", 60.0, 40.0, 20.0, 10.0)], "doc_id long, page int, block_no long, text string, left double, top double, width double, height double")
    plan = spark.createDataFrame([(1, 1, [50.0], [30.0], 100, 100, [])], "doc_id long, page int, v_percents array<double>, h_percents array<double>, width_px int, height_px int, merge_cols array<int>")
    r = tables.image_tables(blocks, plan).first()
    assert (r["columns"], r["rows"]) == (["Name", "Age"], [["Al", "28"]])
    r = tables.image_tables(blocks, plan.withColumn("h_percents", F.array().cast("array<double>"))).first()
    assert (r["columns"], r["rows"]) == (["Name", "Age"], [["Al", "28"]])


def test_templates_and_remap(spark):
    plan = draw(spark, [200]).withColumns({"use_for_all_pages": F.lit(True), "max_pages": F.lit(None).cast("int"), "total_pages": F.lit(3)})
    last = spark.createDataFrame([(1, 2)], "doc_id long, last_page int")
    assert sorted(r["page"] for r in tables.expand_template(plan, last).collect()) == [1, 2, 3]
    reals = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert spark.sql("SELECT 1").select(tables.remap_merge_columns(reals(0, 100, 200), reals(0, 100, 150, 200), F.array(F.lit(1))).alias("r")).first()["r"] == [1]


def test_detector(spark):
    rows = [[3, 0.9, 400, 400, 800, 800, 2], [1, 0.8, 0, 0, 400, 400, 0], [4, 0.6, 100, 100, 600, 600, 1], [2, 0.1, 0, 0, 5, 5, 4], [9, 0.7, 10, 8, 20, 10, 3]]
    raw = spark.createDataFrame([(1, 1, [float(x) for r in rows for x in r], 0.5, ["text", "seal", "table", "doc_title", "image"], {"seal": "Seal", "doc_title": "Title"}, 800, 800, 1200, 1600, False)], "doc_id long, page int, data array<double>, score_threshold double, classes array<string>, bucket_map map<string,string>, input_width int, input_height int, width_px int, height_px int, keep_ratio boolean")
    found = layout.decode_detections(raw)
    assert [r["class"] for r in found.orderBy("reading_order").collect()] == ["seal", "figure", "title", "other"]
    kept = layout.suppress(found.unionByName(found.filter("class_id = 3").withColumns({"row_no": F.lit(9), "score": F.lit(0.55)})))
    assert [r["class"] for r in kept.orderBy("region_no").collect()] == ["seal", "figure", "title", "other"]


def test_layout_assembly(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "header text", 10.0, 5.0, 100.0, 10.0, 0.9), (1, 1, 1, "Doc title", 10.0, 100.0, 100.0, 30.0, 0.9), (1, 1, 2, "Body", 10.0, 300.0, 100.0, 12.0, 0.9), (1, 1, 3, "missed", 10.0, 900.0, 60.0, 12.0, 0.5)], "doc_id long, page int, block_no long, text string, left double, top double, width double, height double, confidence double")
    regions = spark.createDataFrame([(1, 1, 0, "header", 0.0, 0.0, 200.0, 30.0), (1, 1, 1, "title", 0.0, 90.0, 200.0, 40.0), (1, 1, 2, "text", 0.0, 290.0, 200.0, 50.0)], "doc_id long, page int, region_no int, class string, x double, y double, width double, height double")
    pages_ = spark.createDataFrame([(1, 1, 600, 1000)], "doc_id long, page int, width_px int, height_px int")
    assert layout.assemble(blocks, regions, pages_).first()["markdown"] == "<!-- 已过滤页眉: header text -->\n\n## Doc title\n\nBody\n\nmissed"
    assert round(layout.mean_confidence(blocks).first()["confidence"], 3) == 0.8
    columns = spark.createDataFrame([(1, 1, 0, "text", 300.0, 0.0, 200.0, 300.0), (1, 1, 1, "text", 0.0, 0.0, 200.0, 300.0)], regions.schema)
    assert [r["region_no"] for r in layout.reading_order(columns, pages_).orderBy("reading_no").collect()] == [1, 0]


def test_pages(spark):
    cases = [(None, 20, None), ("   ", 20, None), ("1-5", 20, [1, 2, 3, 4, 5]), ("1-5,8,12-14", 20, [1, 2, 3, 4, 5, 8, 12, 13, 14]), ("5-2,30,20", 20, [2, 3, 4, 5, 20]), ("0,99,3", 10, [3]), ("x,y", 10, None), ("-5", 10, None), ("1-2-3", 10, None), ("1-4294967295", 3, [1, 2, 3])]
    rows = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(cases)], "i int, s string, n int")
    assert [r["p"] for r in rows.select("i", pages.parse_range(F.col("s"), F.col("n")).alias("p")).orderBy("i").collect()] == [w for _, _, w in cases]
    text = spark.createDataFrame([(1, p, t) for p, t in ((1, "t1"), (2, ""), (3, "t3"), (4, "t4"))], "doc_id long, page int, markdown string")
    results = spark.createDataFrame([(1, 2, "ocr2")], "doc_id long, page int, ocr_markdown string")
    skipped = spark.createDataFrame([(1, 4, "why")], "doc_id long, page int, reason string")
    got = pages.assemble(pages.hybrid(text, results, skipped)).first()["markdown"]
    assert got == "<!-- Page 1 -->\n\nt1\n\n<!-- Page 2 -->\n\nocr2\n\n<!-- Page 3 -->\n\nt3\n\n<!-- Page 4 -->\n\n<!-- OCR skipped (page 4): why -->"


def test_usage(spark):
    log = spark.createDataFrame([("2024-01-05", "pdf", 1, 10, 3, "local", 900), ("2024-01-05", "drawTable", 1, 2, 0, None, 50), ("2024-01-02", "image", 1, 1, 1, "ai", 400), ("2023-12-31", "screenshot", 1, 1, 1, "local", 300)], "date string, kind string, fileCount long, pageCount long, ocrPageCount long, engine string, totalMs long")
    got = {r["period"]: r.asDict() for r in usage.usage_stats(log, "2024-01-05").collect()}
    assert (got["today"]["file_count"], got["today"]["page_count"], got["today"]["pdf_file_count"], got["today"]["local_ocr_page_count"]) == (2, 12, 2, 3)
    assert (got["month"]["total_ms"], got["month"]["image_file_count"], got["month"]["ai_ocr_page_count"]) == (1350, 1, 1)
    assert (got["total"]["ocr_page_count"], got["total"]["total_ms"], got["total"]["image_file_count"]) == (5, 1650, 2)
    assert all(v == 0 for r in usage.usage_stats(log.limit(0), "2024-01-05").collect() for k, v in r.asDict().items() if k != "period")


def test_catalog(spark):
    names = spark.sql("SELECT array('a', 'A', 'a (2)') AS n").select(catalog.unique_names(F.col("n")).alias("r")).first()["r"]
    assert names == ["a.md", "A (2).md", "a (2) (2).md"]
    sessions = spark.createDataFrame([(f"s{i}", i * 60_000) for i in range(40)], "session_id string, start_ms long")
    assert catalog.evict_sessions(sessions, 40 * 60_000).count() == 29
    assert catalog.evict_sessions(sessions, 39 * 60_000 + 1, most=5).count() == 5


@pytest.mark.parametrize("name", ["pages_convert_whole", "filter_text_items_whole"])
def test_whole_table_queries(spark, name):
    import duckdb

    from pagewright.plans.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = QUERIES[name](spark, sf)
    assert got.columns == columns and sorted(repr(tuple(r)) for r in got.collect()) == want and want
    if name == "filter_text_items_whole":
        assert got.select("page").distinct().count() == 2
    else:
        assert got.filter(F.col("markdown").contains("<!-- Page 4 -->") | F.array_contains("ocr_pages", 4)).count()


def test_draw_tables_on_all_pages_with_exclusions(spark):
    rows = [(1, page, i, t, float(x), float(y), 24.0, 12.0) for page in (1, 2, 4) for i, (t, x, y) in enumerate([("secret", 20, 820), ("Name", 20, 790), ("Age", 220, 790), ("Ann", 20, 770), ("28", 220, 770)])]
    elements = spark.createDataFrame(rows, "doc_id long, page int, item_no long, text string, x double, y double, width double, font_size double")
    kind = f"doc_id long, page int, use_for_all_pages boolean, v_lines array<double>, h_lines array<double>, rects array<{RECT}>, merge_cols array<int>, page_width double, page_height double"
    draw = spark.createDataFrame([(1, 1, True, [], [], [], [], 600.0, 842.0), (1, 2, True, [150.0], [], [], [], 600.0, 842.0)], kind)
    page = f"page:int,rects:array<{RECT}>,page_x:double,page_y:double,page_width:double,page_height:double"
    spec = spark.createDataFrame([(1, True, [(1, [(0.0, 815.0, 600.0, 27.0)], 5.0, 5.0, 600.0, 842.0), (4, [], 5.0, 5.0, 600.0, 842.0)])], f"doc_id long, use_for_all_pages boolean, pages array<struct<{page}>>")
    whole = {r["page"]: (r["table_no"], r["columns"]) for r in tables.draw_tables(elements, draw).collect()}
    assert {p: n for p, (n, _) in whole.items()} == {1: 1, 2: 2, 4: 3} and all("secret" in c for _, c in whole.values())
    got = {r["page"]: (r["columns"], r["rows"]) for r in tables.draw_tables(elements, draw, exclusions=spec).collect()}
    assert got[1] == got[2] == (["Name", "Age"], [["Ann", "28"]]) and got[4][0] == whole[4][1]
    # Recognised elements are cut as well: they are chosen first.
    images = elements.select("doc_id", "page", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(600.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    read = elements.withColumn("text", F.upper("text"))
    got = {r["page"]: r["columns"] for r in tables.draw_tables(elements, draw, ocr_elements=read, images=images, exclusions=spec).collect()}
    assert got[1] == got[2] == ["NAME", "AGE"] and "SECRET" in got[4]
    few = tables.draw_tables(elements, draw.withColumn("max_pages", F.lit(1)))
    assert [r["page"] for r in few.collect()] == [1]
    assert [r["page"] for r in tables.draw_tables(elements, draw, only_pages=[4]).collect()] == [4]


def test_drawn_tables_join_the_text(spark):
    docs = spark.createDataFrame([(1, "  Text \n", "z"), (2, " \n", "z"), (3, None, "z")], "doc_id long, text string, drawn string")
    found = spark.createDataFrame([(1, 1, 2, ["A"], [["x"]]), (1, 2, 2, ["B"], []), (1, 3, 4, ["C"], []), (2, 1, 1, ["A"], [])], "doc_id long, table_no int, page int, columns array<string>, rows array<array<string>>")
    got = {r["doc_id"]: r["text"] for r in tables.merge_into_markdown(docs, found).collect()}
    rule = "\n\n---\n\n"
    assert got[1] == "Text" + tables.DRAWN + "<!-- Page 2 -->\n\n| A |\n| --- |\n| x |\n" + rule + "| B |\n| --- |\n" + rule + "<!-- Page 4 -->\n\n| C |\n| --- |\n"
    assert got[2] == "<!-- Page 1 -->\n\n| A |\n| --- |\n" and got[3] == ""
    assert {r["doc_id"]: r["pages"] for r in tables.drawn_pages(found).collect()} == {1: 2, 2: 1}
