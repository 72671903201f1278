"""Scalar expressions on the fixtures' cases."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("line, page", [("<!-- Page 3 -->", 3), ("<!-- 第 3 页 -->", 3), ("<!-- Page 3-->", None), ("<!-- OCR failed (page 2): boom -->", None), ("plain", None), ("  <!-- Page +7 --> ", 7), ("<!-- Page 4294967296 -->", None)])
def test_page_from_line(spark, line, page):
    assert one(spark, line, X.page_from_line) == page


@pytest.mark.parametrize("text, kind, value", [("123", "num", 123.0), ("3.14", "num", 3.14), ("12%", "percent", 0.12), ("0", "num", 0.0), (".5", "num", 0.5), ("5.", "num", 5.0)] + [(t, None, None) for t in ("0012", "1,234.5", "abc", "", ".", "-5", "1d", "NaN", "1e3", "12 %", "00")])
def test_sniff_number(spark, text, kind, value):
    r = one(spark, text, X.sniff_number)
    assert (r["kind"], r["value"]) == (kind, value) if kind else r is None


@pytest.mark.parametrize("text, want", [("**bold**", "bold"), ("`code` sample", "code sample"), ("[link](https://example.com)", "link"), ("*a* and __b__", "a and b"), ("plain cell", "plain cell"), ("a<br/>b<br>c", "a\nb\nc"), ("3*4", "34")])
def test_strip_inline(spark, text, want):
    assert one(spark, text, X.strip_inline) == want


@pytest.mark.parametrize("text, want", [("日期﻿  ​  2026　年​\n第二　行", "日期 2026 年\n第二 行"), ("中A", "中 A"), ("hello world", "hello world"), ("", "")])
def test_clean_ocr(spark, text, want):
    assert one(spark, text, X.clean_ocr) == want


@pytest.mark.parametrize("text, n", [("姓名　　年龄　　部门", 3), ("P1  P2", 2), ("hello world", None), ("你好 世界", None)])
def test_column_gaps(spark, text, n):
    r = one(spark, text, X.column_gaps)
    assert (len(r) if r else None) == n


@pytest.mark.parametrize("text, want", [("A. first item", True), ("1. 条款", True), ("U.S. policy on trade", False), ("1.1 背景", False), ("- x", True), ("第一章 总则", True), ("① x", True), ("plain", False), ("", False)])
def test_starts_block(spark, text, want):
    assert one(spark, text, X.starts_block) is want


@pytest.mark.parametrize("text, want", [("| a\\|b |", ["a|b"]), ("| A | B |", ["A", "B"]), ("A | B", ["A", "B"]), ("||", [""])])
def test_split_cells(spark, text, want):
    assert one(spark, text, X.split_cells) == want


@pytest.mark.parametrize("text, want", [("|---|:-:|", True), ("|", False), ("| a |", False), ("|\t-|", False), ("| --- |", True)])
def test_is_delimiter(spark, text, want):
    assert one(spark, text, X.is_delimiter) is want


@pytest.mark.parametrize("text, want", [("a\nb\n", ["a", "b"]), ("a\r\n\r\nb", ["a", "", "b"]), ("", [])])
def test_lines(spark, text, want):
    assert one(spark, text, X.lines) == want


@pytest.mark.parametrize("parts, want", [(["inter-", "national"], "international"), (["名", "称"], "名称"), (["a", "", "b"], "a b"), ([], ""), (["End-", "Of"], "End- Of")])
def test_join_fragments(spark, parts, want):
    assert one(spark, parts, X.join_fragments, "array<string>") == want


@pytest.mark.parametrize("text, want", [("```md\nx\ny\n```", "x\ny"), ("```\n```", "```\n```"), (" plain ", "plain")])
def test_strip_fence(spark, text, want):
    assert one(spark, text, X.strip_fence) == want


@pytest.mark.parametrize("ms, want", [(0, "0ms"), (850, "850ms"), (1500, "1.5s"), (2000, "2s"), (125000, "2min 5s"), (3720000, "1h 2min")])
def test_duration(spark, ms, want):
    assert one(spark, ms, X.duration, "long") == want


@pytest.mark.parametrize("ext, want", [("png", "image/png"), ("jpg", "image/jpeg"), (".JPG", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", None), ("", None)])
def test_mime(spark, ext, want):
    assert one(spark, ext, X.mime) == want


@pytest.mark.parametrize("mode, want", [("weird", "guided"), ("keep", "guided"), ("smart", "smart"), ("NONE", "none")])
def test_paragraph_mode(spark, mode, want):
    assert one(spark, mode, X.paragraph_mode) == want


@pytest.mark.parametrize("name, want", [("doc_title", "title"), ("paragraph_title", "title"), ("text", "text"), ("table", "table"), ("figure", "figure"), ("page_header", "header"), ("page_footer", "footer"), ("seal", "seal"), ("something_new", "other")])
def test_layout_class(spark, name, want):
    assert one(spark, name, G.layout_class) == want


def test_map_model_point(spark):
    row = spark.sql("SELECT 1").select(G.map_model_point(*[F.lit(v) for v in (240.0, 240.0, 480, 480, 1200, 1600)], F.lit(False)).alias("a"), G.map_model_point(*[F.lit(v) for v in (400.0, 931.67, 800, 1330, 1200, 800)], F.lit(True)).alias("b")).first()
    assert (row["a"]["x"], row["a"]["y"]) == (600, 800)
    assert abs(row["b"]["x"] - 600) < 1 and abs(row["b"]["y"] - 800) < 1


def test_line_percents_and_points(spark):
    own = F.array(*[F.lit(v) for v in (75.0, 150.0, 400.0)])
    row = spark.sql("SELECT 1").select(G.line_percents(own, F.lit(2.5), F.lit(750.0)).alias("p"), G.line_percents(own, F.lit(0.0), F.lit(750.0)).alias("none"), G.pixel_to_point(*[F.lit(float(v)) for v in (20, 40, 50, 25, 500, 2.5)]).alias("q"), X.describe_positions("V", F.array(F.lit(25.0), F.lit(50.0))).alias("d")).first()
    assert [round(v, 6) for v in row["p"]] == [25, 50, 100] and row["none"] == []
    assert (row["q"]["x"], row["q"]["width"], row["q"]["y"], row["q"]["font_size"]) == (8, 20, 174, 10)
    assert row["d"] == "\nV: 25.0%, 50.0%"
