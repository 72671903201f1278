"""Folds and page sets against small models, many random cases in one DataFrame each."""

import random
import time

from pyspark.sql import functions as F

from pagewright.functions import arrays
from pagewright.functions import text as X
from pagewright.operators import catalog, layout, lines, pages, paragraphs, tables


def test_anchored_lines(spark):
    rng = random.Random(4)
    cases = [[(float(rng.randint(0, 60)), float(rng.randint(6, 14))) for _ in range(rng.randint(1, 12))] for _ in range(200)]

    def model(items, rule):
        out, at, size = [], None, None
        for y, s in items:
            far = at is None or (abs(y - at) > max(0.5 * max(size, 1), 3) if rule == "text" else abs(y - at) >= max(0.4 * s, 3))
            if far:
                at, size = y, s
            out.append((out[-1] if out else 0) + far)
        return out

    rows = spark.createDataFrame(list(enumerate(cases)), "i int, s array<struct<at:double,size:double>>")
    for rule in ("text", "table"):
        got = [r["n"] for r in rows.select("i", lines.anchored_numbers(F.col("s"), rule).alias("n")).orderBy("i").collect()]
        assert got == [model(c, rule) for c in cases]


def test_page_ranges(spark):
    rng = random.Random(5)
    token = lambda: rng.choice([str(rng.randint(-1, 15)), f"{rng.randint(0, 14)}-{rng.randint(0, 14)}", f" {rng.randint(1, 9)} - {rng.randint(1, 9)} ", "x", "", "1-2-3", "-4", "+3"])
    cases = [(",".join(token() for _ in range(rng.randint(0, 5))), rng.randint(1, 12)) for _ in range(300)]

    def model(spec, n):
        found = set()
        for t in spec.split(","):
            ends = [e.strip() for e in t.strip().split("-")]
            if len(ends) <= 2 and all(e.lstrip("+").isdigit() and e.count("+") <= 1 for e in ends):
                a, b = int(ends[0]), int(ends[-1])
                found |= {p for p in range(max(1, min(a, b)), min(n, max(a, b)) + 1)}
        return sorted(found) or None

    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(cases)], "i int, s string, n int")
    assert [r["p"] for r in rows.select("i", pages.parse_range(F.col("s"), F.col("n")).alias("p")).orderBy("i").collect()] == [model(s, n) for s, n in cases]


def test_unique_names(spark):
    rng = random.Random(6)
    cases = [[rng.choice(["a", "A", "b", "a (2)", "b (2)", "b (3)"]) for _ in range(rng.randint(0, 7))] for _ in range(100)]

    def model(names):
        used, out = set(), []
        for base in names:
            n, name = 1, base
            while name.lower() in used:
                n += 1
                name = f"{base} ({n})"
            used.add(name.lower())
            out.append(name + ".md")
        return out

    rows = spark.createDataFrame(list(enumerate(cases)), "i int, n array<string>")
    assert [r["u"] for r in rows.select("i", catalog.unique_names(F.col("n")).alias("u")).orderBy("i").collect()] == [model(c) for c in cases]


def test_folded_rows(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(150):
        y, rows = 800.0, []
        for _ in range(rng.randint(1, 7)):
            rows.append((y, 12.0, [rng.choice(["", "", "a", "bc-", "d"]) for _ in range(3)]))
            y -= rng.choice([14.0, 14.0, 40.0])
        cases.append(rows)

    def join(a, b):
        if not a or not b:
            return a or b
        return a[:-1] + b if a.endswith("-") and a[-2:-1].isalpha() and b[:1].islower() else f"{a} {b}"

    def model(rows):
        out = []
        for y, size, cells in rows:
            col = next((k for k, c in enumerate(cells) if c), None)
            if col is None:
                continue
            if out:
                last = out[-1]
                near = not last["y"] - y > last["size"] * 2.5
                if near and col > 0 and ((last["col"] < col and last["cells"][col]) or (last["col"] == col and last["on"])):
                    last["cells"] = [join(a, b) for a, b in zip(last["cells"], cells, strict=True)]
                    last.update(y=y, col=col, on=True)
                    continue
            out.append({"y": y, "size": size, "cells": list(cells), "col": col, "on": False})
        return [o["cells"] for o in out]

    rows = spark.createDataFrame(list(enumerate(cases)), "i int, r array<struct<y:double,font_size:double,cells:array<string>>>")
    got = [r["f"] for r in rows.select("i", tables.fold_continuations(F.col("r")).alias("f")).orderBy("i").collect()]
    assert got == [model(c) for c in cases]


def test_paths_and_addresses(spark):
    row = spark.sql("SELECT 1").select(X.completions_url(F.lit("http://a/v1/")).alias("a"), X.completions_url(F.lit("http://a/v1"), True).alias("b"), X.completions_url(F.lit("http://a")).alias("c"), X.display_name(F.lit("abcdefghij"), 6).alias("d"), X.is_inside(F.lit("C:\\x\\y"), F.lit("C:/x/")).alias("e"), X.is_inside(F.lit("/xy/z"), F.lit("/x")).alias("f"), X.snippet(F.lit("abc"), 2).alias("g")).first()
    assert tuple(row) == ("http://a/v1/chat/completions", "http://a/v1", "http://a/v1/chat/completions", "abc…ij", True, False, "ab")


def test_long_pages_take_linear_time(spark):
    """A page of 100 000 items into lines, and texts of 10 000 and 20 000 lines into paragraphs: twice as many lines take
    about twice as long, not four times."""
    n = 100_000
    items = spark.range(0, n, 1, 1).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("item_no"), (F.col("id") % 7).cast("double").alias("x"), (-F.floor(F.col("id") / 7) * 20).cast("double").alias("y"), F.lit(12.0).alias("font_size"))
    began = time.perf_counter()
    found = lines.text_lines(items).agg(F.max("line_no").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert (found["m"], found["n"]) == (-(-n // 7), n) and time.perf_counter() - began < 60

    def seconds(size):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.lit("word "), i, F.lit(" goes on and on"), F.when(i % 5 == 0, ".").otherwise(""))), "\n")
        docs = spark.range(0, 1, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            out = paragraphs.join_text(docs, "smart").first()["text"]
            took.append(time.perf_counter() - began)
        assert out.count("\n") == size // 5 - 1
        return min(took)

    seconds(1000)
    assert seconds(20_000) < 3.2 * seconds(10_000) + 1


def test_runs_and_scans(spark):
    """Cut arrays and running values equal plain ones, over the borders of chunks too."""
    rows = spark.createDataFrame([(k, list(range(k))) for k in (0, 1, 2, 255, 256, 257, 513, 800)], "k int, own array<int>")
    cut = arrays.runs(F.col("own"), lambda i: F.get(F.col("own"), i) % 3 == 0)
    total = arrays.scan(F.col("own"), F.lit(0), lambda s, x: F.struct((s + x).alias("state"), F.when(x % 2 == 0, s + x).alias("value")), "int", lambda s: F.array(s))
    for r in rows.select("k", cut.alias("cut"), total.alias("total")).collect():
        k = r["k"]
        assert r["cut"] == [list(range(s, min(s + 3, k))) for s in range(0, k, 3)]
        sums = [sum(range(x + 1)) for x in range(k)]
        assert r["total"] == [s for x, s in enumerate(sums) if x % 2 == 0] + [sums[-1] if sums else 0]


def test_neighbours_alone_decide_by_geometry(spark):
    """Pages on which every line has its geometry come out as the fold has them, without an aggregate in the plan."""
    draw = random.Random(12)
    texts = ["Some words", "inter-", "national", "一行字", "二行 ", "  indented", "| a | b |", "```", "", "1. item", "ends.", "x-", "UPPER-", "-", "a b"]
    meta = lambda y: (float(y), draw.choice([12.0, 12.0, 14.0]), float(draw.choice([72, 72, 96, 130, 300])), float(draw.choice([100, 300, 500])))
    rows = []
    for k in range(300):
        n = draw.randrange(1, 14)
        own = [draw.choice(texts) for _ in range(n)]
        own = own if own[-1] else [*own[:-1], "end"]
        rows.append((k, "\n".join(own), [meta(800 - draw.choice([14, 14, 14, 40]) * i) for i in range(n)]))
    pages = spark.createDataFrame(rows, "doc_id int, markdown string, line_meta array<struct<y:double,font_size:double,x0:double,x1:double>>")
    fast = paragraphs.join_pages(pages, "smart", all_have_geometry=True)
    # A geometry for one line too many sends a page to the fold.
    folded = paragraphs.join_pages(pages.withColumn("line_meta", F.concat("line_meta", F.slice("line_meta", 1, 0), F.array(F.lit(None).cast("struct<y:double,font_size:double,x0:double,x1:double>")))), "smart")
    got, want = ({r["doc_id"]: r["markdown"] for r in df.collect()} for df in (fast, folded))
    assert got == want and "aggregate(" not in fast._jdf.queryExecution().analyzed().toString()
    none = paragraphs.join_pages(pages, "none")
    assert "aggregate(" not in none._jdf.queryExecution().analyzed().toString()


def test_reading_order_by_recursive_cuts(spark):
    """Random boxes, grids and ties on pages of several sizes, against cuts made one after another."""
    draw = random.Random(21)

    def cuts(boxes, width, height):
        for low, size, extent in ((1, 3, width), (2, 4, height)):
            own = sorted(boxes, key=lambda b: (b[low], b[0]))
            gaps, reach = [0.0], own[0][low] + own[0][size]
            for b in own[1:]:
                gaps.append(b[low] - reach)
                reach = max(reach, b[low] + b[size])
            if max(gaps) >= max(0.02 * extent, 12.0):
                at = gaps.index(max(gaps))
                return cuts(own[:at], width, height) + cuts(own[at:], width, height)
        return [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0]))]

    pages, boxes = [], []
    for p in range(120):
        width, height = draw.choice([(600, 800), (2000, 1000)])
        step = draw.choice([1, 20, 50])
        own = [(k, float(draw.randrange(0, width, step)), float(draw.randrange(0, height, step)), float(draw.randrange(1, 150, max(1, step // 2))), float(draw.randrange(1, 80))) for k in range(draw.randrange(1, 25))]
        pages.append((p, 1, float(width), float(height), cuts(own, width, height)))
        boxes += [(p, 1, *b) for b in own]
    regions = spark.createDataFrame(boxes, "doc_id int, page int, region_no int, x double, y double, width double, height double")
    sizes = spark.createDataFrame([p[:4] for p in pages], "doc_id int, page int, width_px double, height_px double")
    found = layout.reading_order(regions, sizes)
    got = {}
    for r in found.select("doc_id", "region_no", "reading_no").collect():
        got.setdefault(r["doc_id"], []).append((r["reading_no"], r["region_no"]))
    assert {p: [n for _, n in sorted(v)] for p, v in got.items()} == {p[0]: p[4] for p in pages}
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in got.values())
    assert found.columns == [*regions.columns, "reading_no"] or set(found.columns) == {*regions.columns, "reading_no"}
    assert layout.reading_order(regions.limit(0), sizes).collect() == []
