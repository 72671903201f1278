"""Cases of the reviewer's findings."""

import random
import re

import duckdb
import pytest

from pagewright.operators import catalog, layout, markdown
from pagewright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, tables, sf=SF):
    """Rows of a query and of its SQL over the same tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = QUERIES[name](spark, str(sf))
    assert got.columns == columns and want
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    return want


def test_unique_names_of_many_rows(spark):
    """20 000 names of one key, most of them one name; and random families against a plain loop."""
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["a", "A", "b", "a (2)", "a (2) (2)", "a (3)", "B (12)", "", "c (x)"])) for k in range(60) for i in range(rng.randint(0, 12))]
    rows += [(99, i, "name" if i % 5 else f"n{i % 35}") for i in range(20_000)]
    used, want = set(), {}
    last = {}
    for k, i, base in rows:
        n = last.get((k, base.lower()), 0) + 1
        while (k, (name := base if n == 1 else f"{base} ({n})").lower()) in used:
            n += 1
        last[k, base.lower()] = n
        used.add((k, name.lower()))
        want[k, i] = name + ".md"
    own = spark.createDataFrame(rows, "k int, i int, n string")
    found = catalog.unique_rows(own, "n", ["i"], ("k",))
    assert found.columns == ["k", "i", "n", "unique"]
    assert {(r["k"], r["i"]): r["unique"] for r in found.collect()} == want
    against_sql(spark, "catalog_unique_names", ["part"])


def test_numbers_of_cents(spark, tmp_path):
    """Balances that don't stand in whole cents, minus zero and tiny negative ones."""
    rows = [(i, i % 25, v) for i, v in enumerate([1.005, 0.125, 0.375, 2.675, 1234.565, 9999.995, -0.001, -0.004999, -5.0, 0.004, 0.005, 7.0, 9999.8, 12345678.905, None])]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(ORACLES["text_sniff_numbers"] + " ORDER BY 1").fetchall()
    assert [tuple(r) for r in QUERIES["text_sniff_numbers"](spark, str(tmp_path)).orderBy("c_custkey").collect()] == want
    zero = spark.createDataFrame([(1, 1, -0.0), (2, 2, 0.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    zero.write.parquet(str(tmp_path / "z" / "customer.parquet"))
    assert [(r["value"], r["kind"]) for r in QUERIES["text_sniff_numbers"](spark, str(tmp_path / "z")).collect()] == [(0.0, "num")] * 2


def test_chunks_of_whole_documents(spark, tmp_path):
    """Long documents too, cut where the SQL cuts them."""
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["", " \t", "\x0b"]) if rng.random() < blank else f"l{i}" for i in range(n)) for blank, n in [(0, 201), (0, 1000), (0.01, 900), (0.02, 1300), (0.03, 2000), (0.3, 450), (0, 200), (0, 400), (1, 500)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(50).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert len(against_sql(spark, "md_chunk_text", ["documents", "lineitem"], tmp_path)) > 40
    want = against_sql(spark, "md_chunk_text", ["documents", "lineitem"])
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(want) >= documents.count() + 2 * spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["md_chunk_text"](spark, SF).filter("doc_id < 10000000").select("doc_id").distinct().count() == documents.count()


def plain_blocks(text):
    """Blocks (pos, page, kind, line, rows) line by line, and the number of lines; a model of the Markdown parser."""
    own = text.split("\n")
    own = own[:-1] if own[-1] == "" else own
    code, page, found, table, before = False, None, [], None, None
    for pos, line in enumerate(own):
        t = line.strip()
        code ^= t.startswith(("```", "~~~"))
        pipe = not code and t.startswith("|")
        if not code and (m := re.fullmatch(r"<!-- Page ([0-9]+) -->", t)):
            page, table = int(m[1]), None
        elif pipe and table is not None:
            table.append(t)
        elif pipe and before and re.fullmatch(r"\|[-:| ]*-[-:| ]*\|", t):
            found.pop()
            table = []
            found.append((pos - 1, page, "table", None, table))
        else:
            table = None
            if code or t:
                found.append((pos, None, "line", line if code else t, None))
        before = pipe and table is None
    return found, len(own)


def test_markdown_in_one_pass(spark):
    """Random texts of fences, stray pipes, markers, blank and indented lines, against the model; nothing is shuffled."""
    rng = random.Random(10)
    kinds = ["| a | b |", "| a |", "|---|", "| :-: | - |", " |---|\t", "\t| x | y | z |", "```", "~~~ md", "  ```", "", "  ", "text", " indented ", "<!-- Page 2 -->", " <!-- Page 7 --> ", "<!-- note -->", "|", "a | b"]
    texts = ["\n".join(rng.choices(kinds, k=rng.randint(0, 14))) + rng.choice(["", "\n", "\n\n"]) for _ in range(1500)]
    texts += ["", "\n", "\n\n", "|a|\n|-|", "|a|\n|-|\n", "```", "```\n", "x\n" * 60_000, "| a |\n|---|\n" + "| b |\n" * 60_000, "```\n" + "y\n" * 60_000, "| a |\n|---|\n\n" * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: plain_blocks(t) for i, t in enumerate(texts)}
    got = {}
    for r in markdown.parse_blocks(docs).orderBy("doc_id", "block_no").collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["page"], r["kind"], r["line"], None if r["rows"] is None else len(r["rows"])))
    for i, (blocks, _) in want.items():
        assert got.get(i, []) == [(*b[:4], None if b[4] is None else len(b[4])) for b in blocks], texts[i][:200]
    tables = {i: [b for b in blocks if b[2] == "table"] for i, (blocks, _) in want.items()}
    assert {r["doc_id"]: (r["table_count"], r["total_rows"], r["total_lines"]) for r in markdown.analyze(docs).collect()} == {i: (len(tables[i]), sum(len(b[4]) for b in tables[i]), n) for i, (_, n) in want.items()}
    assert {r["doc_id"]: (r["table_count"], r["total_rows"]) for r in markdown.export_totals(docs, tables_only=False).collect()} == {i: (len(tables[i]), sum(1 if b[4] is None else len(b[4]) for b in blocks)) for i, (blocks, _) in want.items()}
    starts = {}
    for r in markdown.sheet_cells(docs, tables_only=False).filter("col = 0 AND kind IN ('label', 'line')").orderBy("doc_id", "row").collect():
        starts.setdefault(r["doc_id"], []).append((r["row"], r["kind"]))
    for i, (blocks, _) in want.items():
        at, own = 0, []
        for b in blocks:
            own.append((at, "line" if b[4] is None else "label"))
            at += 1 if b[4] is None else len(b[4]) + 3
        assert starts.get(i, []) == own
    for found in (markdown.parse_tables(docs), markdown.parse_blocks(docs), markdown.analyze(docs), markdown.export_totals(docs), markdown.sheet_cells(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["md_order_cells", "md_order_tables", "md_order_sheet", "md_order_blocks", "md_order_analysis", "md_order_export"])
def test_markdown_of_orders(spark, name):
    against_sql(spark, name, ["lineitem"])


@pytest.mark.parametrize("name", ["tables_vertical", "tables_vertical_cells", "tables_guided_cells", "tables_grid_cells", "tables_vertical_letters", "tables_drawn"])
def test_drawn_tables_group_items_once(spark, name):
    """As the SQL; a page's items are gathered once, not once more for its lines and again for the page."""
    against_sql(spark, name, ["lineitem"])
    if name in ("tables_vertical", "tables_guided_cells"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list") == 1


def cuts(boxes, width, height):
    """Region numbers in reading order, one cut after another."""
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


def test_reading_order_in_few_rounds(spark, monkeypatch):
    """A title over three columns of 40 boxes, a row of 40 columns, grids and boxes of negative size; rounds are as many as
    the kinds of cuts that follow each other, and each is dealt to a number of partitions that goes with the boxes."""
    rng = random.Random(31)
    own = {
        1: [(0, 0.0, 0.0, 600.0, 30.0)] + [(1 + c * 40 + k, c * 210.0, 5000.0 - 60 * k, 180.0, 30.0) for c in range(3) for k in range(40)],
        2: [(k, 3000.0 - 50 * k, 10.0 * (k % 3), 30.0, 20.0) for k in range(40)],
        3: [(k, 100.0 * (k % 4), 100.0 * (k // 4), 60.0, 60.0) for k in range(16)],
        4: [(k, 100.0 * k, 0.0, 200.0, 60.0) for k in range(9)],
    }
    for p in range(5, 60):
        own[p] = [(k, float(rng.randrange(0, 600, 20)), float(rng.randrange(0, 800, 20)), float(rng.randrange(-60, 150, 10)), float(rng.randrange(-40, 80, 10))) for k in range(rng.randrange(1, 12))]
    schema = "doc_id int, page int, region_no int, x double, y double, width double, height double"
    sizes = spark.createDataFrame([(p, 1, 600.0, 800.0) for p in [*own, 99]], "doc_id int, page int, width_px double, height_px double")
    rounds = []
    kept = layout.checkpointed
    monkeypatch.setattr(layout, "checkpointed", lambda df: rounds.append(kept(df)) or rounds[-1])
    monkeypatch.setattr(layout, "BOXES_AT_ONCE", 100)

    def order(pages):
        rounds.clear()
        boxes = spark.createDataFrame([(p, 1, *b) for p in pages for b in own[p]] + [(98, 1, 0, 1.0, 1.0, 1.0, 1.0)], schema)
        got = {}
        for r in layout.reading_order(boxes, sizes).collect():
            got.setdefault(r["doc_id"], []).append((r["reading_no"], r["region_no"]))
        assert {p: [n for _, n in sorted(v)] for p, v in got.items()} == {p: cuts(own[p], 600.0, 800.0) for p in pages}

    order([1, 2, 3, 4])
    assert len(rounds) == 3 and {r.rdd.getNumPartitions() for r in rounds} == {2}
    order(list(own))
    against_sql(spark, "layout_reading_order", ["lineitem"])


def plain_page(blocks, regions, width, height):
    """A page's Markdown region by region; a model of the assembly."""
    own = [b for b in blocks if b[1].strip()]

    def lines(part):
        found, last = [], None
        for b in sorted(part, key=lambda b: (b[3], b[0])):
            if last is None or abs(b[3] - last) > max(height * 0.015, 8):
                found.append([])
            found[-1].append(b)
            last = b[3]
        return [sorted(line, key=lambda b: (b[2], b[0])) for line in found]

    def row(line):
        cells = []
        for k, b in enumerate(line):
            if k == 0 or b[2] - (line[k - 1][2] + line[k - 1][4]) > max(width * 0.02, 12):
                cells.append([])
            cells[-1].append(b[1])
        return [" ".join(c) for c in cells]

    def table(grid):
        wide = max(map(len, grid), default=0)
        rows = ["| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (wide - len(r))]) + " |" for r in grid]
        return "\n".join([rows[0], "| " + " | ".join(["---"] * wide) + " |", *rows[1:]]) if rows else ""

    at = {}
    for b in own:
        x, y = b[2] + b[4] / 2, b[3] + b[5] / 2
        inside = [(r[4] * r[5], r[0]) for r in regions if r[2] <= x <= r[2] + r[4] and r[3] <= y <= r[3] + r[5]]
        at.setdefault(min(inside)[1] if inside else None, []).append(b)
    chunks = []
    for no, kind, *_, tall in regions:
        part = lines(at.get(no, []))
        texts = [" ".join(b[1] for b in line) for line in part]
        flat, grid = " ".join(texts), [row(line) for line in part]
        if kind in ("header", "footer"):
            chunks.append(f"<!-- 已过滤{'页眉' if kind == 'header' else '页脚'}: {flat} -->" if flat else "")
        elif kind == "title":
            chunks.append("#" * (1 if tall >= 0.05 * height else 2 if tall >= 0.025 * height else 3) + " " + flat if flat else "")
        elif kind in ("seal", "figure"):
            chunks.append("" if kind == "seal" else "![figure](figure_placeholder)")
        else:
            chunks.append(table(grid) if kind == "table" or sum(len(r) > 1 for r in grid) > 1 else "\n".join(texts))
    chunks.append("\n".join(" ".join(b[1] for b in line) for line in lines(at.get(None, []))))
    return "\n\n".join(c for c in chunks if c)


def test_assembly_in_a_page_row(spark):
    """Random pages against the model, with a page of 20 000 blocks and pages without blocks or regions; blocks and regions
    are gathered once, and no windows run over them."""
    rng = random.Random(32)
    pages, blocks, regions = {}, {}, {}
    for p in range(300):
        pages[p] = (rng.choice([600, 900]), rng.choice([400, 842, 2000]))
        blocks[p] = [] if p % 10 == 0 else [(k, rng.choice(["a", "b|c", " ", "", f"t{k}"]), float(rng.choice([0, 10, 30, 100, 200, 400, 590])), float(rng.randrange(0, 800, 5)), float(rng.choice([5, 20, 60])), float(rng.choice([5, 12]))) for k in range(rng.randrange(0, 14))]
        regions[p] = [] if p % 7 == 0 else [(k, rng.choice(["text", "title", "table", "header", "footer", "seal", "figure", "other"]), float(rng.randrange(0, 400, 50)), float(rng.randrange(0, 600, 50)), float(rng.choice([50, 200, 600])), float(rng.choice([20, 45, 100, 400]))) for k in range(rng.randrange(0, 6))]
    pages[300], regions[300] = (600, 842), [(0, "table", 0.0, 0.0, 600.0, 150_000.0), (1, "text", 0.0, 150_000.0, 600.0, 150_000.0)]
    blocks[300] = [(k, f"c{k}", 100.0 * (k % 3), 20.0 * (k // 3) * 2, 50.0, 12.0) for k in range(20_000)]
    flat = lambda d, schema: spark.createDataFrame([(p, 1, *r) for p, v in d.items() for r in v], f"doc_id long, page int, {schema}")
    b = flat(blocks, "block_no long, text string, left double, top double, width double, height double")
    r = flat(regions, "region_no int, class string, x double, y double, width double, height double")
    found = layout.assemble(b, r, flat({p: [v] for p, v in pages.items()}, "width_px int, height_px int"))
    assert {x["doc_id"]: x["markdown"] for x in found.collect()} == {p: plain_page(blocks[p], regions[p], *pages[p]) for p in pages}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and "Window" not in plan
    against_sql(spark, "layout_assemble_letters", ["lineitem"])
