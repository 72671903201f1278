"""Files in and out, and the stateful stream."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog, filters, markdown, usage
from pagewright.sources import documents, files, sink, xlsx
from pagewright.streaming import session


def test_files(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md/a.md").write_text("# x\n")
    (tmp_path / "md/b.md").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["valid"]) for r in files.read_markdown(spark, str(tmp_path / "md")).collect()}
    assert got == {"a.md": ("# x\n", True), "b.md": (None, False)}
    (tmp_path / "img").mkdir()
    for n in ("a.PNG", "b.jpeg", "c.webp"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted(r["mime"] for r in files.read_images(spark, str(tmp_path / "img")).collect()) == ["image/jpeg", "image/png"]
    inventory = spark.createDataFrame([("g", "A.png", "t", 1, "2D711642B726B04401627CA9FBAC32F5C8530FB1903CC4DB02258717921A4881"), ("g", "b.jpeg", "u", 2, "00")], "group_id string, name string, target string, size long, sha256 string")
    got = {r["name"]: r["status"] for r in catalog.match_inventory(files.verify_files(spark, str(tmp_path / "img")), inventory).collect()}
    assert got == {"a.PNG": "imported", "b.jpeg": "failed", "c.webp": "ignored"}


def test_usage_log(spark, tmp_path):
    lines = [{"date": "2024-01-05", "kind": "pdf", "fileCount": 1, "pageCount": 10, "ocrPageCount": 3, "engine": "local", "totalMs": 900}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text(json.dumps(lines[0]) + "\nnot json\n")
    rows = files.read_usage(spark, str(tmp_path / "log"))
    assert [r.asDict() for r in rows.collect()] == lines
    files.append_usage(spark.createDataFrame(rows.collect(), files.USAGE), str(tmp_path / "log"))
    assert files.read_usage(spark, str(tmp_path / "log")).count() == 2


def test_a_batch_of_the_log_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-05", "pdf", 1, 10, 3, "local", 900), ("2024-01-06", "image", 2, 0, 2, "ai", 5)], files.USAGE)
    for batch in (0, 1, 1, 0):
        files.append_usage(rows, str(tmp_path / "log"), batch)
    assert files.read_usage(spark, str(tmp_path / "log")).count() == 4


def test_usage_periods_roll_over(spark, tmp_path):
    """After every batch the stream has what the statistics of the whole log so far are; a new day and a new month begin
    at zero, and lines that come late count where their day lies."""
    names = [f.split(" ")[0] for f in files.USAGE.split(", ")]
    line = lambda day, kind="pdf", n=1, engine="local": (day, kind, n, 10 * n, 3 * n, engine, 100 * n)
    batches = [[line("2024-01-30"), line("2024-01-31", "image", 2)], [line("2024-01-31", n=5), line("2024-01-29", "screenshot", 3, "ai")], [line("2024-02-01", n=7)], [line("2024-02-01", "drawTable", 11), line("2024-01-31", n=13)], [line("2024-02-03", n=17)]]
    (tmp_path / "in").mkdir()
    for k, own in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in own))
        os.utime(tmp_path / f"in/{k}.json", (k + 1, k + 1))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    stream = session.usage_periods(session.paced(spark, str(tmp_path / "in"), files.USAGE), "30 days")
    q = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    seen = [rows for rows in seen if rows]
    assert len(seen) == len(batches)
    for k, rows in enumerate(seen):
        log = [r for own in batches[: k + 1] for r in own]
        today = max(r[0] for r in log)
        want = usage.usage_stats(spark.createDataFrame(log, files.USAGE), today).collect()
        assert {tuple(r)[:-1] for r in rows} == {tuple(r) for r in want} and {r["day"] for r in rows} == {today}
    assert {r["period"]: r["file_count"] for r in seen[2]} == {"total": 18, "month": 7, "today": 7}


def test_days_and_months_without_lines(spark, tmp_path):
    """A day without a line lies between two that have some, and the month ends there; timers of days gone by change nothing."""
    names = [f.split(" ")[0] for f in files.USAGE.split(", ")]
    (tmp_path / "in").mkdir()
    for k, day in enumerate(("2024-03-31", "2024-04-02")):
        (tmp_path / f"in/{k}.json").write_text(json.dumps(dict(zip(names, (day, "pdf", 1, 1, 1, "local", 1), strict=True))))
        os.utime(tmp_path / f"in/{k}.json", (k + 1, k + 1))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    log = session.paced(spark, str(tmp_path / "in"), files.USAGE)
    q = session.usage_periods(log).writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    last = {r["period"]: (r["file_count"], r["day"]) for r in seen[-3:]}
    assert last == {"total": (2, "2024-04-02"), "month": (1, "2024-04-02"), "today": (1, "2024-04-02")}


def test_config(spark):
    rows = spark.createDataFrame([('{"a": 5}',), ("broken",), (None,)], "t string")
    got = [r["c"].asDict() for r in rows.select(files.parse_config(F.col("t"), "a int, b string", {"a": 1, "b": "x"}).alias("c")).collect()]
    assert got == [{"a": 5, "b": "x"}, {"a": 1, "b": "x"}, {"a": 1, "b": "x"}]
    strict = [r["c"] for r in rows.select(files.parse_config(F.col("t"), "a int", {"a": 1}, strict=True).alias("c")).collect()]
    assert strict[0]["a"] == 5 and strict[1:] == [None, None]
    got = files.clamp_settings(spark.createDataFrame([(99, -1, 50)], "concurrency int, threads int, opacity int")).first()
    assert tuple(got) == (16, 0, 50)
    out = files.export_config(spark.createDataFrame([("v", "secret")], "name string, api_key string")).first()["json"]
    assert json.loads(out) == {"name": "v"}
    answers = [json.dumps({"choices": [{"message": {"content": c}}]}) for c in ("hi", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "  ")]
    assert [r["t"] for r in spark.createDataFrame([(a,) for a in answers], "r string").select(files.vision_text(F.col("r")).alias("t")).collect()] == ["hi", "a\nb", None]


def test_models(spark, tmp_path):
    for d, meta, model in (("b", '{"name": "B"}', True), ("a", '{"name": "A"}', False), ("c", "broken", True)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "layout-meta.json").write_text(meta)
        if model:
            (tmp_path / d / "model.mnn").write_text("x")
    assert [(r["name"], r["available"]) for r in files.list_models(spark, str(tmp_path)).collect()] == [("A", False), ("B", True)]


def test_xlsx(spark, tmp_path):
    docs = spark.createDataFrame([(1, "| A & B |\n|---|\n| 12% |\n| <x> |\n"), (2, "| C |\n|---|\n| 7 |\n")], "doc_id long, text string")
    xlsx.write_xlsx(markdown.sheet_cells(docs), str(tmp_path))
    sheets = {p.name: zipfile.ZipFile(p).read("xl/worksheets/sheet1.xml").decode() for p in tmp_path.glob("*.xlsx")}
    assert set(sheets) == {"1.xlsx", "2.xlsx"}
    assert "A &amp; B" in sheets["1.xlsx"] and '<c r="A3" s="4"><v>0.12</v></c>' in sheets["1.xlsx"] and "&lt;x&gt;" in sheets["1.xlsx"] and "<v>7.0</v>" in sheets["2.xlsx"]
    assert [xlsx.column_name(c) for c in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_markdown_out(spark, tmp_path):
    files.write_markdown(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), str(tmp_path / "o"))
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["1.md"] and (tmp_path / "o/1.md").read_text() == "a\nb"
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("d"), F.col("id") % 3, F.lit("/n"), "id", F.lit(".md")).alias("name"))
    files.write_markdown(many, str(tmp_path / "many"), name_col="name")
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["d0", "d1", "d2"] and (tmp_path / "many/d1/n1000.md").read_text() == "text 1000"
    assert len(list((tmp_path / "many").rglob("*.md"))) == 2000


def test_all_files_or_none(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/0.md").write_text("old")
    rows = spark.range(0, 40, 1, 4).select(F.concat("id", F.lit(".md")).alias("name"), F.concat(F.lit("new "), "id").alias("content"))
    left = lambda: {p.name: p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    broken = rows.withColumn("content", F.when(F.col("name") == "37.md", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    outside = rows.withColumn("name", F.when(F.col("name") == "37.md", "../37.md").otherwise(F.col("name")))
    twice = rows.unionByName(rows.limit(1))
    for bad in (broken, outside, twice):
        with pytest.raises(Exception, match="no|not a name|several rows"):
            sink.write_files(bad, str(tmp_path / "out"))
        assert left() == {"0.md": "old"} and [p.name for p in (tmp_path / "out").iterdir()] == ["0.md"]
    with pytest.raises(Exception, match="0.md"):
        sink.write_files(rows, str(tmp_path / "out"), replace=False)
    assert left() == {"0.md": "old"}
    sink.write_files(rows, str(tmp_path / "out"))
    assert left() == {f"{k}.md": f"new {k}" for k in range(40)} and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]


def test_copy_missing(spark, tmp_path):
    for name, text in (("a/x.bin", "1"), ("a/y.bin", "2"), ("z z.bin", "3")):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_text(text)
    (tmp_path / "to/a").mkdir(parents=True)
    (tmp_path / "to/a/x.bin").write_text("mine")
    there = lambda d: {str(p.relative_to(tmp_path / d)): p.read_text() for p in (tmp_path / d).rglob("*.bin")}
    assert sink.copy_missing(spark, str(tmp_path / "from"), str(tmp_path / "to")) == 2
    assert there("to") == {"a/x.bin": "mine", "a/y.bin": "2", "z z.bin": "3"}
    assert sink.copy_missing(spark, str(tmp_path / "from"), str(tmp_path / "to")) == 0
    assert sink.copy_missing(spark, str(tmp_path / "from"), str(tmp_path / "new")) == 3 and there("new") == there("from")
    assert sink.copy_missing(spark, str(tmp_path / "nowhere"), str(tmp_path / "to")) == 0


class CountingPages(documents.StoredPages):
    """Leaves a file for each page that it decodes."""

    def decode(self, handle):
        page = super().decode(handle)
        with open(f"{os.environ['PAGEWRIGHT_COUNT']}/{page['page']}-{time.time_ns()}", "w"):
            return page


def test_page_source(spark, tmp_path, monkeypatch):
    page_rows = spark.createDataFrame([(d, p, f"text {d}.{p}", p == 3) for d in (1, 2, 3) for p in (1, 2, 3)], "doc_id long, page int, markdown string, needs_ocr boolean")
    item_rows = spark.createDataFrame([(d, p, k, f"i{k}", 1.0 * k, 2.0, 3.0, 12.0, 12.0, "Image" if k == 2 else "Text") for d in (1, 2, 3) for p in (1, 2) for k in (0, 1, 2)], "doc_id long, page int, item_no long, text string, x double, y double, width double, height double, font_size double, item_type string")
    at = str(tmp_path / "docs")
    sink.write_files(documents.stored(page_rows, item_rows), at)
    back = documents.read_pages(spark, at).select(F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("doc_id"), "page", "markdown", "needs_ocr")
    assert sorted(back.collect()) == sorted(page_rows.collect())
    columns = item_rows.columns[1:]
    again = documents.read_items(spark, at).select(F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("doc_id"), *columns)
    assert sorted(again.collect()) == sorted(item_rows.collect())

    # Only the pages asked for are decoded.
    (tmp_path / "count").mkdir()
    monkeypatch.setitem(spark.sparkContext.environment, "PAGEWRIGHT_COUNT", str(tmp_path / "count"))
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", f"{os.path.dirname(__file__)}:{spark.sparkContext.environment['PYTHONPATH']}")
    counted = lambda: sorted(p.name[0] for p in (tmp_path / "count").iterdir())
    decoder = f"{os.path.basename(__file__)[:-3]}:CountingPages"
    assert documents.read_items(spark, at, decoder).filter("page = 2 AND item_type IN ('Text', 'FormField')").count() == 6 and counted() == ["2"] * 3
    assert documents.read_pages(spark, at, decoder).filter("page >= 3").count() == 3 and counted() == ["2"] * 3 + ["3"] * 3
    assert documents.read_pages(spark, at, decoder).filter("page < 2 AND markdown LIKE '%.1'").count() == 3 and counted() == ["1"] * 3 + ["2"] * 3 + ["3"] * 3
    plan = documents.read_items(spark, at).filter("page = 2")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan

    # What can't be read is told, and stops nothing.
    (tmp_path / "docs/bad.jsonl").write_text("no pages here")
    (tmp_path / "docs/half.jsonl").write_text('{"page": 1, "markdown": "fine"}\n{"page": 2, broken')
    found = documents.read_pages(spark, at)
    errors = {(r["path"].rsplit("/", 1)[1], r["page"]) for r in found.filter("error IS NOT NULL").collect()}
    assert errors == {("bad.jsonl", None), ("half.jsonl", 2)} and found.filter("error IS NULL").count() == 10
    assert found.filter("page = 1").count() == 4 and documents.read_items(spark, at).filter("error IS NOT NULL").count() == 2
    assert documents.read_pages(spark, str(tmp_path / "docs/1.jsonl")).count() == 3


EVENTS = "session_id string, seq long, ts timestamp, kind string, page int, markdown string, confidence double, error string"


def test_sessions(spark, tmp_path):
    minute = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    rows = [
        ("a", 1, minute(0), "start", 3, None, None, None), ("a", 3, minute(1), "page", 2, "p2", 0.8, None), ("a", 2, minute(2), "page", 1, "p1", 0.6, None), ("a", 4, minute(3), "fail", 3, None, None, "boom"), ("a", 5, minute(4), "finish", None, None, None, None),
        ("b", 1, minute(0), "start", 1, None, None, None), ("b", 2, minute(1), "page", 1, "x", 0.5, None),
        ("c", 1, minute(0), "start", 1, None, None, None), ("c", 2, minute(45), "page", 1, "late", 0.5, None),
        ("d", 1, minute(0), "page", 1, "never begun", 0.5, None),
    ]
    (tmp_path / "in").mkdir()
    names = [f.split(" ")[0] for f in EVENTS.split(", ")]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = session.assemble_sessions(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["session_id"]: r for r in spark.table("done").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "finished", "c": "late", "d": "late"}
    assert got["a"]["markdown"] == "<!-- Page 1 -->\n\np1\n\n<!-- Page 2 -->\n\np2\n\n<!-- Page 3 -->\n\n<!-- OCR failed (page 3): boom -->"
    assert abs(got["a"]["confidence"] - 0.7) < 1e-9 and got["a"]["failed_pages"] == [3]


def run_sessions(spark, tmp_path, name, *batches, most=session.MAX_LIVE):
    """What a stream of the given batches of events, one file each, puts out."""
    names = [f.split(" ")[0] for f in EVENTS.split(", ")]
    (tmp_path / name).mkdir()
    for k, own in enumerate(batches):
        (tmp_path / f"{name}/{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in own))
        os.utime(tmp_path / f"{name}/{k}.json", (k + 1, k + 1))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = session.assemble_sessions(session.paced(spark, str(tmp_path / name), EVENTS), most=most)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name).collect()


def moment(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def test_a_finished_session_has_all_pages_asked_for(spark, tmp_path):
    """Over two batches: a page without any text keeps its marker, a skip wins over a result, that over the text layer,
    whichever comes first; failures stand as often as they came; a range leaves pages out."""
    begun = [("a", 1, moment(0), "start", 4, None, None, None), ("r", 2, moment(0), "start", 9, "7-5,99", None, None), ("a", 3, moment(1), "page", 1, "recognised", 0.5, None), ("a", 4, moment(1), "skip", 2, None, None, "user"), ("r", 5, moment(2), "text", 6, " six ", None, None)]
    ended = [("a", 6, moment(3), "text", 1, "layer", None, None), ("a", 7, moment(3), "page", 2, "too late", 1.0, None), ("a", 8, moment(4), "fail", 3, None, None, "x"), ("a", 9, moment(4), "fail", 3, None, None, "y"), ("r", 10, moment(5), "page", 1, "not asked for", None, None), ("a", 11, moment(6), "finish", None, None, None, None), ("r", 12, moment(6), "finish", None, None, None, None)]
    got = {r["session_id"]: r for r in run_sessions(spark, tmp_path, "whole", begun, ended)}
    chunks = ["recognised", "<!-- OCR skipped (page 2): user -->", "<!-- OCR failed (page 3): y -->", ""]
    assert got["a"]["markdown"] == "\n\n".join(f"<!-- Page {k + 1} -->\n\n{t}" for k, t in enumerate(chunks))
    assert (got["a"]["confidence"], got["a"]["failed_pages"], got["a"]["skipped_pages"]) == (0.75, [3, 3], [2])
    assert got["r"]["markdown"] == "<!-- Page 5 -->\n\n\n\n<!-- Page 6 -->\n\nsix\n\n<!-- Page 7 -->\n\n" and got["r"]["confidence"] is None


def test_the_oldest_session_makes_room(spark, tmp_path):
    """The 33rd start evicts the oldest that lives; finished and aborted sessions don't count."""
    starts = [(f"s{k}", k, moment(k), "start", 1, None, None, None) for k in range(34)]
    first = starts[:32] + [("s1", 100, moment(40), "abort", None, None, None, None)]
    second = [(f"s{k}", 200 + k, moment(60 + k), "start", 1, None, None, None) for k in (32, 33)]  # room for one, then s0 goes
    third = [(f"s{k}", 300 + k, moment(120), "finish", None, None, None, None) for k in range(34) if k != 1]
    got = {r["session_id"]: r["status"] for r in run_sessions(spark, tmp_path, "room", first, second, third)}
    assert got == {f"s{k}": "late" if k == 0 else "finished" for k in range(34) if k != 1}
    small = [(f"t{k}", k, moment(k), "start", 1, None, None, None) for k in range(5)] + [(f"t{k}", 10 + k, moment(10), "finish", None, None, None, None) for k in range(5)]
    got = {r["session_id"]: r["status"] for r in run_sessions(spark, tmp_path, "few", small, most=2)}
    assert got == {"t0": "late", "t1": "late", "t2": "late", "t3": "finished", "t4": "finished"}


def test_sessions_are_forgotten_and_progress_is_told(spark, tmp_path):
    at = lambda h, m: f"2024-01-01T{h:02d}:{m:02d}:00Z"
    names = [f.split(" ")[0] for f in EVENTS.split(", ")]
    (tmp_path / "in").mkdir()
    rows = [[("a", 1, at(0, 0), "start", 1, None, None, None), ("b", 1, at(0, 50), "start", 1, None, None, None)], [("z", 1, at(2, 0), "start", 1, None, None, None)], [("z", 2, at(2, 1), "abort", None, None, None, None)]]
    for k, own in enumerate(rows):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in own))
        os.utime(tmp_path / f"in/{k}.json", (k, k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = []
    listener = session.Progress(lambda rows, batch: told.append((rows, batch)), every=0.0)
    spark.streams.addListener(listener)
    try:
        stream = session.assemble_sessions(session.paced(spark, str(tmp_path / "in"), EVENTS))
        q = stream.writeStream.format("memory").queryName("forgotten").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        batches = [p["numInputRows"] for p in q.recentProgress]
        left = [o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"]]
        assert batches[:3] == [4, 2, 2] and left == [0, 0]  # events are read for the gate and for the sessions
        for _ in range(100):
            if told and told[-1][0] == 8:
                break
            time.sleep(0.1)
        assert told[-1][0] == 8
    finally:
        spark.streams.removeListener(listener)


def test_page_building(spark):
    blocks = spark.createDataFrame([(1, 1, i, t, float(x), float(y), 100.0, 20.0, 1000) for i, (t, x, y) in enumerate([("第一", 10, 120), ("行 继续", 10, 145), ("远处", 10, 400)])] + [(1, 2, 0, " ", 0.0, 0.0, 1.0, 1.0, 1000)], "doc_id long, page int, block_no long, text string, left double, top double, width double, height double, height_px int")
    got = {r["page"]: (r["markdown"], r["error"]) for r in filters.ocr_page_text(blocks).collect()}
    assert got == {1: ("第一行 继续\n远处", None), 2: ("", "no text recognised")}
    images = spark.createDataFrame([(1, 1, 0, "old", 2.0), (1, 1, 1, "new", 2.5)], "doc_id long, page int, seq int, image string, render_scale double")
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "")], "doc_id long, page int, markdown string")
    assert {r["page"]: r["image"] for r in filters.page_images(pages, images).collect()} == {1: "new", 2: None}
    assert [r["page"] for r in filters.still_to_recognise(pages, images).collect()] == [2]
    items = spark.createDataFrame([(1, 1, 0, "a", 0.0, 5.0, 6.0, 12.0, 12.0, "Text"), (1, 1, 1, " ", 0.0, 5.0, 6.0, 12.0, 12.0, "Text"), (1, 1, 2, "", 0.0, 5.0, 6.0, 12.0, 12.0, "Image")], "doc_id long, page int, item_no long, text string, x double, y double, width double, height double, font_size double, item_type string")
    assert (filters.text_items(items).count(), filters.table_elements(items).count(), filters.image_boxes(items).count()) == (1, 2, 1)
    status = pages.withColumns({"needs_ocr": F.lit(False), "has_table": F.lit(False)})
    assert {r["page"]: r["markdown"] for r in filters.rebuild_text_pages(status, items).collect()} == {1: "a", 2: ""}
