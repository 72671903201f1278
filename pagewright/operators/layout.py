"""Detected page layout: decoding, suppression, assignment of blocks to regions, assembly into Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as G
from ..functions import text as X
from ..functions.arrays import runs
from ..runtime import checkpointed
from .lines import is_table_like
from .markdown import render_table

PAGE = ("doc_id", "page")
STRIDE = 7
#: Labels of the comments that stand for left-out headers and footers, and what stands for a figure.
FILTERED = {"header": "页眉", "footer": "页脚"}
FIGURE = "![figure](figure_placeholder)"


def decode_detections(raw: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, row_no, class_id, score, x, y, width, height, reading_order, class): detector rows above the threshold.

    ``raw``: keys, data (flat rows of class, score, x1, y1, x2, y2, order), score_threshold, classes, bucket_map,
    input_width, input_height, width_px, height_px, keep_ratio. NaN scores and boxes without area go.
    """
    n = F.floor(F.size("data") / STRIDE).cast("int")
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.slice("data", r * STRIDE + 1, STRIDE)))
    own = raw.select("*", F.posexplode(rows).alias("row_no", "d"))
    at = lambda i: F.get("d", F.lit(i))
    own = own.filter((at(1) >= F.col("score_threshold")) & ~F.isnan(at(1)))
    size = [F.col(c) for c in ("input_width", "input_height", "width_px", "height_px", "keep_ratio")]
    own = own.withColumns({"a": G.map_model_point(at(2), at(3), *size), "b": G.map_model_point(at(4), at(5), *size)})
    own = own.filter("b.x > a.x AND b.y > a.y")
    return own.select(*keys, "row_no", at(0).cast("int").alias("class_id"), at(1).alias("score"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), (F.col("b.x") - F.col("a.x")).alias("width"), (F.col("b.y") - F.col("a.y")).alias("height"), at(6).alias("reading_order"), G.class_bucket(at(0).cast("int"), F.col("classes"), F.col("bucket_map")).alias("class"))


def suppress(detections: DataFrame, limit: float = 0.5, keys=PAGE) -> DataFrame:
    """Greedy suppression over all classes: by falling score, a box goes if it overlaps a kept one too much.

    What is kept gets ``region_no`` (from 0) by reading order.
    """
    cols = [c for c in detections.columns if c not in keys]
    item = F.struct((-F.col("score")).alias("o"), F.col("row_no").alias("n"), F.struct(*cols).alias("d"))
    pages = detections.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["d"]).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda k: G.iou(k, d) > limit), acc).otherwise(F.concat(acc, F.array(d))))
    ranked = F.sort_array(F.transform(kept, lambda d, i: F.struct(d["reading_order"].alias("o"), i.alias("i"), d.alias("d"))))
    return pages.select(*keys, F.posexplode(ranked).alias("region_no", "r")).select(*keys, "region_no", "r.d.*")


def assign_regions(blocks: DataFrame, regions: DataFrame, keys=PAGE) -> DataFrame:
    """Blocks with ``region_no``: the smallest region (the first of equal ones) that holds the block's centre, or null.

    Regions come as one array a page, so the join is on the page and not on geometry.
    """
    own = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((F.col("width") * F.col("height")).alias("area"), "region_no", "x", "y", "width", "height"))).alias("_r"))
    hit = F.filter("_r", lambda r: G.contains(r, F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2))
    return blocks.join(own, list(keys), "left").withColumn("region_no", F.get(hit, F.lit(0))["region_no"]).drop("_r")


def _lines(blocks: Column, height: Column) -> Column:
    """Recognised lines (``lines.ocr_lines``) of an array of blocks by top, each an array of blocks from left to right."""
    far = lambda i: F.abs(F.get(blocks, i)["top"] - F.get(blocks, i - 1)["top"]) > F.greatest(height * 0.015, F.lit(8.0))
    across = lambda b: F.struct(b["left"].alias("left"), b["block_no"].alias("block_no"), b["text"].alias("text"), b["width"].alias("width"))
    return F.transform(runs(blocks, lambda i: F.coalesce(far(i), F.lit(True))), lambda line: F.sort_array(F.transform(line, across)))


def _joined(blocks: Column, separator: str) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), separator)


def _cells(line: Column, width: Column) -> Column:
    """A line's texts, cut where the gap to the block before is wide (``lines.grid_cells``)."""
    def wide(i: Column) -> Column:
        before = F.get(line, i - 1)
        return F.get(line, i)["left"] - (before["left"] + before["width"]) > F.greatest(width * 0.02, F.lit(12.0))

    return F.transform(runs(line, lambda i: F.coalesce(wide(i), F.lit(True))), lambda cell: _joined(cell, " "))


def grid_markdown(grid: Column) -> Column:
    return render_table(F.get(grid, F.lit(0)), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), pad=True, escape=True)


def _text(lines: Column, separator: str, glue: str) -> Column:
    return F.array_join(F.transform(lines, lambda line: _joined(line, separator)), glue)


def _chunk(region: Column, blocks: Column, height: Column, width: Column, separator: str, drop_header_footer: bool) -> Column:
    """A region's Markdown from its blocks, by its class."""
    kind = region["class"]
    label = F.when(kind == "header", FILTERED["header"]).otherwise(FILTERED["footer"])
    comment = lambda flat: F.when(X.blank(flat), "").otherwise(F.concat(F.lit("<!-- 已过滤"), label, F.lit(": "), flat, F.lit(" -->")))
    title = lambda flat: F.when(flat == "", "").otherwise(F.concat(F.repeat(F.lit("#"), G.title_level(region["height"], height)), F.lit(" "), flat))
    grid = lambda lines: F.transform(lines, lambda line: _cells(line, width))

    def rendered(lines: Column) -> Column:
        text, flat = _text(lines, separator, "\n"), _text(lines, separator, " ")
        return (
            F.when(kind.isin("header", "footer"), X.let(flat, comment) if drop_header_footer else text)
            .when(kind == "table", X.let(grid(lines), grid_markdown))
            .when(kind == "title", X.let(flat, title))
            .when(F.size(lines) < 2, text)
            .otherwise(X.let(grid(lines), lambda g: F.when(is_table_like(g), grid_markdown(g)).otherwise(text)))
        )

    return F.when(kind == "figure", FIGURE).when((kind == "seal") | (F.size(blocks) == 0), "").otherwise(X.let(_lines(blocks, height), rendered))


def assemble(blocks: DataFrame, regions: DataFrame, pages: DataFrame, separator: str = " ", drop_header_footer: bool = True, keys=PAGE) -> DataFrame:
    """(keys, markdown): each region rendered by its class in reading order, uncovered blocks after them.

    ``pages``: keys, width_px, height_px. Titles get hashes by height; tables, and text that stands in columns, become
    GFM tables; figures a placeholder; seals nothing; headers and footers a comment, or their text.

    A page's blocks and its regions are gathered once, and the page is rendered in its own row.
    """
    across = (F.col("left") + F.col("width") / 2).alias("cx")
    down = (F.col("top") + F.col("height") / 2).alias("cy")
    own = blocks.filter(~X.blank(F.col("text"))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("top", "block_no", "left", "width", "text", across, down))).alias("_b"))
    areas = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((F.col("width") * F.col("height")).alias("area"), "region_no", "x", "y", "width", "height", "class"))).alias("_r"))
    rows = pages.select(*keys, F.col("width_px").alias("_wide"), F.col("height_px").alias("_tall")).join(own, list(keys), "left").join(areas, list(keys), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("_b", "_r")})
    height, width = F.col("_tall"), F.col("_wide")
    placed = F.transform("_b", lambda b: F.struct(F.get(F.filter("_r", lambda r: G.contains(r, b["cx"], b["cy"])), F.lit(0))["region_no"].alias("region_no"), b.alias("b")))
    part = lambda all_, test: F.transform(F.filter(all_, lambda p: test(p["region_no"])), lambda p: p["b"])

    def chunks(all_: Column) -> Column:
        inside = F.transform("_r", lambda r: F.struct(r["region_no"].cast("long").alias("o"), X.let(part(all_, lambda n: n == r["region_no"]), lambda own: _chunk(r, own, height, width, separator, drop_header_footer)).alias("c")))
        rest = X.let(part(all_, lambda n: n.isNull()), lambda own: F.when(F.size(own) > 0, X.let(_lines(own, height), lambda lines: _text(lines, separator, "\n"))))
        return F.concat(inside, F.array(F.struct(F.lit((1 << 31) - 1).cast("long").alias("o"), rest.alias("c"))))

    found = X.let(placed, chunks)
    kept = F.sort_array(F.filter(found, lambda c: ~X.blank(c["c"])))
    return rows.select(*keys, F.coalesce(F.array_join(F.transform(kept, lambda c: c["c"]), "\n\n"), F.lit("")).alias("markdown"))


#: Gaps that a cut needs: a share of the page's side, and pixels at least.
GAP_SHARE, GAP_LEAST = 0.02, 12.0
#: Boxes of a partition on average, so that a task's sorts stay small however many pages there are.
BOXES_AT_ONCE = 300_000


def _cut_level(rows: DataFrame, keys) -> DataFrame:
    """Each node's boxes with ``_cut`` (whether the node is cut) and ``_piece`` (the number of the piece a box falls to).

    Along an axis boxes stand by their low edge, and a gap lies between a box and the furthest reach of those before it.
    Columns are cut before rows, at the first of the widest gaps. Where all boxes are sound (finite, of no negative size)
    two shortcuts give the same order: a cut between columns leaves the other gaps as they are, so all wide ones are cut at
    once; and a node whose boxes all lie so close over each other that none of its parts can have columns is only cut
    into rows, which is its order by y.
    """
    node = W.Window.partitionBy("_at", *keys, "_path")
    # Doubles as they are: windows by one column share its sort, those by one expression don't.
    box = {c: F.col(c) if kind == "double" else F.col(c).cast("double") for c, kind in rows.select("x", "y", "width", "height").dtypes}
    fine = (F.least("width", "height") >= 0) & (F.greatest(*map(F.abs, box.values())) < float("inf"))
    known = F.lit(True)
    for c in box.values():
        known = known & c.isNotNull()
    rows = rows.withColumn("_sound", F.coalesce(known & fine, F.lit(False)))
    for a, low, size, extent in (("_x", box["x"], box["width"], "_wide"), ("_y", box["y"], box["height"], "_tall")):
        order = node.orderBy(low, "region_no")
        least = F.greatest(F.col(extent) * GAP_SHARE, F.lit(GAP_LEAST))
        reach = F.max(low + size).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
        rows = rows.withColumns({f"{a}at": F.row_number().over(order), f"{a}gap": F.coalesce(low - reach, F.lit(0.0))})
        whole = {"_plain": F.bool_and("_sound").over(node), "_room": F.max(low).over(node) - F.min(low + size).over(node)} if a == "_x" else {}
        rows = rows.withColumns({f"{a}widest": F.max(f"{a}gap").over(node), **whole})
        rows = rows.withColumn(f"{a}first", F.min(F.when(F.col(f"{a}gap") == F.col(f"{a}widest"), F.col(f"{a}at"))).over(node))
        rows = rows.withColumn(f"{a}cut", F.col(f"{a}widest") >= least)
        if a == "_x":
            begins = F.when(F.col("_plain"), F.col("_xgap") >= least).otherwise(F.col("_xat") == F.col("_xfirst"))
            rows = rows.withColumns({"_column": F.sum(begins.cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)), "_rows_only": F.col("_plain") & (F.col("_room") < least)})
    piece = F.when(F.col("_xcut"), F.col("_column")).otherwise((F.col("_yat") >= F.col("_yfirst")).cast("int"))
    rows = rows.withColumns({"_cut": (F.col("_xcut") | F.col("_ycut")) & ~F.col("_rows_only"), "_piece": piece})
    return rows.drop("_sound", "_plain", "_room", "_rows_only", "_column", *[f"{a}{n}" for a in ("_x", "_y") for n in ("at", "gap", "widest", "first", "cut")])


def reading_order(regions: DataFrame, pages: DataFrame, keys=PAGE) -> DataFrame:
    """Regions with ``reading_no`` (from 0) by recursive XY cuts; for detectors without an order of their own.

    The cuts of all pages are made level by level: a round finds the gaps of all open nodes by windows over (page, node),
    and splits them, until none splits; a node is named by its path of pieces, so paths put nodes in reading order. Boxes of
    a node that isn't cut stand by y, then x. A round is cut off from the one before by a checkpoint; there are as many as
    the deepest page has levels. Each deals pages out to a number of partitions that goes with the number of boxes; by a
    hash of their own, as a partitioning by keys is lost where one of them is a constant.
    """
    columns = [*keys, "region_no", *[c for c in regions.columns if c not in (*keys, "region_no")]]
    parts = regions.count() // BOXES_AT_ONCE + 1
    # A page's size comes to its boxes as one more row of the page: a join's sorts would hold far more rows at once.
    sizes = pages.select(*keys, F.col("width_px").cast("double").alias("_wide"), F.col("height_px").cast("double").alias("_tall"), F.lit(True).alias("_page"))
    rows = regions.unionByName(sizes, allowMissingColumns=True).dropna(subset=list(keys)).withColumns({"_at": F.xxhash64(*keys), "_path": F.lit("")}).repartition(parts, "_at")
    page = W.Window.partitionBy("_at", *keys, "_path").orderBy("x", "region_no").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    rows = rows.withColumns({"_known": F.max("_page").over(page), "_wide": F.max("_wide").over(page), "_tall": F.max("_tall").over(page)}).filter("_known AND _page IS NULL").drop("_known", "_page")
    done = None
    while True:
        level = checkpointed(_cut_level(rows, keys))
        leaves = level.filter("NOT _cut").select(*columns, "_at", "_path")
        done = leaves if done is None else done.unionByName(leaves)
        if not level.filter("_cut").take(1):
            break
        # A number's digits stand behind their count, so that texts sort as the numbers do.
        digits = F.hex("_piece")
        rows = level.filter("_cut").withColumn("_path", F.concat("_path", F.length(digits).cast("string"), digits)).drop("_cut", "_piece").repartition(parts, "_at")
    number = F.row_number().over(W.Window.partitionBy("_at", *keys).orderBy("_path", F.col("y").cast("double"), F.col("x").cast("double"), "region_no")) - 1
    return done.repartition(parts, "_at").select(*columns, number.alias("reading_no"))


def mean_confidence(blocks: DataFrame, keys=PAGE) -> DataFrame:
    """(keys, confidence): mean over blocks with text, 0 where there are none."""
    return blocks.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~X.blank(F.col("text")), F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def distinct_buckets(classes: Column) -> Column:
    """Buckets of class names in their fixed order, each once, ``other`` left out."""
    own = F.transform(classes, G.layout_class)
    return F.filter(F.array(*map(F.lit, G.BUCKET_ORDER[:-1])), lambda b: F.array_contains(own, b))
