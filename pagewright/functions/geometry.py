"""Geometry expressions over boxes and points. Boxes are structs of x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How detector class names fall into the buckets that rendering knows.
BUCKETS = {
    "title": "title", "doc_title": "title", "paragraph_title": "title", "text": "text", "abstract": "text", "content": "text", "reference": "text",
    "table": "table", "figure": "figure", "image": "figure", "chart": "figure",
    "header": "header", "page_header": "header", "footer": "footer", "page_footer": "footer", "seal": "seal",
}
BUCKET_ORDER = ["title", "text", "table", "figure", "header", "footer", "seal", "other"]


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area; touching edges do not."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def contains(box: Column, x: Column, y: Column) -> Column:
    """Whether a point is in the box, edges included."""
    return (x >= box["x"]) & (x <= box["x"] + box["width"]) & (y >= box["y"]) & (y <= box["y"] + box["height"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def clamp_rects(rects: Column, page_width: Column, page_height: Column) -> Column:
    """Boxes clipped to the page; those with nothing left go. A page size of 0 or less switches clipping off."""
    def clip(r: Column) -> Column:
        x0, y0 = F.greatest(r["x"], F.lit(0.0)), F.greatest(r["y"], F.lit(0.0))
        x1, y1 = F.least(r["x"] + r["width"], page_width), F.least(r["y"] + r["height"], page_height)
        return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))

    clipped = F.filter(F.transform(rects, clip), lambda r: (r["width"] > 0) & (r["height"] > 0))
    return F.when((page_width > 0) & (page_height > 0), clipped).otherwise(rects)


def clamp_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least: int = 4) -> Column:
    """Whole-pixel region clipped to the image; null under ``least`` pixels on a side."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    fine = (x1 - x0 >= least) & (y1 - y0 >= least)
    return F.when(fine, F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))


def line_percents(lines: Column, scale: Column, size: Column) -> Column:
    """Line positions in points as percentages of an image side; none where scale or size is not positive."""
    own = F.transform(lines, lambda x: clamp(x * scale / size * 100, 0.0, 100.0))
    return F.when((scale > 0) & (size > 0), own).otherwise(F.array().cast("array<double>"))


def title_level(height: Column, page_height: Column) -> Column:
    return F.when(height >= 0.05 * page_height, 1).when(height >= 0.025 * page_height, 2).otherwise(3)


def layout_class(name: Column) -> Column:
    """Bucket of a detector class name."""
    known = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(name))), F.lit("other"))


def class_bucket(class_id: Column, classes: Column, bucket_map: Column) -> Column:
    """Bucket of a class number: the model's own map first, then the name; numbers out of range are ``other``."""
    name = F.get(classes, class_id)
    own = F.lower(F.element_at(F.coalesce(bucket_map, F.create_map().cast("map<string,string>")), name))
    return F.when(name.isNull(), "other").otherwise(F.coalesce(F.when(own.isin(BUCKET_ORDER), own), layout_class(name)))


def map_model_point(x: Column, y: Column, input_w: Column, input_h: Column, width: Column, height: Column, keep_ratio: Column) -> Column:
    """struct(x, y): a point of the detector's input in image pixels, stretched or letterboxed, clamped to the image."""
    ratio = F.least(input_w / width, input_h / height)
    pad_x, pad_y = (input_w - width * ratio) / 2, (input_h - height * ratio) / 2
    px = F.when(keep_ratio, (x - pad_x) / ratio).otherwise(x * width / input_w)
    py = F.when(keep_ratio, (y - pad_y) / ratio).otherwise(y * height / input_h)
    zero = F.lit(0.0)
    return F.struct(F.greatest(F.least(px, width.cast("double")), zero).alias("x"), F.greatest(F.least(py, height.cast("double")), zero).alias("y"))


def pixel_to_point(left: Column, top: Column, width: Column, height: Column, page_px: Column, scale: Column) -> Column:
    """struct(x, y, width, font_size): a pixel box (origin top left) in points (origin bottom left)."""
    return F.struct((left / scale).alias("x"), ((page_px - (top + height)) / scale).alias("y"), (width / scale).alias("width"), F.greatest(height / scale, F.lit(1.0)).alias("font_size"))


def band_of(bounds: Column, at: Column) -> Column:
    """Number (from 0) of the half-open band [b, next b) of ascending bounds that holds a value; null outside."""
    k = F.size(F.filter(bounds, lambda b: b <= at)) - 1
    return F.when((k >= 0) & (k < F.size(bounds) - 1), k)
