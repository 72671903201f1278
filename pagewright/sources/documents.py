"""Documents of pages as a table: page texts, or positioned items.

``format("pagewright_pages")`` reads files that a decoder opens. Filters on the page and the kind of an item go into the
reader, so that only the pages asked for are decoded. Small files share a partition. A file, or a page, that can't be
read is one row with an ``error``, and the others are read all the same; a filter on the page leaves such rows out, as
their page is null.

A decoder is named as ``module:class``. It has ``pages(raw)``, which gives (page, handle) without decoding, and
``decode(handle)``, which gives a page as a dictionary. ``StoredPages`` reads the form that ``stored`` makes: a line of
JSON for each page, which begins with its number.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..runtime import importable
from .sink import opened

TEXT = "path string, page int, markdown string, needs_ocr boolean, has_table boolean, has_columns boolean, error string"
ITEMS = "path string, page int, item_no long, text string, x double, y double, width double, height double, font_size double, item_type string, error string"
_ITEM = ("item_no", "text", "x", "y", "width", "height", "font_size", "item_type")
_FLAGS = ("needs_ocr", "has_table", "has_columns")
_TESTS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class StoredPages:
    """A line of JSON for each page, its number first."""

    _PAGE = re.compile(rb'\s*\{\s*"page"\s*:\s*(\d+)\s*[,}]')

    def pages(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        for line in raw.splitlines():
            if line.strip():
                found = self._PAGE.match(line)
                if not found:
                    raise ValueError("not a document of stored pages")
                yield int(found[1]), line

    def decode(self, handle: bytes) -> dict:
        return json.loads(handle)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.items = options["path"], options.get("kind", "text") == "items"
        self.decoder = options.get("decoder", f"{StoredPages.__module__}:{StoredPages.__name__}")
        self.size = int(options.get("partition_bytes", str(64 << 20)))
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            own = column == "page" or self.items and column == "item_type"
            if own and isinstance(f, (EqualTo, In)):
                self.wanted.append((column, In, frozenset(f.value if isinstance(f, In) else [f.value])))
            elif column == "page" and type(f) in (*_TESTS, IsNotNull):
                self.wanted.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        dealt, room = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if room < f.size or not dealt:
                dealt.append(Files([]))
                room = self.size
            dealt[-1].paths.append(f.path)
            room -= f.size
        return dealt or [Files([])]

    def _holds(self, column: str, value) -> bool:
        return all(value is not None and (value in x if test is In else test is IsNotNull or _TESTS[test](value, x)) for c, test, x in self.wanted if c == column)

    def read(self, partition: Files) -> Iterator[tuple]:
        module, _, name = self.decoder.partition(":")
        decoder = getattr(importlib.import_module(module), name)()
        files, _ = opened(self.path)
        for path in partition.paths:
            try:
                with files.open_input_stream(path) as f:
                    pages = list(decoder.pages(f.read()))
            except Exception as e:
                yield from self._failed(path, None, e)
                continue
            for page, handle in pages:
                if not self._holds("page", page):
                    continue
                try:
                    rows = list(self._rows(path, page, decoder.decode(handle)))
                except Exception as e:
                    rows = self._failed(path, page, e)
                yield from rows

    def _failed(self, path: str, page: int | None, e: Exception) -> Iterator[tuple]:
        if self._holds("page", page) and self._holds("item_type", None):
            yield path, page, *[None] * (len(_ITEM) if self.items else 1 + len(_FLAGS)), f"{type(e).__name__}: {e}"

    def _rows(self, path: str, page: int, decoded: dict) -> Iterator[tuple]:
        if not self.items:
            yield path, page, decoded.get("markdown") or "", *[bool(decoded.get(c)) for c in _FLAGS], None
            return
        for k, item in enumerate(decoded.get("items") or []):
            if self._holds("item_type", item.get("item_type", "Text")):
                own = {"item_no": k, "text": "", "item_type": "Text", "height": item.get("font_size", 0.0)} | item
                yield path, page, int(own["item_no"]), own["text"], *[float(own.get(c) or 0.0) for c in _ITEM[2:7]], own["item_type"], None


class PageSource(DataSource):
    """Options: ``path`` (a file or a folder), ``kind`` (text or items), ``decoder``, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "pagewright_pages"

    def schema(self) -> str:
        return ITEMS if self.options.get("kind", "text") == "items" else TEXT

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def _read(spark: SparkSession, path: str, kind: str, decoder: str | None) -> DataFrame:
    importable(spark).dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("pagewright_pages").option("path", path).option("kind", kind)
    return (reader.option("decoder", decoder) if decoder else reader).load()


def read_pages(spark: SparkSession, path: str, decoder: str | None = None) -> DataFrame:
    """(path, page, markdown, needs_ocr, has_table, has_columns, error)."""
    return _read(spark, path, "text", decoder)


def read_items(spark: SparkSession, path: str, decoder: str | None = None) -> DataFrame:
    """(path, page, item_no, text, x, y, width, height, font_size, item_type, error)."""
    return _read(spark, path, "items", decoder)


def stored(pages: DataFrame, items: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(name, content): documents in the form that ``StoredPages`` reads, for ``sink.write_files``."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in pages.columns else F.lit(False).alias(c) for c in _FLAGS]
    rows = pages.select(id_col, F.col("page").cast("int").alias("page"), "markdown", *flags)
    if items is not None:
        own = items.groupBy(id_col, F.col("page").cast("int").alias("page")).agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("items"))
        rows = rows.join(own, [id_col, "page"], "left")
    line = F.to_json(F.struct("page", "markdown", *_FLAGS, *(["items"] if items is not None else [])))
    lines = F.sort_array(F.collect_list(F.struct("page", line.alias("line"))))
    found = rows.groupBy(id_col).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
    return found.select(F.concat(F.col(id_col).cast("string"), F.lit(".jsonl")).alias("name"), "content")
