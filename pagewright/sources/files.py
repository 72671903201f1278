"""File sources and sinks: Markdown, images, JSON logs, configuration, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mime
from .sink import write_files

USAGE = "date string, kind string, fileCount long, pageCount long, ocrPageCount long, engine string, totalMs long"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, valid): whole files; ``valid`` says whether the bytes are UTF-8 (text is null if not)."""
    raw = spark.read.format("binaryFile").load(path)
    valid = F.call_function("is_valid_utf8", F.col("content").cast("string"))
    return raw.select("path", F.when(valid, F.col("content").cast("string")).alias("text"), valid.alias("valid"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, content) of PNG and JPEG files, by extension in any case."""
    # By name before any bytes are read; letters of either case.
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}").load(path)
    kind = mime(F.regexp_extract("path", r"\.([^.\/]*)$", 1))
    return raw.select("path", kind.alias("mime"), "content").filter("mime IS NOT NULL")


def has_extension(path: Column, ext: str) -> Column:
    return F.lower(path).endswith(f".{ext.lower().lstrip('.')}")


def decode_image(image: Column, scale: Column) -> Column:
    """Bytes of a base64 image; null where it can't be read or the render scale is not positive."""
    return F.when(scale > 0, F.try_to_binary(image, F.lit("base64")))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage log (JSON lines); lines that can't be read are passed over."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def append_usage(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add to the usage log. A stream's batch has a part of the log to itself, so one that is written again, after a
    failure, takes its own place and nothing counts twice: ``writeStream.foreachBatch(lambda b, n: append_usage(b, path, n))``."""
    own = rows.select(*[f.split(" ")[0] for f in USAGE.split(", ")])
    if batch_id is None:
        own.write.mode("append").json(path)
    else:
        own.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch_id}")


def parse_config(text: Column, schema: str, defaults: dict, strict: bool = False) -> Column:
    """A JSON text as a struct, missing or broken fields filled by defaults; ``strict``: null if it can't be read."""
    parsed = F.from_json(text, schema)
    broken = text.isNull() | ~F.coalesce(F.call_function("json_array_length", F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    fields = [F.coalesce(parsed[f.name], F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in T._parse_datatype_string(schema).fields]
    filled = F.struct(*fields)
    return F.when(~broken, filled) if strict else filled


def clamp_settings(settings: DataFrame) -> DataFrame:
    """Settings within their bounds: concurrency 1 to 16, threads 0 to 16, opacity 0 to 100."""
    bound = lambda c, low, high: F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))
    return settings.withColumns({"concurrency": bound("concurrency", 1, 16), "threads": bound("threads", 0, 16), "opacity": bound("opacity", 0, 100)})


def vision_text(response: Column) -> Column:
    """The text of a chat response: a string, or parts joined by newlines; null where blank or missing."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    text = F.when(content.startswith("["), joined).otherwise(content)
    return F.when(F.trim(text) != "", text)


def list_models(spark: SparkSession, path: str, meta_name: str = "layout-meta.json", model_name: str = "model.mnn") -> DataFrame:
    """(dir, name, available): folders with readable metadata, and whether their model file is there; by folder."""
    named = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")
    meta = named(meta_name).select(folder, F.get_json_object(F.col("content").cast("string"), "$.name").alias("name")).filter("name IS NOT NULL")
    # Only the name of a model file is asked for, so its bytes stay unread.
    models = named(model_name).select(folder, F.lit(True).alias("available"))
    return meta.join(models, "dir", "left").na.fill(False, ["available"]).orderBy("dir")


def write_markdown(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> None:
    """A file for each document, its text as it stands; names are the ids, or those of ``name_col``. Files of the same names
    are replaced; all are written or none."""
    name = F.col(name_col) if name_col else F.concat(F.col(id_col).cast("string"), F.lit(".md"))
    write_files(docs.select(name.alias("name"), F.col(text_col).alias("content")), path)


def export_config(rows: DataFrame, secrets: tuple[str, ...] = ("api_key",), include_secrets: bool = False) -> DataFrame:
    """(json): each row as pretty JSON, secrets left out unless asked for."""
    keep = [c for c in rows.columns if include_secrets or c not in secrets]
    return rows.select(F.to_json(F.struct(*keep), {"pretty": "true"}).alias("json"))


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of files, to be matched with an inventory."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
