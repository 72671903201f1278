"""Files from rows, all of them or none.

``format("pagewright_files")`` writes each row's ``content`` to a file of its ``name`` below ``path``. Tasks write to a
staging folder beside the files; only when every task is done does the commit move the files to their places, and a job
that fails leaves neither files nor the folder. Folders are opened by their URI (a local path, or what pyarrow reads:
``hdfs://``, ``s3://`` and others), which driver and executors must share.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..runtime import importable


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
    return fs.LocalFileSystem(), path


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace = path.rstrip("/"), replace
        self.staging = f"_staging-{uuid.uuid4().hex}"
        # Made here, and once: a task that is still running when the job has failed and cleared up can't bring it back.
        files, root = opened(self.path)
        files.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> Staged:
        files, root = opened(self.path)
        # By attempt, so that a task that is tried again or twice at once doesn't meet its own files.
        folder = f"{root}/{self.staging}/{TaskContext.get().taskAttemptId()}"
        files.create_dir(folder, recursive=False)
        names = []
        for row in rows:
            name, content = row["name"], row["content"]
            if not name or name.startswith(("/", "_staging-")) or ".." in name.split("/"):
                raise ValueError(f"not a name of a file below the folder: {name!r}")
            with files.open_output_stream(f"{folder}/{len(names)}") as out:
                out.write(bytes(content or b""))
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.path)
        done = [m for m in messages if m is not None]
        twice = [n for n, k in Counter(n for m in done for n in m.names).items() if k > 1]
        if twice:
            raise ValueError(f"several rows have the name {twice[0]!r}")
        places = [(f"{m.folder}/{k}", f"{root}/{n}") for m in done for k, n in enumerate(m.names)]
        if not self.replace:
            for there in files.get_file_info([to for _, to in places]) if places else []:
                if there.type != fs.FileType.NotFound:
                    raise FileExistsError(there.path)
        for folder in {to.rpartition("/")[0] for _, to in places}:
            files.create_dir(folder, recursive=True)
        for at, to in places:
            files.move(at, to)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = opened(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class FileSink(DataSource):
    """Options: ``path``, and ``replace`` (true by default): whether files that are there may be replaced."""

    @classmethod
    def name(cls) -> str:
        return "pagewright_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], self.options.get("replace", "true").lower() == "true")


def write_files(rows: DataFrame, path: str, replace: bool = True) -> None:
    """``rows``: name, content (binary or text). All files are there afterwards, or none is."""
    importable(rows.sparkSession).dataSource.register(FileSink)
    own = rows.select("name", F.col("content").cast("binary").alias("content"))
    own.write.format("pagewright_files").mode("append").option("path", path).option("replace", str(replace).lower()).save()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all files below a folder, by their path from there; of a folder that isn't there, none."""
    files, root = opened(path)
    root = root.rstrip("/")
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "name string, content binary")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.substring("path", F.locate(f"{root}/", F.col("path")) + len(root) + 1, F.length("path")).alias("name"), "content")


def copy_missing(spark: SparkSession, source: str, target: str) -> int:
    """Copy what the target folder doesn't have, replacing nothing; how many files that were."""
    here = listing(spark, target).select("name")  # names only, so that their bytes stay unread
    missing = listing(spark, source).join(here, "name", "left_anti")
    n = missing.select("name").count()
    if n:
        write_files(missing, target, replace=False)
    return n
