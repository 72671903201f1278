"""What the operators share: session settings, lineage cuts, two-level ranks and 64-bit rolling hashes of words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of rows that the JVM hands to Python at once; bounds a worker's memory when texts are very long.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, let Python workers import this package, and see to a checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``. Only a session in local mode without that setting gets a
    temporary folder of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables in the shared checkpoint folder that cut lineage, and go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.base = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete the tables, and let Spark's cleaner drop the shuffle files of the stages that wrote or read them."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that a partition should hold at most where its number is given by hand, so that it does not grow with the data.
PART_BYTES = 256 << 20


def parts(spark: SparkSession, size: int) -> int:
    """Partitions for so many bytes: those of the session, or more."""
    return max(partitions(spark), -(-size // PART_BYTES))


_OWN: dict[tuple, object] = {}


def own(key: tuple, make):
    """What a Python worker keeps from task to task, by key; another operator's goes first, as workers serve them all."""
    if key not in _OWN:
        release(key[0])
        _OWN[key] = make()
    return _OWN[key]


def release(operator: str = "") -> None:
    """Let go of what this worker keeps for other operators."""
    for key in [k for k in _OWN if k[0] != operator]:
        del _OWN[key]


def fields(text: str) -> T.StructType:
    """``fields("doc_id long, n int")``: a schema from DDL."""
    return T._parse_datatype_string(text)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, key: list[str], order: list[str], spread: Column, rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 without gaps, and without ever holding a key's rows in one task.

    Rows of a key are dealt into ``spread`` buckets; buckets get their place from a running sum of counts (one small
    row a key and bucket), rows theirs within the bucket. ``order`` fixes the numbering inside a bucket.
    """
    df = df.withColumn("_bucket", spread)
    sizes = df.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.Window.partitionBy(*key).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.Window.partitionBy(*key, "_bucket").orderBy(*order)
    df = df.withColumn("_within", F.row_number().over(within) - 1)
    return df.join(sizes, [*key, "_bucket"]).withColumn(rank, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


# ---- rolling hashes, vectorised over a document's bytes and words ----

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Odd multipliers of the polynomial hashes mod 2**64: of bytes in a word, and two of words in a sequence.
BYTES, WORDS, WORDS_TOO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i <= n."""
    up, down = _POWERS.get(base, (np.zeros(0, np.uint64),) * 2)
    if len(up) <= n:
        size = max(n + 1, 1 << 14, min(2 * len(up), 1 << 22))
        ones = lambda x: np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])
        _POWERS[base] = up, down = np.multiply.accumulate(ones(base)), np.multiply.accumulate(ones(pow(base, -1, 1 << 64)))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, in constant time each."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word ``[^\\x20\\x09-\\x0D]+``."""
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(raw, np.uint8)], prepend=True, append=True))
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    starts, ends = word_spans(raw)
    return Rolling(np.frombuffer(raw, np.uint8), BYTES).of(starts, ends)
