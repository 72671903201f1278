"""What Python workers and long plans need."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package from where the driver has it."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed now, in the folder that ``spark.checkpoint.dir`` names; lineage ends there. Only a session in local
    mode without that setting gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
