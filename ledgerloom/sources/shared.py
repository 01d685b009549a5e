"""The folder that driver and executors share, and checkpoints and tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the one given to setCheckpointDir.

    A session of one process that names no folder gets a temporary one; on a cluster that is an error.
    """
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in spark.checkpoint.dir: lineage is cut and lost executors cost nothing."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in spark.checkpoint.dir, for what several branches read: its joins run once. It stays there."""
    at = f"{_shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
