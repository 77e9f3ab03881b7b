"""Working tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder; only a local session where the setting is missing (tests, a laptop) takes a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


def local_path(folder: str) -> str:
    """A folder of the shared file system as a path that all tasks can open."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a folder that files can be opened in: {folder}")
    return parts.path


def saved(df: DataFrame) -> DataFrame:
    """`df`, written there; its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
