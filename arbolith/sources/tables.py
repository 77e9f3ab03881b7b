"""Baseline and generation as Parquet versions behind one pointer file: a single writer, readers see whole versions.

The version before the current one stays for readers that have begun; older ones are deleted.
"""

from __future__ import annotations

import json
import os
import pathlib
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions.digest import checked, non_negative
from arbolith.schemas import BASELINE


def _with_update_times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("updated_at", F.lit(0).cast("long"))


#: From each layout of the baseline to the next one: the first is what version 0 lacked. A table is brought up to date whenever it is read, and written in the last layout.
MIGRATIONS: tuple[Callable[[DataFrame], DataFrame], ...] = (_with_update_times,)
LAYOUT = len(MIGRATIONS)


def migrated(rows: DataFrame, layout: int, steps: tuple[Callable[[DataFrame], DataFrame], ...] = MIGRATIONS) -> DataFrame:
    """`rows` of an older layout in the last one; a layout that is newer than all steps is refused."""
    if not 0 <= layout <= len(steps):
        raise ValueError(f"a baseline of layout {layout}; this version knows layouts up to {len(steps)}")
    for step in steps[layout:]:
        rows = step(rows)
    return rows


def local_uri(path: str) -> str:
    """The path for Spark, on the file system that `os` sees whatever Spark's default is."""
    return pathlib.Path(os.path.abspath(path)).as_uri()


def keep_latest(folder: str, prefix: str, number: int, keep: int = 2) -> None:
    """Deletes the numbered folders in `folder` but for the `keep` up to `number`."""
    for name in os.listdir(folder):
        tail = name.removeprefix(prefix)
        if name.startswith(prefix) and tail.isdigit() and int(tail) <= number - keep:
            shutil.rmtree(os.path.join(folder, name), ignore_errors=True)


class State:
    """What a device last knew: `baseline()` and `generation()`, replaced together by `commit()`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def _pointer(self) -> dict:
        try:
            with open(os.path.join(self.root, "current.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": 0, "generation": 0, "layout": LAYOUT}

    def generation(self) -> int:
        return max(0, int(self._pointer().get("generation") or 0))

    def baseline(self) -> DataFrame:
        """The current rows; sizes below 0 read as 0, a malformed digest fails the read."""
        at = self._pointer()
        if not at["version"]:
            return self.spark.createDataFrame([], BASELINE)
        rows = self.spark.read.parquet(local_uri(os.path.join(self.root, f"v{at['version']}")))
        return migrated(rows, at.get("layout", 0)).select(
            "path",
            non_negative(F.col("size")).alias("size"),
            "mtime_ns",
            checked(F.col("content_hash")).alias("content_hash"),
            checked(F.col("last_synced_hash")).alias("last_synced_hash"),
            "updated_at",
        )

    def commit(self, baseline: DataFrame | None = None, generation: int | None = None) -> None:
        """Writes a new version beside the current one, then moves the pointer."""
        at = self._pointer()
        if baseline is not None:
            at |= {"version": at["version"] + 1, "layout": LAYOUT}
            baseline.write.mode("overwrite").parquet(local_uri(os.path.join(self.root, f"v{at['version']}")))
        if generation is not None:
            at["generation"] = min(generation, (1 << 63) - 1)
        temporary = os.path.join(self.root, "current.json.new")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(at, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, os.path.join(self.root, "current.json"))
        keep_latest(self.root, "v", at["version"])
