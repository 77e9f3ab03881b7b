"""A directory tree as a Spark data source: one row for each regular file, hidden ones included.

Spark's own file listing leaves out hidden and empty files and cuts times to milliseconds, so this is a Python data
source. The driver lists the upper directories until there are enough of them to read in parallel; tasks walk,
prune and hash. Every task must see the tree under the same path.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arbolith.functions.digest import file_digest
from arbolith.functions.paths import ALWAYS_EXCLUDED, normalised
from arbolith.operators.state import reuse_hashes
from arbolith.schemas import SCAN
from arbolith.sources.ignore import Rule, ignored, parse

ATTEMPTS = 3


def file_stat(path: str) -> tuple[int, int]:
    """Size and modification time in ns; a time before 1970 is an error."""
    found = os.stat(path)
    if found.st_mtime_ns < 0:
        raise ValueError(f"modified before 1970: {path}")
    return found.st_size, min(found.st_mtime_ns, (1 << 63) - 1)


def stable_digest(path: str) -> tuple[int, int, str] | None:
    """Size, time and digest of a file that didn't change meanwhile; None if it keeps changing or is gone."""
    for _ in range(ATTEMPTS):
        try:
            before = file_stat(path)
            digest = file_digest(path)
            if before == file_stat(path):
                return *before, digest
        except FileNotFoundError:
            return None
    return None


class _Part(InputPartition):
    def __init__(self, directory: str, deep: bool):
        self.directory, self.deep = directory, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.names = [n for n in options.get("ignore_files", ".mirrorignore,.ignore").split(",") if n]
        self.hashing = options.get("hash", "true") == "true"
        self.excluded = ALWAYS_EXCLUDED if options.get("exclude", "true") == "true" else ()
        self.parts = int(options.get("partitions", "64"))
        self.kind = options.get("kind", "files")

    def _rules(self, directory: str) -> list[tuple[str, list[Rule]]]:
        """Rules of one directory; of its files the first named is the strongest."""
        found = []
        for name in reversed(self.names):
            try:
                with open(os.path.join(self.root, directory, name), encoding="utf-8") as f:
                    found.append((directory, parse(f.read())))
            except FileNotFoundError:
                pass
        return found

    def _chain(self, directory: str) -> list[tuple[str, list[Rule]]]:
        parts = directory.split("/") if directory else []
        return [r for i in range(len(parts) + 1) for r in self._rules("/".join(parts[:i]))]

    def _entries(self, directory: str, chain: list) -> Iterator[tuple[str, bool]]:
        """(path, whether it is a directory) of what is neither excluded, ignored nor special; links only if they are asked for."""
        for entry in sorted(os.scandir(os.path.join(self.root, directory)), key=lambda e: e.name):
            entry.name.encode()  # a name that isn't UTF-8 fails the scan
            path = f"{directory}/{entry.name}" if directory else entry.name
            mode = entry.stat(follow_symlinks=False).st_mode
            folder = stat.S_ISDIR(mode)
            wanted = folder or (stat.S_ISLNK(mode) if self.kind == "links" else stat.S_ISREG(mode))
            if wanted and entry.name not in self.excluded and not ignored(chain, path, folder):
                yield path, folder

    def partitions(self) -> list[_Part]:
        shallow, deep = [], [""]
        while deep and len(deep) + len(shallow) < self.parts:
            level, deep = deep, []
            for directory in level:
                shallow.append(directory)
                deep += [p for p, folder in self._entries(directory, self._chain(directory)) if folder]
            if len(shallow) > self.parts:
                break
        return [_Part(d, False) for d in shallow] + [_Part(d, True) for d in deep]

    def _walk(self, directory: str, chain: list, deep: bool) -> Iterator[str]:
        for path, folder in self._entries(directory, chain):
            if folder == (self.kind == "folders"):
                yield path
            if folder and deep:
                yield from self._walk(path, [*chain, *self._rules(path)], deep)

    def _rows(self, partition: _Part) -> Iterator[tuple]:
        for path in self._walk(partition.directory, self._chain(partition.directory), partition.deep):
            full = os.path.join(self.root, path)
            if self.kind != "files":
                yield normalised(path), path, 0, max(0, os.lstat(full).st_mtime_ns), None, True
            elif self.hashing:
                found = stable_digest(full)
                size, mtime, digest = found or (0, 0, None)
                yield normalised(path), path, size, mtime, digest, found is not None
            else:
                yield normalised(path), path, *file_stat(full), None, True

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(SCAN.names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))))
        rows = self._rows(partition)
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


class TreeSource(DataSource):
    """Options: path (the root), ignore_files, hash (false: only stat), exclude (false: also what is always excluded), partitions, kind (files, links or folders)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self):
        return SCAN

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


@F.pandas_udf(T.StructType([SCAN["size"], SCAN["mtime_ns"], SCAN["hash"]]))
def _digest_files(path: pd.Series) -> pd.DataFrame:
    found = [stable_digest(p) or (None, None, None) for p in path]
    return pd.DataFrame(found, columns=["size", "mtime_ns", "hash"]).astype({"size": "Int64", "mtime_ns": "Int64"})


def scan_tree(spark: SparkSession, root: str, baseline: DataFrame | None = None, **options: str) -> DataFrame:
    """path, raw_path, size, mtime_ns, hash of the stable files under `root`.

    With a baseline, only files whose path, size or time it doesn't know are hashed. Files are dealt over all tasks to be hashed, whatever folder
    they lie in.
    """
    spark.dataSource.register(TreeSource)
    columns = ["path", "raw_path", "size", "mtime_ns", "hash"]
    listed = spark.read.format("tree").options(path=root, **options).option("hash", "false").load().drop("hash", "stable")
    if baseline is None:
        return hashed(listed, root)
    known = reuse_hashes(listed, baseline)
    hits = known.filter("known_hash is not null").withColumnRenamed("known_hash", "hash")
    return hits.select(*columns).unionByName(hashed(known.filter("known_hash is null"), root))


def listed_tree(spark: SparkSession, root: str, kind: str, **options: str) -> DataFrame:
    """path, raw_path and mtime_ns of the files, links (which a scan skips) or folders under `root`, after the ignore rules."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=root, kind=kind, hash="false", **options).load().select("path", "raw_path", "mtime_ns")


def hashed(files: DataFrame, root: str) -> DataFrame:
    """path, raw_path, size, mtime_ns and hash of those of `files` (path, raw_path) that hold still."""
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.col("raw_path"))
    dealt = files.select("path", "raw_path").repartition(files.sparkSession.sparkContext.defaultParallelism, "raw_path")
    found = dealt.select("path", "raw_path", _digest_files(full).alias("d"))
    return found.filter("d.hash is not null").select("path", "raw_path", "d.size", "d.mtime_ns", "d.hash")
