"""Object stores: a protocol, a folder that all tasks see, and a dictionary for tests on the driver."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions.paths import under
from arbolith.sources.tree import TreeSource


class ObjectStore(Protocol):
    def put(self, key: str, chunks: Iterator[bytes]) -> None: ...
    def get(self, key: str) -> bytes: ...
    def head(self, key: str) -> int | None: ...
    def delete(self, key: str) -> None: ...
    def list(self, prefix: str) -> Iterator[tuple[str, int]]: ...
    def check(self) -> None: ...


class FolderStore:
    """Objects are files under a root that the driver and all tasks share. Writes replace atomically, so that a task may
    be run twice."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, key: str) -> str:
        if ".." in key.split("/"):
            raise ValueError(f"bad key: {key}")
        return os.path.join(self.root, key.lstrip("/"))

    def put(self, key: str, chunks: Iterator[bytes]) -> None:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}.part"
        with open(temporary, "wb") as f:
            for chunk in chunks:
                f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)

    def get(self, key: str) -> bytes:
        with open(self._path(key), "rb") as f:
            return f.read()

    def head(self, key: str) -> int | None:
        try:
            return os.stat(self._path(key)).st_size
        except FileNotFoundError:
            return None

    def delete(self, key: str) -> None:
        try:
            os.unlink(self._path(key))
        except FileNotFoundError:
            pass

    def list(self, prefix: str) -> Iterator[tuple[str, int]]:
        for directory, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(directory, name)
                key = os.path.relpath(path, self.root).replace(os.sep, "/")
                if key.startswith(prefix.lstrip("/")) and not name.endswith(".part"):
                    yield key, os.stat(path).st_size

    def check(self) -> None:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such store: {self.root}")


class MemoryStore:
    """The protocol on a dictionary."""

    def __init__(self):
        self.objects: dict[str, bytes] = {}

    def put(self, key: str, chunks: Iterator[bytes]) -> None:
        self.objects[key] = b"".join(chunks)

    def get(self, key: str) -> bytes:
        return self.objects[key]

    def head(self, key: str) -> int | None:
        return len(self.objects[key]) if key in self.objects else None

    def delete(self, key: str) -> None:
        self.objects.pop(key, None)

    def list(self, prefix: str) -> Iterator[tuple[str, int]]:
        yield from sorted((k, len(v)) for k, v in self.objects.items() if k.startswith(prefix))

    def check(self) -> None:
        pass


def listed(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Those of `objects` (key, size) under a prefix; unfinished writes are none."""
    return objects.filter(under(F.col("key"), prefix.lstrip("/")) & ~F.endswith("key", F.lit(".part")))


def object_listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key and size of the objects of a FolderStore as `FolderStore.list` gives them, hidden and empty ones too, listed by tasks."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").options(path=root, ignore_files="", hash="false", exclude="false").load()
    return listed(found.select(F.col("raw_path").alias("key"), "size"), prefix)
