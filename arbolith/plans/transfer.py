"""What transfer tasks share: schemas of frames and outcomes, batches bounded in bytes, and files that appear when they are whole."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa

FRAME = pa.schema(
    [("path", pa.string()), ("object_key", pa.string()), ("frame", pa.int64()), ("last", pa.bool_()), ("content", pa.binary()),
     ("size", pa.int64()), ("mtime_ns", pa.int64()), ("hash", pa.string())]
)
FRAMES = "path string, object_key string, frame long, last boolean, content binary, size long, mtime_ns long, hash string"
DONE = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("status", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("hash", pa.string())]
)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of so many, or of so many bytes of their binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def task(rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: pa.Schema):
    """A function for mapInArrow from one that maps rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(row for batch in batches for row in batch.to_pylist()), schema)

    return run


class NewFile:
    """A file written beside its target, which it replaces when it is whole; else nothing of it stays."""

    def __init__(self, target: str, temporary: str):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.makedirs(os.path.dirname(temporary), exist_ok=True)
        self.target, self.temporary, self.out = target, temporary, open(temporary, "wb")  # noqa: SIM115
        self.digest = hashlib.sha256()

    def write(self, content: bytes) -> None:
        self.out.write(content)
        self.digest.update(content)

    def keep(self) -> None:
        self.out.flush()
        os.fsync(self.out.fileno())
        self.out.close()
        os.replace(self.temporary, self.target)

    def drop(self) -> None:
        self.out.close()
        os.unlink(self.temporary)
