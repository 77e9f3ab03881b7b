"""Uploading large files in parts: several tasks seal one file, and a later run seals only what is missing.

A file is cut into parts of at least `part_bytes`, larger ones if there were more than `most` of them, each a whole number of frames. A part is read, sealed and
written like an object of its own, under the name of its upload: a digest of path, size, time, hash and part size, so that a part that is
there belongs to the very file that is uploaded now. A part file appears by a rename when it is whole; what a killed run has finished is therefore taken over, and parts of a file that
changed since are never taken. Frames carry their number in the whole file, and only the file's last one is marked as last: parts that follow each other are the
object that one task would have written, and it is read in the same way. When all are there, one task strings them together, without opening them.

A part counts only if the file's size and time are those of the scan before and after it was read; the hash is the scan's.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.functions import envelope
from arbolith.functions.keys import object_key_from
from arbolith.plans.transfer import DONE, FRAME, FRAMES, NewFile, task
from arbolith.schemas import OUTCOME
from arbolith.sources.tree import file_stat

if TYPE_CHECKING:
    from arbolith.plans.apply import Mirror

PART_BYTES = 8 << 20
MOST_PARTS = 10_000


def part_plan(files: DataFrame, part_bytes: int = PART_BYTES, most: int = MOST_PARTS, unit: int = envelope.FRAME_BYTES) -> DataFrame:
    """`files` (size, ...) once for each part, with part (from 0), parts, step (bytes a part, a multiple of `unit`), first and bytes. An empty file is one part."""
    needed = F.ceil(F.col("size") / most / unit) * unit
    least = -(-part_bytes // unit) * unit
    step = F.greatest(F.lit(least), needed).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("step"))).cast("long")
    sized = files.withColumn("step", step).withColumn("parts", parts)
    each = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    first = F.col("part") * F.col("step")
    return each.withColumn("first", first).withColumn("bytes", F.least(F.col("step"), F.col("size") - first))


def _upload_id() -> Column:
    named = F.concat_ws("\n", "path", *(F.col(c).cast("string") for c in ("size", "mtime_ns", "hash", "step")))
    return F.substring(F.sha2(named, 256), 1, 32)


def part_path(store: str, prefix: str, upload: str, part: int) -> str:
    return os.path.join(store, f"{prefix}parts", upload, f"{part:05}")


def _read_parts(root: str, store: str, prefix: str, frame_bytes: int):
    """Frames of the parts that aren't stored yet, each part's last one with the size and time that held all the while (else no hash)."""

    def rows(parts: Iterator[dict]) -> Iterator[tuple]:
        for row in parts:
            if os.path.exists(part_path(store, prefix, row["upload"], row["part"])):
                continue
            full, known = os.path.join(root, row["raw_path"]), (row["size"], row["mtime_ns"])
            number, left = row["first"] // frame_bytes, row["bytes"]
            try:
                steady = file_stat(full) == known
                with open(full, "rb") as f:
                    f.seek(row["first"])
                    while True:
                        chunk = f.read(min(frame_bytes, left))
                        left -= len(chunk)
                        if left <= 0 or not chunk:
                            break
                        yield row["path"], row["object_key"], number, False, chunk, row["part"], None, row["upload"]
                        number += 1
                steady = steady and not left and file_stat(full) == known
            except FileNotFoundError:
                chunk, steady = b"", False
            last = steady and row["part"] == row["parts"] - 1
            # size carries the part, mtime_ns 1 the end of a steady part and 0 that of one that isn't, hash the upload
            yield row["path"], row["object_key"], number, last, chunk, row["part"], int(steady), row["upload"]

    return task(rows, FRAME)


def _write_parts(store: str, prefix: str):
    def rows(frames: Iterator[dict]) -> Iterator[tuple]:
        new = None
        try:
            for row in frames:
                if new is None:
                    target = part_path(store, prefix, row["hash"], row["size"])
                    new = NewFile(target, f"{target}.{uuid.uuid4().hex}.part")
                new.write(len(row["content"]).to_bytes(4, "big") + row["content"])
                if row["mtime_ns"] is not None:
                    done, new = new, None
                    done.keep() if row["mtime_ns"] else done.drop()
                    yield row["path"], "part", "done" if row["mtime_ns"] else "deferred", row["size"], None, row["hash"]
        finally:
            if new:
                new.drop()

    return task(rows, DONE)


def _join_parts(store: str, prefix: str):
    """An object from the parts of each file that has all of them; a file that hasn't is left for a later run."""

    def rows(files: Iterator[dict]) -> Iterator[tuple]:
        for row in files:
            parts = [part_path(store, prefix, row["upload"], k) for k in range(row["parts"])]
            whole = all(map(os.path.exists, parts))
            target = os.path.join(store, prefix + row["object_key"])
            if whole:
                new = NewFile(target, f"{target}.{uuid.uuid4().hex}.part")
                try:
                    for part in parts:
                        with open(part, "rb") as f:
                            while chunk := f.read(1 << 20):
                                new.write(chunk)
                except BaseException:
                    new.drop()
                    raise
                new.keep()
            yield row["path"], "upload", "done" if whole else "deferred", row["size"], row["mtime_ns"], row["hash"]

    return task(rows, DONE)


def planned_parts(mirror: Mirror, files: DataFrame, part_bytes: int, most: int = MOST_PARTS) -> DataFrame:
    """Parts of `files` (path, raw_path, size, mtime_ns, hash) with their object keys and uploads."""
    named = files.select("path", "raw_path", "size", "mtime_ns", "hash", object_key_from(mirror.name_key)(F.col("path")).alias("object_key"))
    return part_plan(named, part_bytes, most).withColumn("upload", _upload_id())


def seal_parts(mirror: Mirror, parts: DataFrame) -> DataFrame:
    """Outcomes of sealing and storing those of `planned_parts` that aren't stored yet, dealt over all tasks: path, part (as size), upload (as hash)."""
    tasks = parts.sparkSession.sparkContext.defaultParallelism
    dealt = parts.repartition(tasks, "path", "part")
    frames = dealt.mapInArrow(_read_parts(mirror.root, mirror.store, mirror.prefix, envelope.FRAME_BYTES), FRAMES)
    context = envelope.frame_context(F.col("object_key"), F.col("frame"), F.col("last"))
    key = envelope.secret_column(mirror.content_key)(F.col("path"))
    return frames.withColumn("content", envelope.sealed(F.col("content"), key, context)).mapInArrow(_write_parts(mirror.store, mirror.prefix), OUTCOME)


def join_parts(mirror: Mirror, parts: DataFrame) -> DataFrame:
    """Outcomes of the uploads of which `planned_parts` are parts."""
    files = parts.filter("part = 0").drop("part", "first", "bytes")
    return files.mapInArrow(_join_parts(mirror.store, mirror.prefix), OUTCOME)


def upload_in_parts(mirror: Mirror, files: DataFrame, part_bytes: int, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Outcomes of uploading `files` (path, raw_path, size, mtime_ns, hash) in parts. `written` keeps a table once, so that parts are sealed before they are joined."""
    parts = written(planned_parts(mirror, files, part_bytes), "parts")
    written(seal_parts(mirror, parts), "sealed")
    return join_parts(mirror, parts)


def forget_parts(mirror: Mirror, uploads: set[str] | None = None) -> None:
    """Deletes stored parts: those of `uploads`, or all."""
    folder = os.path.join(mirror.store, f"{mirror.prefix}parts")
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        if uploads is None or name in uploads:
            shutil.rmtree(os.path.join(folder, name), ignore_errors=True)
