"""Applying a plan: downloads, uploads, local deletes, then one commit, then object deletes.

Transfers are narrow jobs: tasks read a file or object in frames, Spark seals or opens the frames, and tasks of the same
partition write them, whole files at a time through a temporary file and a rename; so a task may run again. Large files go in parts (`parts`). Nothing is
committed before all transfers are done, and objects are only deleted once no manifest names them.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions import envelope
from arbolith.functions.keys import object_key_from
from arbolith.functions.paths import assert_safe
from arbolith.operators import state as tables
from arbolith.operators.reconcile import bookkeeping, changes, last_wins, of_kind, plan
from arbolith.plans.manifest import read_manifest, write_manifest
from arbolith.plans.parts import PART_BYTES, forget_parts, upload_in_parts
from arbolith.plans.transfer import DONE, FRAME, FRAMES, NewFile, task
from arbolith.schemas import OUTCOME
from arbolith.sources.objects import FolderStore
from arbolith.sources.tables import State, local_uri
from arbolith.sources.tree import file_stat, scan_tree

@dataclass(frozen=True)
class Mirror:
    """A local root and a store that the driver and all tasks see under the same paths, and where keys come from."""

    root: str
    store: str
    state: str
    prefix: str
    content_key: Callable[[], bytes]
    name_key: Callable[[], bytes]
    manifest_key: Callable[[], bytes]
    ignore_file: str = ".mirrorignore"
    part_bytes: int = PART_BYTES  # larger files are uploaded in parts of so many bytes


def _read_files(root: str, frame_bytes: int):
    """Frames of each local file; the last one has the size, time and hash of what was read, or no hash if it changed."""

    def rows(files: Iterator[dict]) -> Iterator[tuple]:
        for row in files:
            full = os.path.join(root, row["raw_path"])
            digest, number = hashlib.sha256(), 0
            try:
                before = file_stat(full)
                with open(full, "rb") as f:
                    chunk = f.read(frame_bytes)
                    while True:
                        digest.update(chunk)
                        ahead = f.read(frame_bytes)
                        if not ahead:
                            break
                        yield row["path"], row["object_key"], number, False, chunk, None, None, None
                        chunk, number = ahead, number + 1
                steady = before == file_stat(full)
            except FileNotFoundError:
                before, chunk, steady = (0, 0), b"", False
            yield row["path"], row["object_key"], number, True, chunk, *before, digest.hexdigest() if steady else None

    return task(rows, FRAME)


def _write_objects(store: str, prefix: str):
    """Frames of a partition, in order, to objects; each frame follows its length."""

    def rows(frames: Iterator[dict]) -> Iterator[tuple]:
        new = None
        try:
            for row in frames:
                if row["frame"] == 0:
                    target = os.path.join(store, prefix + row["object_key"])
                    new = NewFile(target, f"{target}.{uuid.uuid4().hex}.part")
                new.write(len(row["content"]).to_bytes(4, "big") + row["content"])
                if row["last"]:
                    steady = row["hash"] is not None
                    done, new = new, None
                    done.keep() if steady else done.drop()
                    yield row["path"], "upload", "done" if steady else "deferred", row["size"], row["mtime_ns"], row["hash"]
        finally:
            if new:
                new.drop()

    return task(rows, DONE)


def _read_objects(store: str, prefix: str):
    def rows(entries: Iterator[dict]) -> Iterator[tuple]:
        for row in entries:
            number = 0
            with open(os.path.join(store, prefix + row["object_key"]), "rb") as f:
                head = f.read(4)
                while head:
                    box = f.read(int.from_bytes(head, "big"))
                    head = f.read(4)
                    yield row["path"], row["object_key"], number, not head, box, row["size"], None, row["content_hash"]
                    number += 1

    return task(rows, FRAME)


def _write_files(root: str):
    def rows(frames: Iterator[dict]) -> Iterator[tuple]:
        new = None
        try:
            for row in frames:
                if row["frame"] == 0:
                    new = NewFile(os.path.join(root, row["path"]), os.path.join(root, ".mirror", "tmp", uuid.uuid4().hex))
                new.write(row["content"])
                if row["last"]:
                    if new.digest.hexdigest() != row["hash"]:
                        raise ValueError(f"content doesn't match its hash: {row['path']}")
                    done, new = new, None
                    done.keep()
                    yield row["path"], "download", "done", *file_stat(done.target), row["hash"]
        finally:
            if new:
                new.drop()

    return task(rows, DONE)


def _delete(folder: str, prefix: str, column: str, kind: str):
    def rows(wanted: Iterator[dict]) -> Iterator[tuple]:
        for row in wanted:
            try:
                os.unlink(os.path.join(folder, prefix + row[column]))
            except FileNotFoundError:
                pass
            yield row["path"], kind, "done", None, None, None

    return task(rows, DONE)


def uploads(mirror: Mirror, files: DataFrame) -> DataFrame:
    """Outcomes of sealing and storing `files` (path, raw_path)."""
    named = files.select("path", "raw_path", object_key_from(mirror.name_key)(F.col("path")).alias("object_key"))
    frames = named.mapInArrow(_read_files(mirror.root, envelope.FRAME_BYTES), FRAMES)
    context = envelope.frame_context(F.col("object_key"), F.col("frame"), F.col("last"))
    key = envelope.secret_column(mirror.content_key)(F.col("path"))
    return frames.withColumn("content", envelope.sealed(F.col("content"), key, context)).mapInArrow(
        _write_objects(mirror.store, mirror.prefix), OUTCOME
    )


def downloads(mirror: Mirror, entries: DataFrame) -> DataFrame:
    """Outcomes of fetching and opening manifest entries."""
    wanted = entries.select(assert_safe(F.col("path")).alias("path"), "size", "content_hash", "object_key")
    frames = wanted.mapInArrow(_read_objects(mirror.store, mirror.prefix), FRAMES)
    context = envelope.frame_context(F.col("object_key"), F.col("frame"), F.col("last"))
    key = envelope.secret_column(mirror.content_key)(F.col("path"))
    refused = F.raise_error(F.concat(F.lit("an object doesn't open: "), F.col("path"))).cast("binary")
    opened = F.coalesce(envelope.opened(F.col("content"), key, context), refused)
    return frames.withColumn("content", opened).mapInArrow(_write_files(mirror.root), OUTCOME)


def compare(spark: SparkSession, mirror: Mirror) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """local, baseline, remote and the changes between them."""
    state = State(spark, mirror.state)
    baseline = state.baseline()
    local = last_wins(scan_tree(spark, mirror.root, baseline, ignore_files=f"{mirror.ignore_file},.ignore"), "raw_path")
    remote = read_manifest(spark, FolderStore(mirror.store), mirror.prefix, state, mirror.manifest_key)
    return local, baseline, remote, changes(local, baseline, remote)


def sync(spark: SparkSession, mirror: Mirror, now: int) -> DataFrame:
    """Brings both sides together; the outcome of every action, a table that stays until the next run. Conflicts are left as they are.

    Working tables, which hold the opened manifest, are gone when this returns or fails.
    """
    work, outcomes = (os.path.join(mirror.state, f"{name}-{uuid.uuid4().hex}") for name in ("work", "outcomes"))
    forget(mirror, "outcomes-")
    try:
        _sync(spark, mirror, now, local_uri(work)).write.parquet(local_uri(outcomes))
    finally:
        forget(mirror, "work-")
    return spark.read.parquet(local_uri(outcomes))


def _sync(spark: SparkSession, mirror: Mirror, now: int, work: str) -> DataFrame:
    state, store = State(spark, mirror.state), FolderStore(mirror.store)
    local, baseline, remote, changed = compare(spark, mirror)

    def written(df: DataFrame, name: str) -> DataFrame:
        """Kept once, so that neither the scan nor a transfer happens again when its rows are read again."""
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    local, remote = written(local, "local"), written(remote, "remote")
    changed = written(changes(local, baseline, remote), "changes")
    actions, mend = plan(changed), bookkeeping(changed)
    down = written(downloads(mirror, tables.download_entries(actions, remote)), "download")
    wanted = local.join(of_kind(actions, "upload"), "path", "left_semi")
    large = wanted.filter(F.col("size") > mirror.part_bytes)
    up = uploads(mirror, wanted.filter(F.col("size") <= mirror.part_bytes))
    if not large.isEmpty():
        up = up.unionByName(upload_in_parts(mirror, large, mirror.part_bytes, written))
    up = written(up, "upload")
    gone = written(
        local.join(of_kind(actions, "delete-local"), "path", "left_semi")
        .select("path", "raw_path")
        .mapInArrow(_delete(mirror.root, "", "raw_path", "delete-local"), OUTCOME),
        "delete-local",
    )
    sent = up.filter("status = 'done'")
    done = actions.join(up.filter("status <> 'done'").select("path"), "path", "left_anti")
    named = object_key_from(mirror.name_key)(F.col("path")).alias("object_key")
    manifest = tables.manifest_after(remote, done, sent.select("path", "size", F.col("hash").alias("content_hash"), named))
    here = sent.select("path", "size", "mtime_ns", "hash")
    adopted = local.join(mend.filter("step = 'adopt'"), "path", "left_semi").select("path", "size", "mtime_ns", "hash")
    after = tables.baseline_after(baseline, done, here.unionByName(adopted), down, mend, now)
    generation = state.generation() + 1
    write_manifest(manifest, store, mirror.prefix, generation, mirror.manifest_key)
    state.commit(after, generation)
    forget_parts(mirror)
    removed = written(
        tables.remote_deletes(actions, remote).mapInArrow(_delete(mirror.store, mirror.prefix, "object_key", "delete-remote"), OUTCOME),
        "delete-remote",
    )
    conflicts = of_kind(actions, "conflict").select(
        "path", "kind", F.lit("conflict").alias("status"), *(F.lit(None).cast(t).alias(n) for n, t in (("size", "long"), ("mtime_ns", "long"), ("hash", "string")))
    )
    missing = of_kind(actions, "delete-remote").join(removed.select("path"), "path", "left_anti")
    absent = missing.select("path", "kind", F.lit("done").alias("status"))
    outcomes = down
    for part in (up, gone, removed, conflicts, absent):
        outcomes = outcomes.unionByName(part, allowMissingColumns=True)
    return outcomes


def forget(mirror: Mirror, prefix: str) -> None:
    """Removes tables of this or earlier runs."""
    os.makedirs(mirror.state, exist_ok=True)
    for name in os.listdir(mirror.state):
        if name.startswith(prefix):
            shutil.rmtree(os.path.join(mirror.state, name), ignore_errors=True)
