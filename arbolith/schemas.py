"""Schemas of the tree-snapshot tables and the order of plan actions."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("download", "upload", "delete-local", "delete-remote", "conflict")
CHANGES = ("unchanged", "created", "modified", "deleted")


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


TEXT, LONG = T.StringType(), T.LongType()
LOCAL = _schema(("path", TEXT, False), ("size", LONG, False), ("mtime_ns", LONG, False), ("hash", TEXT, False))
SCAN = _schema(
    ("path", TEXT, False), ("raw_path", TEXT, False), ("size", LONG, False), ("mtime_ns", LONG, False), ("hash", TEXT, True),
    ("stable", T.BooleanType(), False),
)
BASELINE = _schema(
    ("path", TEXT, False), ("size", LONG, False), ("mtime_ns", LONG, False), ("content_hash", TEXT, False),
    ("last_synced_hash", TEXT, True), ("updated_at", LONG, False),
)
MANIFEST = _schema(("path", TEXT, False), ("size", LONG, False), ("content_hash", TEXT, False), ("object_key", TEXT, False))
PLAN = _schema(("kind_ord", T.IntegerType(), False), ("kind", TEXT, False), ("path", TEXT, False))
OUTCOME = _schema(
    ("path", TEXT, False), ("kind", TEXT, False), ("status", TEXT, False), ("size", LONG, True), ("mtime_ns", LONG, True), ("hash", TEXT, True)
)
