"""Keyed upserts and deletes on the baseline and the manifest, as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.operators.ordered import running_max


def _upsert(baseline: DataFrame, seen: DataFrame, synced: Column, now: Column) -> DataFrame:
    b, s = baseline.alias("b"), seen.alias("s")
    new = F.col("s.path").isNotNull()
    pick = lambda mine, theirs: F.when(new, F.col(f"s.{mine}")).otherwise(F.col(f"b.{theirs}"))
    return b.join(s, F.col("b.path") == F.col("s.path"), "full").select(
        F.coalesce("s.path", "b.path").alias("path"),
        pick("size", "size").alias("size"),
        pick("mtime_ns", "mtime_ns").alias("mtime_ns"),
        pick("hash", "content_hash").alias("content_hash"),
        F.when(new, synced).otherwise(F.col("b.last_synced_hash")).alias("last_synced_hash"),
        F.when(new, now).otherwise(F.col("b.updated_at")).cast("long").alias("updated_at"),
    )


def record_scan(baseline: DataFrame, scan: DataFrame, now: int | Column) -> DataFrame:
    """The baseline with what a scan saw; last_synced_hash stays as it was (null for new paths)."""
    return _upsert(baseline, scan, F.col("b.last_synced_hash"), F.lit(now))


def confirm_sync(baseline: DataFrame, synced: DataFrame, now: int | Column) -> DataFrame:
    """The baseline with rows (path, size, mtime_ns, hash) that both sides now agree on."""
    return _upsert(baseline, synced, F.col("s.hash"), F.lit(now))


def remove(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a keyed table without those of `paths`; paths it lacks don't matter."""
    return table.join(paths.select("path"), "path", "left_anti")


def reuse_hashes(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """`stats` (path, size, mtime_ns) with known_hash: the baseline's where path, size and mtime_ns all match, else null."""
    known = baseline.select("path", "size", "mtime_ns", F.col("content_hash").alias("known_hash"))
    return stats.join(known, ["path", "size", "mtime_ns"], "left")


def download_entries(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries to download; an action without an entry is an error when its row is read."""
    wanted = plan.filter("kind = 'download'").select("path")
    missing = F.raise_error(F.concat(F.lit("not in the manifest: "), F.col("path"))).cast("string")
    found = wanted.join(manifest, "path", "left")
    return found.withColumn("object_key", F.when(F.col("object_key").isNull(), missing).otherwise(F.col("object_key")))


def remote_deletes(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries to delete; actions without an entry need nothing."""
    return manifest.join(plan.filter("kind = 'delete-remote'").select("path"), "path", "left_semi")


def _together(**tables: DataFrame) -> DataFrame:
    """One row a path with a struct column for each table, null where the table lacks the path; one shuffle for all of them."""
    tagged = None
    for name, table in tables.items():
        part = table.select("path", F.struct(*table.columns).alias(name))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return tagged.groupBy("path").agg(*[F.max(name).alias(name) for name in tables])


def manifest_after(manifest: DataFrame, plan: DataFrame, uploaded: DataFrame) -> DataFrame:
    """The manifest once a plan is applied; `uploaded` has the entries of the paths to upload."""
    columns = manifest.columns
    rows = _together(old=manifest, new=uploaded.select(*columns), todo=plan.select("path", "kind"))
    kind = F.coalesce("todo.kind", F.lit(""))
    entry = F.when((kind == "upload") & F.col("new").isNotNull(), F.col("new")).when(kind != "delete-remote", F.col("old"))
    return rows.select(entry.alias("e")).filter("e is not null").select("e.*")


def baseline_after(
    baseline: DataFrame, plan: DataFrame, local: DataFrame, arrived: DataFrame, bookkeeping: DataFrame, now: int | Column
) -> DataFrame:
    """The baseline once a plan is applied: what was sent and what `arrived` is confirmed, deleted paths are gone.

    `local` and `arrived` have path, size, mtime_ns and hash. Adopted paths are confirmed as they are here, forgotten ones go;
    conflicts stay as they were.
    """
    seen = ["path", "size", "mtime_ns", "hash"]
    rows = _together(
        old=baseline, here=local.select(*seen), there=arrived.select(*seen), todo=plan.select("path", "kind"), mend=bookkeeping.select("path", "step")
    )
    kind, step = F.coalesce("todo.kind", F.lit("")), F.coalesce("mend.step", F.lit(""))
    synced = F.when((kind == "upload") | (step == "adopt"), F.col("here")).when(kind == "download", F.col("there"))
    confirmed = F.struct(
        F.col("path"), F.col("now.size").alias("size"), F.col("now.mtime_ns").alias("mtime_ns"), F.col("now.hash").alias("content_hash"),
        F.col("now.hash").alias("last_synced_hash"), F.lit(now).cast("long").alias("updated_at"),
    )
    return (
        rows.filter(~kind.isin("delete-local", "delete-remote") & (step != "forget"))
        .withColumn("now", synced)
        .select(F.when(F.col("now").isNotNull(), confirmed).otherwise(F.col("old")).alias("e"))
        .filter("e is not null")
        .select("e.*")
    )


def guard_generations(log: DataFrame, device: str, sequence: str, generation: str) -> DataFrame:
    """`log` with highest (before each write, 0 at first) and accepted: a write of a lower generation is a rollback.

    One exchange, into ranges of (device, sequence); a busy device's log lies over as many tasks as it needs (`ordered`). Null generations don't count.
    """
    seen = running_max(log, device, [sequence], generation, "_top", before=True)
    highest = F.greatest(F.col("_top"), F.lit(0)).cast("long")  # nulls don't count
    return seen.withColumn("highest", highest).withColumn("accepted", F.col(generation) >= F.col("highest")).select(*log.columns, "highest", "accepted")
