"""The log of a mirror's changes as files that are only added, with snapshots, compaction and a sweep of objects.

A device adds the entries of a pass (`operators.merge.ENTRY`, stamps by `operators.stamps`) as one delta, log/{last stamp:020}-{device}, written beside and renamed, so
that two devices never write the same file. Names sort by stamp: a reader takes the newest snapshot and the deltas named after its generation, and opens
no other. A snapshot's generation is the horizon: the least of all devices' last stamps. A device's stamps only rise, and one that is
new reads before it writes, so no entry can still come in below the horizon; snapshot and tail are the fold of the whole log.

Compaction writes the new snapshot, reads it back and compares a digest of its rows that doesn't depend on their order; only then it is put in place and deltas
go that neither the snapshot before nor any reader still needs. Two that compact at once make the same rows; one of them is dropped.

Paths are folders on any file system of Spark's. Listings are names only: the driver sees one a delta, of which compaction leaves few.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.operators.merge import ENTRY, merge_logs, merged_state
from arbolith.sources.shared import saved

ENTRIES = "path string, lamport long, device string, hash string, base_hash string"
STATE = "path string, hash string, lamport long, device string"


@dataclass(frozen=True)
class Delta:
    name: str

    @property
    def last(self) -> int:
        return int(self.name[:20])

    @property
    def device(self) -> str:
        return self.name[21:]


def table_digest(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows, and sums of two hashes of them modulo 2^61: equal for equal rows in any order, whatever their repeats."""
    whole = [F.col(c) for c in sorted(rows.columns)]
    nulls = F.concat_ws(",", *[c.isNull().cast("string") for c in whole])
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(seed), nulls, *whole), F.lit(1 << 61)).cast("decimal(38,0)")) for seed in (1, 2)]
    n, a, b = rows.agg(F.count(F.lit(1)), *sums).first()
    return n, int(a or 0) % (1 << 61), int(b or 0) % (1 << 61)


class DeltaLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _publish(self, written: str, target: str) -> bool:
        """Renames a written folder; false if another has put the target in place before."""
        path, fs = self._fs(target)
        fs.mkdirs(path.getParent())
        if not fs.exists(path) and fs.rename(self._fs(written)[0], path):
            return True
        self._delete(written)
        return False

    def _delete(self, folder: str) -> None:
        path, fs = self._fs(folder)
        fs.delete(path, True)

    def _scratch(self) -> str:
        return f"{self.root}/tmp/{uuid.uuid4().hex}"

    # --- deltas

    def deltas(self, after: int = -1) -> list[Delta]:
        """Those with stamps above `after`, by stamp."""
        return [d for d in map(Delta, self._names("log")) if d.last > after]

    def append(self, entries: DataFrame) -> list[str]:
        """Adds a delta for each device in `entries`; their names. One that is there already stays as it is."""
        last = entries.groupBy("device").agg(F.lpad(F.max("lamport").cast("string"), 20, "0").alias("last"))
        rows = entries.select(*ENTRY).join(F.broadcast(last), "device")  # a row a device
        written = self._scratch()
        rows.withColumn("_name", F.concat_ws("-", "last", "device")).drop("last").write.partitionBy("_name").parquet(written)
        path, fs = self._fs(written)
        found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
        names = sorted(p.getName().removeprefix("_name=") for p in found)
        for name in names:
            self._publish(f"{written}/_name={name}", f"{self.root}/log/{name}")
        self._delete(written)
        return names

    def tail(self, after: int = -1, up_to: int | None = None) -> DataFrame:
        """Entries with stamps above `after`; deltas that end before aren't opened."""
        found = self.deltas(after)
        if not found:
            return self.spark.createDataFrame([], ENTRIES)
        rows = self.spark.read.schema(ENTRIES).parquet(*(f"{self.root}/log/{d.name}" for d in found)).filter(F.col("lamport") > after)
        return rows if up_to is None else rows.filter(F.col("lamport") <= up_to)

    def horizon(self, devices: list[str] | None = None) -> int:
        """The stamp up to which nothing can come in any more: the least of the devices' last ones (-1 if one has none, or there is none)."""
        last: dict[str, int] = {d: -1 for d in devices or []}
        for d in self.deltas():
            last[d.device] = max(last.get(d.device, -1), d.last)
        return max(min(last.values(), default=-1), self.generation())

    # --- snapshots

    def generations(self) -> list[int]:
        return [int(n) for n in self._names("snapshot")]

    def generation(self) -> int:
        return max(self.generations(), default=-1)

    def snapshot(self, generation: int | None = None) -> DataFrame:
        generation = self.generation() if generation is None else generation
        if generation < 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/snapshot/{generation:020}")

    def merged(self, up_to: int | None = None) -> DataFrame:
        """Outcomes of what follows the newest snapshot, on top of it."""
        return merge_logs(self.tail(self.generation(), up_to), self.snapshot())

    def current(self) -> DataFrame:
        """The state of every path: path, hash (null: deleted), lamport, device."""
        return merged_state(self.merged()).drop("conflicts")

    def compact(self, devices: list[str] | None = None, readers: int | None = None) -> int:
        """Folds what can't change any more into a new snapshot and deletes what it replaces; its generation.

        `readers`: the least generation that a reader may have begun with; deltas above it stay, as do those above the snapshot before.
        """
        before, generation = self.generation(), self.horizon(devices)
        if generation > before:
            state = saved(merged_state(self.merged(generation)).drop("conflicts"))
            written = self._scratch()
            state.repartitionByRange("path").sortWithinPartitions("path").write.parquet(written)
            self._verify(state, written)
            self._publish(written, f"{self.root}/snapshot/{generation:020}")
        kept = [-1, *self.generations()]
        self._sweep_log(min(kept[-2], generation if readers is None else readers))
        return generation

    def _verify(self, state: DataFrame, written: str) -> None:
        if table_digest(state) != table_digest(self.spark.read.schema(STATE).parquet(written)):
            self._delete(written)
            raise ValueError("a snapshot doesn't read back as it was written; nothing was deleted")

    def _sweep_log(self, upto: int) -> None:
        kept = [g for g in self.generations() if g >= upto]
        for generation in self.generations():
            if kept and generation < kept[0]:
                self._delete(f"{self.root}/snapshot/{generation:020}")
        for d in self.deltas():
            if d.last <= upto:
                self._delete(f"{self.root}/log/{d.name}")

    # --- deletions

    def trash(self) -> DataFrame:
        """Deleted paths: path, lamport, device."""
        return self.current().filter("hash is null").select("path", "lamport", "device")

    def referenced(self) -> DataFrame:
        """Hashes of all content that a snapshot that is kept, or an entry that may still be folded, names."""
        states = [self.snapshot(g).select("hash") for g in self.generations()]
        # an entry's base is content that a conflict may still bring back as a copy
        tail = self.tail(min(self.generations(), default=-1))
        named = tail.select("hash").unionByName(tail.select(F.col("base_hash").alias("hash")))
        for state in states:
            named = named.unionByName(state)
        return named.filter("hash is not null").distinct()

    def unreferenced(self, objects: DataFrame) -> DataFrame:
        """The `objects` (hash, ...) that nothing names: those that may be deleted. Content that a tombstone still hides is named by the snapshots before."""
        return objects.join(self.referenced(), "hash", "left_anti")


def expired(tombstones: DataFrame, acknowledged: DataFrame, oldest: int) -> DataFrame:
    """Of `tombstones` (path, hash null, lamport, device, deleted_at) those older than `oldest` that every device has seen.

    `acknowledged`: device, lamport: the highest stamp each device says it has read. The horizon is the least of them; without devices nothing expires.
    """
    horizon = acknowledged.agg(F.min("lamport").alias("horizon"))
    return tombstones.join(F.broadcast(horizon), (F.col("lamport") <= F.col("horizon")) & (F.col("deleted_at") < oldest)).drop("horizon")
