"""Sharding by longest-processing-time scheduling in two levels.

Rows with equal texts form a group that stays together. Groups are dealt to buckets of about `bucket_groups` by
the hash of their text, one bucket if there are no more; in each bucket a task streams the groups, largest first, and gives
each to the least loaded of its bins through a heap. There are at least 256 bins a shard over all buckets. The bins are then
scheduled the same way onto the shards, by a heap on the driver.

With one bucket and no more groups than bins every bin holds one group, and the result is plain
longest-processing-time over the groups. With more, a bin with several groups holds at most twice its bucket's mean bin, since the second
group to enter a bin was no larger than the load of the least loaded one. So the largest shard holds at most the mean shard and one
such bin or one group: with even buckets, 1/128 above the mean, or what a large group forces.

Scale: tasks hold a heap of bins, never a group; the driver holds the bins, at most `most_buckets` * `shards` or 256 * `shards` of them
(more groups make larger buckets, not more bins). A group with a third of
all rows is cut into `salts` cells, so that its rows are numbered by many tasks; only the cells,
at most `salts` a group, meet. Slots come from counts of cells and bins, not from a sort of
a shard. Sizes and hashes are taken once and saved, unless rows are carried along.

Null texts count as empty: size 1, in one group with the empty texts. Null or equal ids are spread over the cells like others; null ids
are numbered first within a cell. Equal rows get slots in either order; where rows are carried, those equal in all columns share a cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolith.llm.common import row_hash, saved, text_or_empty, wide_hash

PLACED = "g1 long, g2 long, salt int, bucket int, bin int, first long, cell_rows long, cell_bytes long"


def _fill_bins(bins_in_bucket: int):
    """Streams cells sorted by (bucket, group size downwards, group) and places each group in a bin."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, group, slot_in_bin, heap, counts = None, None, 0, [], []
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            bins, firsts = [], []
            for b, g1, g2, ahead, size, rows in zip(
                columns["bucket"], columns["g1"], columns["g2"], columns["ahead"], columns["group_bytes"],
                columns["group_rows"],
            ):
                if b != bucket:
                    bucket, group = b, None
                    heap, counts = [(0, i) for i in range(bins_in_bucket)], [0] * bins_in_bucket
                if (g1, g2) != group:
                    group = (g1, g2)
                    load, at = heap[0]
                    heapq.heapreplace(heap, (load + size, at))
                    slot_in_bin, current = counts[at], at
                    counts[at] += rows
                bins.append(current)
                firsts.append(slot_in_bin + ahead)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("g1", "g2", "salt", "bucket")), pa.array(bins, pa.int32()),
                 pa.array(firsts, pa.int64()), batch.column("cell_rows"), batch.column("cell_bytes")],
                names=["g1", "g2", "salt", "bucket", "bin", "first", "cell_rows", "cell_bytes"],
            )

    return place


def schedule_bins(bins: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(bucket, bin, bytes, rows) to (bucket, bin, shard, first slot), largest bin to the least loaded shard."""
    heap, counts, out = [(0, i) for i in range(shards)], [0] * shards, []
    for bucket, bin_, size, rows in sorted(bins, key=lambda x: (-x[2], x[0], x[1])):
        load, at = heap[0]
        heapq.heapreplace(heap, (load + size, at))
        out.append((bucket, bin_, at, counts[at]))
        counts[at] += rows
    return out


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    buckets: int | None = None,
    salts: int = 1024,
    carry: bool = False,
    bucket_groups: int = 1 << 16,
    most_buckets: int = 4096,
) -> DataFrame:
    """One row per input row: `id_col`, size, text_crc32 (long), shard (int), slot (long, gapless from 0 in each shard).

    With `carry`, all columns of `docs` come first; one that is named as one of these gets the prefix given_. `buckets` sets
    their number in place of the count of groups.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    given = [f"given_{c}" if c in ("size", "text_crc32", "shard", "slot") else c for c in docs.columns]
    carried = [F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, given)]).alias("_row")] if carry else []
    # rows equal in id and text differ by their place, which is fixed once they are saved
    spread = row_hash(docs) if carry else F.xxhash64(F.col(id_col), F.monotonically_increasing_id())
    rows = docs.select(
        *carried,
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *wide_hash(text, "g"),
        F.pmod(spread, F.lit(salts)).cast("int").alias("salt"),
    )
    if not carry:
        rows = saved(rows)
    counted = saved(rows.groupBy("g1", "g2", "salt").agg(F.count(F.lit(1)).alias("cell_rows"), F.sum("size").alias("cell_bytes")))
    if buckets is None:
        groups = counted.select("g1", "g2").distinct().count()  # not cells, of which a large group has many
        buckets = min(most_buckets, 1 + groups // bucket_groups)
    bins_in_bucket = max(shards, math.ceil(256 * shards / buckets))
    group = Window.partitionBy("bucket", "g1", "g2")
    cells = (
        counted.withColumn("bucket", F.pmod("g1", F.lit(buckets)).cast("int"))
        .repartition("bucket")
        .withColumn("group_rows", F.sum("cell_rows").over(group))
        .withColumn("group_bytes", F.sum("cell_bytes").over(group))
        .withColumn(
            "ahead",
            F.coalesce(F.sum("cell_rows").over(group.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .sortWithinPartitions("bucket", F.col("group_bytes").desc(), "g1", "g2", "salt")
    )
    placed = saved(cells.mapInArrow(_fill_bins(bins_in_bucket), PLACED))
    bins = placed.groupBy("bucket", "bin").agg(F.sum("cell_bytes").alias("b"), F.sum("cell_rows").alias("n"))
    schedule = schedule_bins([tuple(r) for r in bins.collect()], shards)  # at most buckets * bins_in_bucket rows
    shard_of = spark.createDataFrame(schedule, "bucket int, bin int, shard int, base long")
    cell_slots = placed.join(F.broadcast(shard_of), ["bucket", "bin"]).select(
        "g1", "g2", "salt", "shard", (F.col("base") + F.col("first")).alias("first")
    )
    numbered = rows.withColumn(
        "nth", F.row_number().over(Window.partitionBy("g1", "g2", "salt").orderBy(F.col("_id").asc_nulls_first())) - 1
    )
    return numbered.join(cell_slots, ["g1", "g2", "salt"]).select(
        F.col("_row.*") if carry else F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot")
    )
