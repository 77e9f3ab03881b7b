"""Debouncing hints that files may have changed, as a stream or over a table.

A hint (path, ts, kind) says that something happened to a path; editors send several for one save. Hints of a path that follow each other within `quiet`
are one request to look at it. Its intent is that of the last hint: a removal is only a candidate for deletion, all else asks for a rescan of
the path. A hint without a path (the watcher's queue overflowed) asks for a full rescan. Hints only mark paths: a scan decides what is true, so one
that is lost is harmless as long as a full rescan follows. Rows later than the watermark are dropped by Spark; `dropped` says how many, and any
of them is a reason for a full rescan too.

The same function serves streams and tables. State is one open session a path, which the watermark bounds; sessions are merged in each task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(hints: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """path (null: all), first, last, hints, intent (rescan, confirm-delete, full-rescan) of each burst of `hints` (path, ts, kind).

    Hints at one instant count in the order of their kinds. A hint without a time is no hint.
    """
    timed = hints.filter("ts is not null").withWatermark("ts", late)
    last = F.max_by("kind", F.struct("ts", "kind"))
    return (
        timed.groupBy(F.session_window("ts", quiet).alias("w"), "path")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("hints"), last.alias("kind"))
        .select(
            "path", "first", "last", "hints",
            F.when(F.col("path").isNull(), "full-rescan").when(F.col("kind") == "remove", "confirm-delete").otherwise("rescan").alias("intent"),
        )
    )


def write_requests(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of `debounced` requests into a folder of Parquet files, each request once whatever restarts there are; it ends when its input is read."""
    return (
        requests.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def dropped(query: StreamingQuery) -> int:
    """How many hints came too late in the batches that the query still remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
