"""Polling a store's change log: new deltas as a stream, each once.

An offset is the last stamp read of each device. A device's deltas come in the order of their stamps, but devices that were offline add deltas with
lower stamps than others have used since, so one name for all ("everything after the last key") would pass them by. A batch takes at most `most`
names, least stamp first. The offset is in the stream's checkpoint, so a restart goes on where the last batch ended, and a batch that was begun is read
again as it was. Batches of a query never overlap: what comes meanwhile is in the next one.

The listing runs where the driver is; the store's folder must be visible there, as for all of `sources.objects`.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


class LogReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("most", "1000"))

    def initialOffset(self) -> dict:
        return {}

    def _names(self, start: dict, end: dict | None = None) -> list[tuple[str, str, int]]:
        """(name, device, stamp) after the offset `start` and up to `end`, by stamp, then device."""
        found = []
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            stamp, device = name[:20], name[21:]
            if not stamp.isdigit() or name[20:21] != "-":
                continue  # no delta
            last = int(stamp)
            if last > start.get(device, -1) and (end is None or last <= end.get(device, -1)):
                found.append((name, device, last))
        return sorted(found, key=lambda x: (x[2], x[1]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._names(start)[: self.most]
        return iter(found), start | {device: last for _, device, last in found}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._names(start, end))


class LogSource(DataSource):
    """Options: path (the folder of deltas), most (names a batch)."""

    @classmethod
    def name(cls) -> str:
        return "deltas"

    def schema(self) -> str:
        return "name string, device string, last long"

    def simpleStreamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def poll(spark: SparkSession, folder: str, checkpoint: str, sync: Callable[[DataFrame, int], None], every: str = "60 seconds", most: int = 1000) -> StreamingQuery:
    """Calls sync(new deltas, batch number) whenever there are some, one call at a time. A call that fails ends the query; a restart repeats its batch."""
    spark.dataSource.register(LogSource)
    new = spark.readStream.format("deltas").options(path=folder, most=str(most)).load()

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sync(batch, number)

    return new.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
