import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arbolith.streaming.hints import debounced, dropped, write_requests
from arbolith.streaming.poll import LogReader, poll

START = datetime(2024, 1, 1)
HINT = "path string, ts timestamp, kind string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def tuples(df):
    return sorted((r.path or "", r.first, r.last, r.hints, r.intent) for r in df.collect())


def test_bursts_are_one_request(spark):
    rows = [
        ("a", at(0), "write"), ("a", at(1), "rename"), ("a", at(3), "chmod"),  # gaps of 2 s at most: one burst
        ("a", at(6), "write"), ("a", at(7), "remove"), ("b", at(1), "write"), ("b", at(1), "write"), (None, at(2), "overflow"), (None, at(3), "overflow"),
        ("c", None, "write"), (None, at(50), None),
    ]
    assert tuples(debounced(spark.createDataFrame(rows, HINT))) == [
        ("", at(2), at(3), 2, "full-rescan"), ("", at(50), at(50), 1, "full-rescan"), ("a", at(0), at(3), 3, "rescan"),
        ("a", at(6), at(7), 2, "confirm-delete"), ("b", at(1), at(1), 2, "rescan"),
    ]
    assert debounced(spark.createDataFrame([], HINT)).collect() == []


def test_stream_equals_the_table_over_restarts(spark, small, tmp_path):
    """Events as files that come one after the other, a query that is started anew for each, against all of them at once."""
    events = spark.read.parquet(f"{small}/events.parquet").select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("path"), "ts", F.col("event_type").alias("kind"), "event_id"
    )
    rows = events.orderBy("ts").collect()
    size = len(rows) // 4 + 1
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    end = rows[-1].ts + timedelta(days=2)
    for k in range(5):
        part = rows[k * size : (k + 1) * size] if k < 4 else [("end", end, "write", 0)]
        spark.createDataFrame([tuple(r) for r in part], events.schema).drop("event_id").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(HINT).parquet(source)
        query = write_requests(debounced(stream, "10 minutes", "1 hour"), out, state)
        assert query.awaitTermination(120) and query.exception() is None
        assert dropped(query) == 0
    table = debounced(events.drop("event_id"), "10 minutes", "1 hour")
    assert tuples(spark.read.parquet(out)) == tuples(table) and table.count() > 5


def test_rows_that_come_too_late_are_counted(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    total = 0
    for rows in ([("a", at(0), "write")], [("a", at(1000), "write")], [("b", at(1), "write"), ("c", at(995), "write")]):
        spark.createDataFrame(rows, HINT).coalesce(1).write.mode("append").parquet(source)
        query = write_requests(debounced(spark.readStream.schema(HINT).parquet(source)), out, state)
        assert query.awaitTermination(120)
        total += dropped(query)
    assert total == 1
    assert tuples(spark.read.parquet(out)) == [("a", at(0), at(0), 1, "rescan")]


def add(folder, *names):
    os.makedirs(folder, exist_ok=True)
    for stamp, device in names:
        open(os.path.join(folder, f"{stamp:020}-{device}"), "w").close()


def test_offsets_hold_devices_apart(tmp_path):
    folder = str(tmp_path / "log")
    reader = LogReader({"path": folder, "most": "2"})
    assert list(reader.read({})[0]) == []
    add(folder, (5, "x"), (7, "y"), (9, "x"))
    (tmp_path / "log" / "notes.txt").write_text("no delta")
    rows, first = reader.read({})
    assert [r[2] for r in rows] == [5, 7] and first == {"x": 5, "y": 7}
    add(folder, (6, "slow"))  # a device that was offline, with a lower stamp than others have read
    rows, second = reader.read(first)
    assert [(r[1], r[2]) for r in rows] == [("slow", 6), ("x", 9)]
    assert [r[2] for r in reader.readBetweenOffsets({}, first)] == [5, 7]
    assert [r[2] for r in reader.readBetweenOffsets(first, second)] == [6, 9]


def test_every_delta_once_over_restarts_and_one_call_at_a_time(spark, tmp_path):
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    got, running, most = [], [0], [0]
    lock = threading.Lock()
    fail = [True]

    def sync(batch, number):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        names = [r.name for r in batch.collect()]
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        if fail[0] and any("boom" in n for n in names):
            fail[0] = False
            raise RuntimeError("lost while syncing")
        got.extend(names)

    def until(n, query):
        end = time.time() + 60
        while len(got) < n and query.isActive and time.time() < end:
            time.sleep(0.1)

    add(folder, (1, "x"), (2, "y"))
    query = poll(spark, folder, state, sync, "100 milliseconds", most=2)
    until(2, query)
    for k in range(3, 7):
        add(folder, (k, "x"), (k, "y"))
    until(10, query)
    query.stop()
    add(folder, (20, "boom"), (3, "late"))
    query = poll(spark, folder, state, sync, "100 milliseconds")
    with pytest.raises(Exception, match="lost while syncing"):
        query.awaitTermination(60)
    query = poll(spark, folder, state, sync, "100 milliseconds")
    until(12, query)
    query.stop()
    assert sorted(got) == sorted(os.listdir(folder)) and len(got) == 12 and most[0] == 1
