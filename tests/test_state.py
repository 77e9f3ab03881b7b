import json

import pytest
from pyspark.sql import functions as F

from arbolith.operators import state as ops
from arbolith.schemas import BASELINE, LOCAL, MANIFEST, PLAN
from arbolith.sources.tables import LAYOUT, State, migrated

H = {n: f"{n:02x}" * 32 for n in range(10)}


def base(spark, *rows):
    return spark.createDataFrame(rows, BASELINE)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_record_scan_keeps_what_was_synced(spark):
    before = base(spark, ("a", 1, 1, H[1], H[1], 5), ("b", 1, 1, H[1], None, 5), ("old", 1, 1, H[1], H[2], 5))
    seen = spark.createDataFrame([("a", 2, 2, H[3]), ("b", 1, 1, H[1]), ("new", 3, 42, H[4])], LOCAL)
    assert rows(ops.record_scan(before, seen, 9)) == [
        ("a", 2, 2, H[3], H[1], 9), ("b", 1, 1, H[1], None, 9), ("new", 3, 42, H[4], None, 9), ("old", 1, 1, H[1], H[2], 5)
    ]
    assert rows(ops.confirm_sync(before, seen, 9))[:3] == [
        ("a", 2, 2, H[3], H[3], 9), ("b", 1, 1, H[1], H[1], 9), ("new", 3, 42, H[4], H[4], 9)
    ]
    assert rows(ops.remove(before, seen)) == [("old", 1, 1, H[1], H[2], 5)]


def test_a_cached_hash_needs_path_size_and_time(spark):
    known = base(spark, ("a.txt", 3, 42, H[1], None, 0))
    stats = spark.createDataFrame([("a.txt", 3, 42), ("a.txt", 4, 42), ("a.txt", 3, 43), ("b.txt", 3, 42)], "path string, size long, mtime_ns long")
    got = {(r.path, r.size, r.mtime_ns): r.known_hash for r in ops.reuse_hashes(stats, known).collect()}
    assert got == {("a.txt", 3, 42): H[1], ("a.txt", 4, 42): None, ("a.txt", 3, 43): None, ("b.txt", 3, 42): None}


def test_downloads_need_an_entry_and_deletes_do_not(spark):
    plan = spark.createDataFrame([(0, "download", "a"), (3, "delete-remote", "b"), (3, "delete-remote", "none")], PLAN)
    manifest = spark.createDataFrame([("a", 1, H[1], "ka"), ("b", 1, H[1], "kb"), ("c", 1, H[1], "kc")], MANIFEST)
    assert [r.object_key for r in ops.download_entries(plan, manifest).collect()] == ["ka"]
    assert [r.object_key for r in ops.remote_deletes(plan, manifest).collect()] == ["kb"]
    with pytest.raises(Exception, match="not in the manifest: a"):
        ops.download_entries(plan, manifest.filter("path <> 'a'")).collect()


def test_after_a_plan(spark):
    plan = spark.createDataFrame([(0, "download", "d"), (1, "upload", "u"), (2, "delete-local", "l"), (3, "delete-remote", "r"), (4, "conflict", "c")], PLAN)
    manifest = spark.createDataFrame([("d", 1, H[1], "k"), ("u", 1, H[1], "old"), ("r", 1, H[1], "k"), ("c", 1, H[1], "k")], MANIFEST)
    sent = spark.createDataFrame([("u", 2, H[2], "new"), ("c", 9, H[9], "no")], MANIFEST)
    assert [(r.path, r.object_key) for r in sorted(ops.manifest_after(manifest, plan, sent).collect())] == [("c", "k"), ("d", "k"), ("u", "new")]
    before = base(spark, *[(p, 1, 1, H[1], H[1], 5) for p in ("l", "r", "c", "f", "ad", "idle")])
    local = spark.createDataFrame([("u", 2, 2, H[2]), ("ad", 3, 3, H[3]), ("c", 9, 9, H[9])], LOCAL)
    arrived = spark.createDataFrame([("d", 4, 4, H[4]), ("c", 8, 8, H[8])], LOCAL)
    mend = spark.createDataFrame([("f", "forget", None), ("ad", "adopt", H[3])], "path string, step string, hash string")
    assert rows(ops.baseline_after(before, plan, local, arrived, mend, 7)) == [
        ("ad", 3, 3, H[3], H[3], 7), ("c", 1, 1, H[1], H[1], 5), ("d", 4, 4, H[4], H[4], 7), ("idle", 1, 1, H[1], H[1], 5),
        ("u", 2, 2, H[2], H[2], 7),
    ]


def test_guard(spark):
    log = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "x", 1), (4, "x", 2), (5, "x", 5), (6, "y", -1)], "seq int, dev string, gen long")
    for log in (log, log.withColumn("seq", F.col("seq") * F.lit(10**15))):  # numbers as sparse as time stamps
        got = {r.seq // (10**15 if r.seq > 6 else 1): (r.highest, r.accepted) for r in ops.guard_generations(log, "dev", "seq", "gen").collect()}
        assert got == {1: (0, True), 2: (1, True), 3: (2, False), 4: (2, True), 5: (2, True), 6: (0, False)}


def test_versions(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"))
    assert state.generation() == 0 and state.baseline().collect() == []
    state.commit(base(spark, ("a", -5, 1, H[1], None, 1)), 5)
    assert state.generation() == 5 and rows(state.baseline()) == [("a", 0, 1, H[1], None, 1)]
    state.commit(ops.remove(state.baseline(), state.baseline()))
    assert state.generation() == 5 and state.baseline().collect() == []
    state.commit(generation=6)
    assert State(spark, str(tmp_path / "s")).generation() == 6
    state.commit(base(spark, ("a", 1, 1, "not hex", None, 1)))
    with pytest.raises(Exception, match="not a digest"):
        state.baseline().collect()


def test_every_old_layout_is_brought_up_to_date(spark, tmp_path):
    def mark(name):
        return lambda df: df.withColumn(name, F.lit(len(df.columns)))

    steps = (mark("a"), mark("b"), mark("c"))
    for layout in range(4):
        rows = spark.createDataFrame([("p", *range(layout))], ", ".join(["path string", *(f"{n} int" for n in "abc"[:layout])]))
        assert migrated(rows, layout, steps).columns == ["path", "a", "b", "c"]
    for layout in (-1, 4):
        with pytest.raises(ValueError, match="layout"):
            migrated(rows, layout, steps)
    state = State(spark, str(tmp_path / "s"))
    state.commit(base(spark, ("a", 1, 1, H[1], None, 5)))
    known = json.loads((tmp_path / "s" / "current.json").read_text())
    spark.createDataFrame([("a", 1, 1, H[1], None)], "path string, size long, mtime_ns long, content_hash string, last_synced_hash string").write.mode("overwrite").parquet(str(tmp_path / "s" / "v1"))
    (tmp_path / "s" / "current.json").write_text(json.dumps(known | {"layout": 0}))
    assert known["layout"] == LAYOUT and [tuple(r) for r in state.baseline().collect()] == [("a", 1, 1, H[1], None, 0)]
    (tmp_path / "s" / "current.json").write_text(json.dumps(known | {"layout": LAYOUT + 1}))
    with pytest.raises(ValueError, match="layout"):
        state.baseline()
