import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbolith.operators import ordered
from arbolith.operators.merge import merge_logs, merged_state
from arbolith.operators.ordered import counted, in_ranges, running_max
from arbolith.operators.stamps import lamport_stamps
from arbolith.operators.state import guard_generations
from arbolith.plans.deltalog import DeltaLog, expired, table_digest

ENTRY = "path string, lamport long, device string, hash string, base_hash string"


@pytest.fixture
def many_parts(spark):
    """Small tables in many partitions, so that a key's rows lie in several."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("8", "false")):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, was):
        spark.conf.set(n, v)


def fold(rows):
    """The rules, entry by entry: outcomes by (path, lamport, device) and states by path."""
    state, outcomes, seen = {}, {}, set()
    for path, lamport, device, hash, base in sorted(set(rows), key=lambda r: (r[0], r[1], r[2], r[3] or "", r[4] or "")):
        if (path, lamport, device) in seen:
            continue
        seen.add((path, lamport, device))
        now = state.get(path)
        if now is None or base == now[0]:
            outcome, new = "forward", (hash, lamport, device)
        elif hash == now[0]:
            outcome, new = "converged", now
        elif hash and now[0]:
            outcome, new = "conflict", (hash, lamport, device)
        else:
            outcome, new = "kept", (hash, lamport, device) if hash else now
        outcomes[path, lamport, device] = (outcome, (now[1], now[2], now[0]) if outcome == "conflict" else (None, None, None))
        state[path] = new
    return outcomes, state


def history(rng, n, stamps=40):
    content = [None, "1", "2", "3"]
    return [(rng.choice(["a", "b", "hot", "hot", "hot"]), rng.randrange(stamps), rng.choice("xyz"), rng.choice(content), rng.choice(content)) for _ in range(n)]


def states(df):
    return {r.path: (r.hash, r.lamport, r.device) for r in df.collect()}


def test_merge_doesnt_depend_on_order_or_repeats(many_parts):
    rng = random.Random(1)
    for n in (200,):
        rows = history(rng, n)
        outcomes, state = fold(rows)
        for again in (0, n // 2):
            given = rows + rng.sample(rows, again)
            rng.shuffle(given)
            merged = merge_logs(many_parts.createDataFrame(given, ENTRY).repartition(3))
            got = {(r.path, r.lamport, r.device): (r.outcome, (r.loser_lamport, r.loser_device, r.loser_hash)) for r in merged.collect()}
            assert got == outcomes and states(merged_state(merged)) == state


def test_merge_on_a_snapshot_is_the_whole_merge(many_parts):
    rng = random.Random(2)
    rows = list({(r[0], r[1], r[2]): r for r in history(rng, 300)}.values())
    early, late = [r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]
    snapshot = merged_state(merge_logs(many_parts.createDataFrame(early, ENTRY))).drop("conflicts")
    merged = merge_logs(many_parts.createDataFrame(late, ENTRY), snapshot)
    assert states(merged_state(merged)) == fold(rows)[1]


def test_merge_of_nothing(spark):
    empty = spark.createDataFrame([], ENTRY)
    assert merge_logs(empty).collect() == [] and merged_state(merge_logs(empty)).collect() == []


def test_stamps_equal_a_loop(many_parts):
    rng = random.Random(4)
    for devices in ("AAAAB", "ABC"):
        clock, stamps, rows = {}, {}, []
        for i in range(120):
            device, sees = rng.choice(devices), rng.randrange(i) if i and rng.random() < 0.1 else None
            clock[device] = max(clock.get(device, 0), stamps.get(sees, 0)) + 1
            stamps[i] = clock[device]
            rows.append((device, i * 7, i, sees))
        frame = many_parts.createDataFrame(rows, "device string, sequence long, op long, sees long").repartition(5)
        assert {r.op: r.lamport for r in lamport_stamps(frame).collect()} == stamps


def test_stamps_of_odd_histories(spark):
    schema = "device string, sequence long, op long, sees long"
    assert lamport_stamps(spark.createDataFrame([], schema)).collect() == []
    rows = [("A", 1, 1, 99), ("A", 2, 2, 1), (None, 1, 3, 2)]  # unknown, own and a device without a name
    assert {r.op: r.lamport for r in lamport_stamps(spark.createDataFrame(rows, schema)).collect()} == {1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError, match="circle"):
        lamport_stamps(spark.createDataFrame([("A", 1, 1, 2), ("B", 1, 2, 1)], schema))


def test_folds_over_pieces_equal_plain_ones(many_parts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", None]), i * 10**12, rng.choice([None, rng.randrange(-5, 100)])) for i in range(400)]
    frame = many_parts.createDataFrame(rows, "key string, at long, value long")
    assert in_ranges(frame, ["key"], ["at"]).select("_part").distinct().count() > 4
    top, count, want_max, want_before, want_n = {}, {}, {}, {}, {}
    for key, at, value in rows:
        want_before[at] = top.get(key)
        top[key] = max((x for x in (top.get(key), value) if x is not None), default=None)
        count[key] = count.get(key, 0) + 1
        want_max[at], want_n[at] = top[key], count[key]
    assert {r["at"]: r.m for r in running_max(frame, "key", ["at"], "value", "m").collect()} == want_max
    assert {r["at"]: r.m for r in running_max(frame, "key", ["at"], "value", "m", before=True).collect()} == want_before
    assert {r["at"]: r.n for r in counted(frame, "key", "at").collect()} == want_n
    guarded = guard_generations(frame, "key", "at", "value").collect()
    assert {r["at"]: (r.highest, r.accepted) for r in guarded} == {
        at: (h := max(want_before[at] or 0, 0), None if value is None else value >= h) for _, at, value in rows
    }


def passes(spark, rows, step):
    """Entries as passes: those of each `step` stamps."""
    for start in range(0, max(r[1] for r in rows) + 1, step):
        yield spark.createDataFrame([r for r in rows if start <= r[1] < start + step], ENTRY)


def test_a_reader_opens_a_snapshot_and_the_deltas_after_it(spark, tmp_path):
    rng = random.Random(6)
    rows = list({(r[0], r[1], r[2]): r for r in history(rng, 200)}.values())
    log, whole = DeltaLog(spark, str(tmp_path / "a")), DeltaLog(spark, str(tmp_path / "b"))
    for k, part in enumerate(passes(spark, rows, 10)):
        names = log.append(part)
        assert names == sorted(names) and log.append(part) == names  # again: nothing new
        whole.append(part)
        if k == 2:
            generation = log.compact()
    deltas = whole.deltas()
    assert states(log.current()) == states(whole.current()) == fold(rows)[1]
    opened = {f.split("/")[-2] for f in log.tail(log.generation()).inputFiles()}
    assert opened == {d.name for d in deltas if d.last > generation} and len(opened) < len(deltas)
    # a device that wrote nothing yet holds the horizon back
    assert whole.horizon(["x", "new"]) == -1 and whole.horizon() == min(max(d.last for d in deltas if d.device == x) for x in "xyz")


def test_compaction_verifies_before_it_deletes(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = list({(r[0], r[1], r[2]): r for r in history(rng, 150)}.values())
    log = DeltaLog(spark, str(tmp_path))
    parts = list(passes(spark, rows, 10))
    for part in parts[:3]:
        log.append(part)
    first = log.compact()
    before = [d.name for d in log.deltas()]
    log.append(parts[3])
    verify = DeltaLog._verify

    def damaged(self, state, written):
        verify(self, state.withColumn("hash", F.lit("other")), written)

    monkeypatch.setattr(DeltaLog, "_verify", damaged)
    with pytest.raises(ValueError, match="read back"):
        log.compact()
    monkeypatch.setattr(DeltaLog, "_verify", verify)
    assert log.generations() == [first] and set(before) <= {d.name for d in log.deltas()}
    assert states(log.current()) == fold(rows)[1]
    second = log.compact()
    kept = {d.name for d in log.deltas()}
    digest = table_digest(log.snapshot())
    assert log.compact() == second and {d.name for d in log.deltas()} == kept and table_digest(log.snapshot()) == digest  # again: the same
    assert all(d.last > first for d in log.deltas()) and log.generations() == [first, second]
    assert states(log.current()) == fold(rows)[1]
    log.compact(readers=0)
    assert log.generations() == [first, second]  # a reader that began before either holds them


def test_table_digest_minds_rows_and_repeats_only(spark):
    rows = [("a", 1), ("b", None), (None, 2), ("a", 1)]
    of = lambda rows: table_digest(spark.createDataFrame(rows, "x string, y long"))
    assert len({of(list(p)) for p in itertools.permutations(rows)}) == 1
    assert len({of(rows), of(rows[1:]), of([("a", 1), ("b", None), (None, 2), ("a", 2)]), of([])}) == 4


def test_nothing_that_is_reachable_is_swept(spark, tmp_path):
    """Random histories with compactions in between: what the state, kept snapshots or kept deltas name is never swept."""
    for seed in (1,):
        rng = random.Random(seed)
        rows = list({(r[0], r[1], r[2]): r for r in [(p, s, d, h and p + h, b and p + b) for p, s, d, h, b in history(rng, 120, 30)]}.values())
        log = DeltaLog(spark, str(tmp_path / str(seed)))
        stored = {r[3] for r in rows if r[3]}
        for part in passes(spark, rows, 8):
            log.append(part)
            if rng.random() < 0.6:
                log.compact()
            objects = spark.createDataFrame([(h,) for h in stored], "hash string")
            swept = {r.hash for r in log.unreferenced(objects).collect()}
            assert not swept & {h for h, _, _ in states(log.current()).values() if h}
            for g in log.generations():
                assert not swept & {r.hash for r in log.snapshot(g).collect()}
        assert states(log.current()) == fold(rows)[1]
        assert {r.path for r in log.trash().collect()} == {p for p, s in fold(rows)[1].items() if s[0] is None}


def test_tombstones_expire_when_all_devices_have_seen_them(spark):
    gone = spark.createDataFrame([("a", 5, "x", 100), ("b", 9, "x", 100), ("c", 5, "x", 900)], "path string, lamport long, device string, deleted_at long")
    seen = lambda *stamps: spark.createDataFrame([(f"d{i}", s) for i, s in enumerate(stamps)], "device string, lamport long")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(expired(gone, seen(7, 20), 500)) == ["a"]
    assert paths(expired(gone, seen(9, 20), 1000)) == ["a", "b", "c"]
    assert paths(expired(gone, seen(4, 20), 1000)) == [] and paths(expired(gone, seen(), 1000)) == []


def test_pieces_are_bounded_however_long_a_run_is():
    """A path with all entries of a partition comes in pieces of a few MB, not as one."""
    rows = [("a",)] * 10 + [("hot",)] * 40_000 + [(None,)] * 10
    batches = pa.table({"path": [r[0] for r in rows], "hash": ["x" * 64] * len(rows), "_part": pa.array([3] * len(rows), pa.int32())}).to_batches(max_chunksize=1000)
    pieces = list(ordered.runs(iter(batches), ["path"], 200_000))
    assert max(p.rows.nbytes for p in pieces) < 300_000 and sum(p.rows.num_rows for p in pieces) == len(rows)
    assert [p.goes_on for p in pieces] == [False] + [True] * (len(pieces) - 1) and len(pieces) > 10
    assert sum(len(p.starts) for p in pieces) - sum(p.goes_on for p in pieces) == 3
    assert list(ordered.runs(iter([]), ["path"], 1)) == []


@pytest.mark.parametrize("batch", [1, 3])
def test_folds_cut_anywhere_equal_whole_ones(many_parts, monkeypatch, batch):
    """Pieces of a batch, batches of a row or three: runs, and repeats of one stamp, are cut wherever they can be."""
    monkeypatch.setattr(ordered, "PIECE", 1, raising=False)
    was = many_parts.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    many_parts.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = random.Random(21)
        rows = history(rng, 250, 25)
        given = rows + rng.sample(rows, 100)
        merged = merge_logs(many_parts.createDataFrame(given, ENTRY).repartition(3))
        outcomes, state = fold(rows)
        assert {(r.path, r.lamport, r.device): (r.outcome, (r.loser_lamport, r.loser_device, r.loser_hash)) for r in merged.collect()} == outcomes
        assert states(merged_state(merged)) == state
        whole = list({(r[0], r[1], r[2]): r for r in rows}.values())
        early, late = ([r for r in whole if (r[1] < 12) == x] for x in (True, False))
        snapshot = merged_state(merge_logs(many_parts.createDataFrame(early, ENTRY))).drop("conflicts")
        assert states(merged_state(merge_logs(many_parts.createDataFrame(late, ENTRY), snapshot))) == fold(whole)[1]
        test_folds_over_pieces_equal_plain_ones(many_parts)
    finally:
        many_parts.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
