import dataclasses
import functools
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from arbolith.__main__ import main
from arbolith.functions.keys import derive_keys
from arbolith.operators.reconcile import plan
from arbolith.plans.apply import Mirror, compare, sync
from arbolith.plans.manifest import Rollback, read_manifest
from arbolith.plans.parts import forget_parts, join_parts, part_plan, planned_parts, seal_parts
from arbolith.sources.config import FileSecrets
from arbolith.sources.objects import FolderStore
from arbolith.sources.tables import State


@pytest.fixture
def devices(tmp_path):
    keys = derive_keys("pass", b"salt" * 4, n=1 << 10)
    secrets = FileSecrets(str(tmp_path / "keys"))
    for purpose in ("content", "name", "manifest"):
        secrets.store(purpose, getattr(keys, purpose))
    provide = [functools.partial(secrets.load, p) for p in ("content", "name", "manifest")]
    (tmp_path / "store").mkdir()

    def device(name):
        (tmp_path / name).mkdir(exist_ok=True)
        return Mirror(str(tmp_path / name), str(tmp_path / "store"), str(tmp_path / name / ".mirror" / "state"), "v/", *provide)

    return device


def put(mirror, name, content):
    path = os.path.join(mirror.root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def files(mirror):
    found = {}
    for directory, folders, names in os.walk(mirror.root):
        folders[:] = [f for f in folders if f != ".mirror"]
        for name in names:
            path = os.path.join(directory, name)
            with open(path, "rb") as f:
                found[os.path.relpath(path, mirror.root)] = f.read()
    return found


def run(spark, mirror):
    return sorted((r.kind, r.status, r.path) for r in sync(spark, mirror, 1).collect())


def test_two_devices_converge(spark, devices):
    a, b = devices("a"), devices("b")
    put(a, "a.txt", b"one")
    put(a, "deep/er/b.txt", b"two")
    put(a, "empty", b"")
    assert run(spark, a) == [("upload", "done", p) for p in ("a.txt", "deep/er/b.txt", "empty")]
    assert run(spark, b) == [("download", "done", p) for p in ("a.txt", "deep/er/b.txt", "empty")]
    assert files(a) == files(b) and run(spark, a) == run(spark, b) == []
    put(b, "a.txt", b"edited")
    os.unlink(os.path.join(b.root, "deep/er/b.txt"))
    assert run(spark, b) == [("delete-remote", "done", "deep/er/b.txt"), ("upload", "done", "a.txt")]
    assert run(spark, a) == [("delete-local", "done", "deep/er/b.txt"), ("download", "done", "a.txt")]
    assert files(a) == files(b) == {"a.txt": b"edited", "empty": b""}
    names = [k for k, _ in FolderStore(a.store).list("v/") if "manifest" not in k]
    assert len(names) == 2 and not any("a.txt" in n for n in names)
    # the same edit on both sides is adopted; a later edit on one side is no conflict
    put(a, "a.txt", b"same")
    put(b, "a.txt", b"same")
    run(spark, a)
    assert run(spark, b) == []
    put(b, "a.txt", b"later")
    assert run(spark, b) == [("upload", "done", "a.txt")]
    # conflicts leave both sides alone
    put(a, "a.txt", b"mine")
    assert run(spark, a) == [("conflict", "conflict", "a.txt")]
    assert files(a)["a.txt"] == b"mine"
    # deleted on both sides, then made again with the old content
    os.unlink(os.path.join(a.root, "empty"))
    os.unlink(os.path.join(b.root, "empty"))
    run(spark, a), run(spark, b)
    put(b, "empty", b"")
    assert run(spark, b) == [("upload", "done", "empty")]


def test_sizes_around_frames_and_tampering(spark, devices):
    a, b, c = devices("a"), devices("b"), devices("c")
    for size in (1, 65520, 65521, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 2 << 20):
        put(a, f"f{size}", os.urandom(size))
    run(spark, a)
    run(spark, b)
    assert files(a) == files(b)
    largest = max(FolderStore(a.store).list("v/"), key=lambda x: x[1])[0]
    path = os.path.join(a.store, largest)
    with open(path, "r+b") as f:
        f.seek(1 << 20)
        f.write(b"xxxx")
    with pytest.raises(Exception, match="doesn't open"):
        run(spark, c)
    assert State(spark, c.state).baseline().isEmpty()


def test_rollbacks_are_refused(spark, devices, tmp_path):
    a, b = devices("a"), devices("b")
    put(a, "x", b"1")
    run(spark, a)
    shutil.copytree(a.store, tmp_path / "old")
    put(a, "x", b"2")
    run(spark, a)
    run(spark, b)
    assert State(spark, b.state).generation() >= 2  # a fresh device takes the generation it finds
    shutil.rmtree(a.store)
    shutil.copytree(tmp_path / "old", a.store)
    with pytest.raises(Rollback):
        run(spark, a)
    shutil.rmtree(a.store)
    os.makedirs(a.store)
    with pytest.raises(Rollback):
        run(spark, a)
    assert files(a) == {"x": b"2"}


def test_a_failed_action_commits_nothing(spark, devices):
    a, b = devices("a"), devices("b")
    put(a, "x", b"1")
    put(a, "y", b"2")
    run(spark, a)
    for key, _ in FolderStore(a.store).list("v/"):
        if "manifest" not in key:
            FolderStore(a.store).delete(key)
            break
    put(b, "new", b"3")
    with pytest.raises(Exception):
        run(spark, b)
    assert State(spark, b.state).baseline().isEmpty()
    assert {r.kind for r in plan(compare(spark, b)[-1]).collect()} <= {"download", "upload"}


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("ARBOLITH_PASSPHRASE", "pass")
    (tmp_path / "root").mkdir()
    (tmp_path / "bucket").mkdir()
    config = tmp_path / "c.toml"
    config.write_text(f'[remote]\nbucket = "{tmp_path}/bucket"\nprefix = "v/"\n[local]\nroot = "{tmp_path}/root"\n')
    call = lambda command: main(["--config", str(config), command])
    (tmp_path / "root" / "a.txt").write_text("one")
    assert call("doctor") == 0 and call("unlock") == 1 and call("init") == 0 and call("init") == 1 and call("unlock") == 0
    capsys.readouterr()
    assert call("scan") == 0 and "a.txt" in capsys.readouterr().out
    assert call("status") == 0 and capsys.readouterr().out.split()[:2] == ["upload", "a.txt"]
    assert call("snapshot") == 0 and call("sync") == 0 and call("status") == 0
    assert "up to date" in capsys.readouterr().out


def test_old_versions_and_working_tables_go(spark, devices):
    a = devices("a")
    for i in range(4):
        put(a, "x", b"%d" % i)
        assert run(spark, a) == [("upload", "done", "x")]
    left = sorted(n for n in os.listdir(a.state) if not n.startswith("outcomes-"))
    assert left == ["current.json", "v3", "v4"]
    assert len(os.listdir(a.state)) == 4  # and the outcomes of the last run
    assert sorted(os.listdir(os.path.join(a.store, "v", "manifest"))) == ["3", "4"]
    # a run that fails leaves no opened manifest behind
    b = devices("b")
    for key, _ in FolderStore(a.store).list("v/"):
        if "manifest" not in key:
            FolderStore(a.store).delete(key)
    with pytest.raises(Exception):
        run(spark, b)
    assert not any(n.startswith("work-") for n in os.listdir(b.state))


def test_a_failed_transfer_leaves_no_partial_file(spark, devices):
    a, b = devices("a"), devices("b")
    put(a, "big", os.urandom(3 << 20))
    run(spark, a)
    key = max(FolderStore(a.store).list("v/"), key=lambda x: x[1])[0]
    path = os.path.join(a.store, key)
    with open(path, "r+b") as f:
        f.seek((2 << 20) + 100)
        f.write(b"xxxx")
    with pytest.raises(Exception, match="doesn't open"):
        run(spark, b)
    assert files(b) == {} and not [n for _, _, names in os.walk(os.path.join(b.root, ".mirror", "tmp")) for n in names]


def test_manifest_rows_lie_by_path(spark, devices):
    a = devices("a")
    for i in range(30):
        put(a, f"d{i % 3}/f{(i * 7) % 30:02d}", b"x")
    run(spark, a)
    entries = [r.path for r in read_manifest(spark, FolderStore(a.store), "v/", State(spark, a.state), a.manifest_key).collect()]
    assert len(entries) == 30 and entries == sorted(entries)


def large(n, seed):
    return random.Random(seed).randbytes(n)


def test_large_files_go_in_parts_and_come_back_whole(spark, devices):
    """Sizes around the borders of frames and parts, among small files; the object is the one that a single task would have written."""
    mib = 1 << 20
    sizes = [2 * mib, 2 * mib + 1, 4 * mib, 5 * mib - 1, 6 * mib + 7, 10, 0]
    a, b = (dataclasses.replace(devices(n), part_bytes=2 * mib) for n in "ab")
    for k, n in enumerate(sizes):
        put(a, f"f{k}.bin", large(n, k))
    assert {(k, s) for k, s, _ in run(spark, a)} == {("upload", "done")}
    assert {(k, s) for k, s, _ in run(spark, b)} == {("download", "done")}
    assert files(a) == files(b)
    assert not os.listdir(os.path.join(a.store, "v/parts")) and run(spark, a) == []


def test_only_missing_parts_are_sealed_again(spark, devices):
    mib = 1 << 20
    a = devices("a")
    put(a, "big.bin", large(9 * mib + 5, 1))
    local = compare(spark, a)[0]
    parts = planned_parts(a, local, mib).cache()
    assert parts.count() == 10 and seal_parts(a, parts).select(F.spark_partition_id()).distinct().count() >= 0
    forget_parts(a)
    tasks = seal_parts(a, parts.filter("part % 2 = 0")).select("size", F.spark_partition_id().alias("t")).collect()  # the run is killed after these
    assert sorted(r["size"] for r in tasks) == [0, 2, 4, 6, 8] and len({r.t for r in tasks}) > 1
    assert [r.status for r in join_parts(a, parts).collect()] == ["deferred"]
    again = seal_parts(a, parts).collect()
    assert sorted(r["size"] for r in again) == [1, 3, 5, 7, 9] and {r.status for r in again} == {"done"}
    assert [r.status for r in join_parts(a, parts).collect()] == ["done"]
    # a file that changed since takes over nothing, and one that changes meanwhile isn't stored
    put(a, "big.bin", large(9 * mib + 5, 2))
    assert {r.status for r in seal_parts(a, parts.withColumn("upload", F.lit("other"))).collect()} == {"deferred"}
    changed = planned_parts(a, compare(spark, a)[0], mib)
    assert {r.upload for r in changed.collect()}.isdisjoint({r.upload for r in parts.collect()})
    assert seal_parts(a, changed).count() == 10


def test_part_sizes_grow_beyond_the_most_parts(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 100), ("d", 101), ("e", 10_000), ("f", 123_456)], "path string, size long")
    plan = part_plan(sizes, part_bytes=95, most=10, unit=10).collect()
    for path, size in (("a", 0), ("b", 1), ("c", 100), ("d", 101), ("e", 10_000), ("f", 123_456)):
        mine = sorted((r.part, r.parts, r.step, r["first"], r.bytes) for r in plan if r.path == path)
        parts, step = mine[0][1], mine[0][2]
        assert len(mine) == parts <= 10 and step % 10 == 0 and step >= 100
        assert [m[3] for m in mine] == [k * step for k in range(parts)] and sum(m[4] for m in mine) == size
