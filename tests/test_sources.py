import os

import pytest
from pyspark.sql import functions as F

from arbolith.operators.names import empty_folders
from arbolith.schemas import BASELINE
from arbolith.sources.config import Config, FileSecrets, VaultHeader
from arbolith.sources.ignore import ignored, parse
from arbolith.sources.objects import FolderStore, MemoryStore, object_listing
from arbolith.sources.tree import listed_tree, scan_tree, stable_digest


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def names(df):
    return sorted(r.path for r in df.collect())


def test_scan_prunes_and_keeps_hidden_and_empty_files(spark, tmp_path):
    tree(tmp_path, {
        "a.txt": "a", "docs/notes.md": "n", "build/output.o": "o", ".mirror/state.db": "s", ".DS_Store": "d", ".mirrorignore": "build/\n",
        "empty": "", "_u.txt": "u", "x/.hid/f": "h", "x/desktop.ini": "i",
    })
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    for parts in ("1", "3", "64"):
        got = scan_tree(spark, str(tmp_path), partitions=parts)
        assert names(got) == [".mirrorignore", "_u.txt", "a.txt", "docs/notes.md", "empty", "x/.hid/f"]
    one = {r.path: r for r in got.collect()}["a.txt"]
    found = os.stat(tmp_path / "a.txt")
    assert (one.size, one.mtime_ns, one.hash) == (1, found.st_mtime_ns, stable_digest(str(tmp_path / "a.txt"))[2])


def test_nested_ignore_files_and_decomposed_names(spark, tmp_path):
    tree(tmp_path, {
        ".mirrorignore": "*.log\n!keep.log\n/top\n", "a.log": "", "keep.log": "", "top": "", "d/top": "", "d/a.log": "", "d/.mirrorignore": "!a.log\n",
        "e/.ignore": "secret*\n", "e/secret.txt": "", "café": "x",
    })
    rows = scan_tree(spark, str(tmp_path))
    assert names(rows) == sorted([".mirrorignore", "keep.log", "d/top", "d/a.log", "d/.mirrorignore", "e/.ignore", "café"])
    assert {r.path: r.raw_path for r in rows.collect()}["café"] == "café"


def test_only_changed_files_are_hashed(spark, tmp_path):
    tree(tmp_path, {"a": "one", "b": "two"})
    found = os.stat(tmp_path / "a")
    fake = "f" * 64
    known = spark.createDataFrame([("a", found.st_size, found.st_mtime_ns, fake, None, 0), ("b", 99, 1, fake, None, 0)], BASELINE)
    got = {r.path: r.hash for r in scan_tree(spark, str(tmp_path), known).collect()}
    assert got["a"] == fake and got["b"] == stable_digest(str(tmp_path / "b"))[2]


def test_bad_times_fail_the_scan(spark, tmp_path):
    tree(tmp_path, {"a": "one"})
    os.utime(tmp_path / "a", (-5, -5))
    with pytest.raises(Exception, match="before 1970"):
        scan_tree(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    "rules, path, folder, want",
    [
        ("build/", "build", True, True), ("build/", "build", False, False), ("build/", "x/build", True, True), ("/build", "x/build", True, False),
        ("*.o", "x/y.o", False, True), ("a/*.o", "a/b.o", False, True), ("a/*.o", "a/b/c.o", False, False), ("a/**/c", "a/c", False, True),
        ("a/**/c", "a/x/y/c", False, True), ("**/c", "x/c", False, True), ("a/**", "a/x/y", False, True), ("a/**", "a", True, False),
        ("*.o\n!x.o", "x.o", False, False), ("!x.o\n*.o", "x.o", False, True), ("# c\n\\#f", "#f", False, True), ("f[0-9].t", "f3.t", False, True),
        ("f[!0-9].t", "f3.t", False, False), ("a?c", "a/c", False, False), ("a?c", "abc", False, True), ("x  ", "x", False, True),
    ],
)
def test_ignore_rules(rules, path, folder, want):
    assert ignored([("", parse(rules))], path, folder) is want


def test_deepest_rules_decide():
    chain = [("", parse("*.log")), ("a/b", parse("!keep.log"))]
    assert ignored(chain, "a/b/keep.log", False) is False and ignored(chain, "a/keep.log", False) is True


@pytest.mark.parametrize("kind", ["folder", "memory"])
def test_stores(tmp_path, kind):
    store = FolderStore(str(tmp_path)) if kind == "folder" else MemoryStore()
    store.check()
    assert store.head("p/a") is None
    store.put("p/a", iter([b"Hel", b"lo"]))
    store.put("q/b", iter([]))
    assert store.get("p/a") == b"Hello" and store.head("p/a") == 5 and store.head("q/b") == 0
    assert list(store.list("p/")) == [("p/a", 5)]
    store.delete("p/a")
    store.delete("p/a")
    assert store.head("p/a") is None and [k for k, _ in store.list("")] == ["q/b"]


def test_listing_and_missing_store(spark, tmp_path):
    store = FolderStore(str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.check()
    for key in ("p/a", "p/x/b", "q/c"):
        store.put(key, iter([b"12"]))
    assert sorted(map(tuple, object_listing(spark, store.root, "p/").collect())) == [("p/a", 2), ("p/x/b", 2)]
    for key in ("p/.hidden", "p/empty", "p/.DS_Store", "p/.mirrorignore"):
        store.put(key, iter([b"*\n"] if key.endswith("ignore") else []))
    (tmp_path / "s" / "p" / "c.123.part").write_bytes(b"unfinished")
    for prefix in ("", "p/", "/p/x", "none"):
        assert sorted(map(tuple, object_listing(spark, store.root, prefix).collect())) == sorted(store.list(prefix))
    with pytest.raises(ValueError):
        store.put("../x", iter([]))


def test_config(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text(f'[remote]\nbucket = "b"\nprefix = "v/"\n[local]\nroot = "{tmp_path}"\n')
    config = Config.load(str(file))
    assert (config.remote.bucket, config.remote.prefix, config.local.ignore_file) == ("b", "v/", ".mirrorignore")
    file.write_text('[remote]\nregon = "x"\n[local]\nroot = "/nowhere"\n')
    with pytest.raises(ValueError, match="unknown setting remote.regon; remote.bucket is missing; local.root is no folder"):
        Config.load(str(file))


def test_vault_and_secrets(tmp_path):
    header, keys = VaultHeader.create("pass", n=1 << 10)
    again = VaultHeader.parse(header.dump())
    assert again == header and again.unlock("pass") == keys
    with pytest.raises(PermissionError):
        again.unlock("other")
    secrets = FileSecrets(str(tmp_path / "k"))
    secrets.store("b/v:name", keys.name)
    assert secrets.load("b/v:name") == keys.name
    with pytest.raises(PermissionError):
        secrets.load("none")
    secrets.store("short", b"x")
    with pytest.raises(ValueError, match="1 bytes"):
        secrets.load("short")


def test_files_of_one_folder_are_hashed_by_several_tasks(spark, tmp_path):
    tree(tmp_path, {f"flat/{i}.txt": f"content {i % 50}" for i in range(200)})
    found = scan_tree(spark, str(tmp_path))
    tasks = {r.t: r.n for r in found.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(tasks.values()) == 200 and len(tasks) > 1 and max(tasks.values()) < 120
    assert found.select("hash").distinct().count() == 50


def test_links_and_folders_are_listed_after_the_ignore_rules(spark, tmp_path):
    tree(tmp_path, {"a/f": "x", "b/c/f": "y", ".mirrorignore": "skip/\nempty/ignored.txt\n", "skip/f": "z", "empty/ignored.txt": "i"})
    for folder in ("void/deep/er", "b/none", ".mirror/state"):
        (tmp_path / folder).mkdir(parents=True)
    os.symlink(tmp_path / "a", tmp_path / "to_folder")
    os.symlink("nowhere", tmp_path / "b" / "dangling")
    os.symlink("x", tmp_path / "skip" / "ignored")
    for parts in ("1", "3", "64"):
        assert names(listed_tree(spark, str(tmp_path), "links", partitions=parts)) == ["b/dangling", "to_folder"]
        folders = listed_tree(spark, str(tmp_path), "folders", partitions=parts)
        assert names(folders) == ["a", "b", "b/c", "b/none", "empty", "void", "void/deep", "void/deep/er"]
    assert names(empty_folders(listed_tree(spark, str(tmp_path), "files"), folders)) == ["b/none", "empty", "void"]
    assert names(scan_tree(spark, str(tmp_path))) == [".mirrorignore", "a/f", "b/c/f"]
