"""Command line: init, unlock, doctor, scan, status, snapshot, sync."""

from __future__ import annotations

import argparse
import getpass
import os
import sys
import time

from arbolith.sources.config import Config, FileSecrets, VaultHeader
from arbolith.sources.objects import FolderStore


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("arbolith").config("spark.speculation", "false").getOrCreate()


def _passphrase() -> str:
    return os.environ.get("ARBOLITH_PASSPHRASE") or getpass.getpass("Passphrase: ")


def _secrets(config: Config) -> FileSecrets:
    return FileSecrets(os.path.join(os.path.expanduser(config.local.root), ".mirror", "keys"))


def _name(config: Config, purpose: str) -> str:
    return f"{config.remote.bucket}/{config.remote.prefix}:{purpose}"


def _mirror(config: Config):
    from functools import partial

    from arbolith.plans.apply import Mirror

    root, secrets = os.path.expanduser(config.local.root), _secrets(config)
    provide = lambda purpose: partial(secrets.load, _name(config, purpose))
    for purpose in ("content", "name", "manifest"):
        secrets.load(_name(config, purpose))
    return Mirror(
        root, config.remote.bucket, os.path.join(root, ".mirror", "state"), config.remote.prefix,
        provide("content"), provide("name"), provide("manifest"), config.local.ignore_file,
    )


def _keep(config: Config, keys) -> None:
    for purpose in ("content", "name", "manifest"):
        _secrets(config).store(_name(config, purpose), getattr(keys, purpose))


def init(config: Config) -> int:
    store, key = FolderStore(config.remote.bucket), f"{config.remote.prefix}vault.json"
    store.check()
    if store.head(key) is not None:
        print("there is a vault already", file=sys.stderr)
        return 1
    header, keys = VaultHeader.create(_passphrase())
    store.put(key, iter([header.dump()]))
    _keep(config, keys)
    return 0


def unlock(config: Config) -> int:
    store, key = FolderStore(config.remote.bucket), f"{config.remote.prefix}vault.json"
    if store.head(key) is None:
        print("there is no vault; init makes one", file=sys.stderr)
        return 1
    _keep(config, VaultHeader.parse(store.get(key)).unlock(_passphrase()))
    return 0


def doctor(config: Config) -> int:
    FolderStore(config.remote.bucket).check()
    print("configuration and store are in order")
    return 0


def _show(actions, counts) -> None:
    from arbolith.operators.reconcile import shown

    for row in actions.select(shown(actions["kind"], actions["path"]).alias("line")).toLocalIterator():
        print(row.line)
    found = counts.first().asDict()
    print(", ".join(f"{n} {k}" for k, n in found.items()) if any(found.values()) else "up to date")


def scan(config: Config) -> int:
    from arbolith.sources.tree import scan_tree

    found = scan_tree(_session(), os.path.expanduser(config.local.root), ignore_files=f"{config.local.ignore_file},.ignore").orderBy("path")
    for row in found.toLocalIterator():
        print(f"{row.hash} {row.size:>12} {row.path}")
    print(f"{found.count()} files")
    return 0


def status(config: Config) -> int:
    from arbolith.operators.reconcile import ordered, plan, summary
    from arbolith.plans.apply import compare

    actions = plan(compare(_session(), _mirror(config))[-1])
    _show(ordered(actions), summary(actions))
    return 0


def snapshot(config: Config) -> int:
    from arbolith.operators.state import record_scan
    from arbolith.sources.tables import State
    from arbolith.sources.tree import scan_tree

    spark, root = _session(), os.path.expanduser(config.local.root)
    state = State(spark, os.path.join(root, ".mirror", "state"))
    baseline = state.baseline()
    seen = scan_tree(spark, root, baseline, ignore_files=f"{config.local.ignore_file},.ignore")
    state.commit(record_scan(baseline, seen.drop("raw_path"), int(time.time())))
    print(f"{seen.count()} files recorded")
    return 0


def sync(config: Config) -> int:
    from arbolith.plans import apply

    mirror = _mirror(config)
    conflicts = 0
    for row in apply.sync(_session(), mirror, int(time.time())).toLocalIterator():
        print(f"{row.kind:<14} {row.status:<9} {row.path}")
        conflicts += row.status == "conflict"
    if conflicts:
        print(f"{conflicts} conflicts were left as they are", file=sys.stderr)
    return 7 if conflicts else 0


COMMANDS = {f.__name__: f for f in (init, unlock, doctor, scan, status, snapshot, sync)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arbolith", description="Mirrors a folder to an encrypted store.")
    parser.add_argument("--config", default=os.environ.get("ARBOLITH_CONFIG", "arbolith.toml"))
    parser.add_argument("command", choices=COMMANDS)
    given = parser.parse_args(argv)
    return COMMANDS[given.command](Config.load(given.config))


if __name__ == "__main__":
    sys.exit(main())
