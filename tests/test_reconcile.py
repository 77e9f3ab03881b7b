from itertools import product

import pytest

from arbolith.operators.reconcile import bookkeeping, changes, last_wins, ordered, plan, summary
from arbolith.schemas import BASELINE, LOCAL, MANIFEST


def sides(spark, rows):
    """rows: (path, local, base, remote) with None for absent."""
    local = [(p, 1, 0, h) for p, h, _, _ in rows if h]
    base = [(p, 1, 0, "x", h, 0) for p, _, h, _ in rows if h]
    remote = [(p, 1, h, "k") for p, _, _, h in rows if h]
    return spark.createDataFrame(local, LOCAL), spark.createDataFrame(base, BASELINE), spark.createDataFrame(remote, MANIFEST)


#: local, base, remote, expected action.
MATRIX = [
    ("1", "1", "1", None), ("2", "1", "1", "upload"), ("1", "1", "2", "download"), ("1", None, None, "upload"),
    (None, None, "1", "download"), (None, "1", "1", "delete-remote"), ("1", "1", None, "delete-local"), (None, "1", None, None),
    ("2", "1", "3", "conflict"), ("2", "1", "2", None), ("2", None, "3", "conflict"), ("2", None, "2", None),
    (None, "1", "2", "conflict"), ("2", "1", None, "conflict"),
]


def expected(here, base, there):
    """The decision table, by cases."""

    def change(now):
        return "same" if now == base else "new" if base is None else "gone" if now is None else "other"

    a, b = change(here), change(there)
    edits = ("new", "other")
    if a == "same" and b == "same" or a == b == "gone":
        return None
    if a == "same":
        return "download" if b in edits else "delete-local"
    if b == "same":
        return "upload" if a in edits else "delete-remote"
    return None if a in edits and b in edits and here == there else "conflict"


def test_matrix_and_all_triples(spark):
    values = [None, "1", "2", "3"]
    rows = [(f"m{i}", *r[:3]) for i, r in enumerate(MATRIX)] + [(f"t{i}", *t) for i, t in enumerate(product(values, repeat=3))]
    want = {f"m{i}": r[3] for i, r in enumerate(MATRIX)} | {f"t{i}": expected(*t) for i, t in enumerate(product(values, repeat=3))}
    got = {r.path: r.kind for r in changes(*sides(spark, rows)).collect()}
    assert {p: k for p, k in got.items() if k} == {p: k for p, k in want.items() if k}
    assert set(got) == {p for p, *t in rows if any(t)}


def test_transfers_come_before_deletes(spark):
    rows = [("gone", None, "1", "1"), ("keep", "2", "1", "3"), ("up", "1", None, None), ("Zdown", None, None, "1"), ("adown", None, None, "1")]
    actions = plan(changes(*sides(spark, rows)))
    assert [(r.kind, r.path) for r in ordered(actions).collect()] == [
        ("download", "Zdown"), ("download", "adown"), ("upload", "up"), ("delete-remote", "gone"), ("conflict", "keep")
    ]
    assert summary(actions).first().asDict() == {"download": 2, "upload": 1, "delete_local": 0, "delete_remote": 1, "conflict": 1}
    assert summary(actions.limit(0)).first().asDict() == dict.fromkeys(("download", "upload", "delete_local", "delete_remote", "conflict"), 0)


def test_a_baseline_row_that_was_never_synced_counts_as_absent(spark):
    local, _, remote = sides(spark, [("f", "1", None, None)])
    base = spark.createDataFrame([("f", 1, 0, "1", None, 0)], BASELINE)
    assert [r.kind for r in changes(local, base, remote).collect()] == ["upload"]


def test_bookkeeping(spark):
    rows = [("both gone", None, "1", None), ("same edit", "2", "1", "2"), ("same new", "2", None, "2"), ("quiet", "1", "1", "1"), ("fight", "2", "1", "3")]
    got = {(r.path, r.step, r.hash) for r in bookkeeping(changes(*sides(spark, rows))).collect()}
    assert got == {("both gone", "forget", None), ("same edit", "adopt", "2"), ("same new", "adopt", "2")}


def test_one_shuffle(spark):
    changed = changes(*sides(spark, [("f", "1", None, None)]))
    text = changed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_last_of_equal_paths_wins(spark):
    rows = spark.createDataFrame([("é", "e1", "1"), ("é", "é", "2")], "path string, raw_path string, hash string")
    assert [r.hash for r in last_wins(rows, "raw_path").collect()] == ["2"]


@pytest.mark.parametrize("name", ["reconcile_plan", "plan_summary"])
def test_counts_on_the_sample(spark, small, name):
    from arbolith.plans import catalog

    got = catalog.queries()[name](spark, small)
    if name == "plan_summary":
        assert tuple(got.first()) == (30, 33, 7, 6, 74)
    else:
        assert got.count() == 150
