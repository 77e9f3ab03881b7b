"""Merging the change logs of several devices, path by path.

An entry says that a device gave a path new content (`hash`, null: it deleted the path), what it believed to be there before (`base_hash`, null:
nothing), and when in the total order of (lamport, device). A path's entries are folded in that order, so neither the order in
which logs arrive nor repeats change anything:

- forward: the writer knew the current state (or nothing was known): the entry becomes the state.
- converged: the entry is what is there already: the state keeps the lower stamp.
- conflict: both have content: the entry, whose stamp is higher, keeps the path; the state before is the loser, to be kept as a copy.
- kept: one of the two is a deletion that didn't know the other: the content stays, whatever the stamps.

Of entries with one stamp only the least by hash, then base, counts. A snapshot's rows (`settled`) come before all entries of their path.

A busy path's log is folded in pieces (`ordered`): what is last in a piece is known without the pieces before, up to three cases
(that content is still there, it is deleted, nothing was there), so a piece's summary is its result in each. One exchange. A task holds some MB of
entries at once, however many a path has.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.operators.ordered import Runs, along, carries, chains, in_ranges

ENTRY = ("path", "lamport", "device", "hash", "base_hash")
MADE = "outcome string, loser_lamport long, loser_device string, loser_hash string, state_lamport long, state_device string, state_hash string"


@dataclass(frozen=True)
class Current:
    """A path's state; lamport is None while nothing is known, hash is None after a deletion. `passed`: the state before the piece, as it was."""

    lamport: int | None = None
    device: str | None = None
    hash: str | None = None
    passed: bool = False


NOTHING = Current()


def step(state: Current, lamport: int, device: str, hash: str | None, base: str | None, settled: bool) -> tuple[str, Current]:
    """The outcome of an entry and the state after it."""
    new = Current(lamport, device, hash)
    if settled or (state.lamport is None and not state.passed) or base == state.hash:
        return "forward", new
    if hash == state.hash:
        return "converged", state
    if hash is not None and state.hash is not None:
        return "conflict", new
    return "kept", new if hash is not None else state


def _columns(rows: pa.Table) -> zip:
    return zip(*(rows[c].to_pylist() for c in ("lamport", "device", "hash", "base_hash", "settled")))


def _stamped(rows: pa.Table, stamp: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Entries without the further ones of a stamp (`stamp`: that of the row before), and the last row's stamp."""
    out = []
    for row in _columns(rows):
        own = row[0], row[1], row[4]
        if own != stamp:
            out.append(row)
        stamp = own
    return out, stamp


def _fold(made: tuple, rows: pa.Table) -> tuple:
    """(states, stamp) after further rows: one state for each case."""
    states, stamp = made
    entries, stamp = _stamped(rows, stamp)
    for row in entries:
        states = tuple(step(s, *row)[1] for s in states)
    return states, stamp


def _last_content(made: tuple, rows: pa.Table) -> tuple:
    content, stamp = made
    entries, stamp = _stamped(rows, stamp)
    return next((row[2] for row in reversed(entries) if row[2] is not None), content), stamp


def merge_logs(entries: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Each distinct entry (ENTRY) with its outcome, in a conflict the loser, and the state after it. Snapshot: path, hash, lamport, device."""
    log = entries.select(*ENTRY, F.lit(False).alias("settled"))
    if snapshot is not None:
        log = log.unionByName(snapshot.select("path", "lamport", "device", "hash", F.lit(None).cast("string").alias("base_hash"), F.lit(True).alias("settled")))
    table = in_ranges(log.withColumn("_entry", ~F.col("settled")), ["path"], ["_entry", "lamport", "device"], ["hash", "base_hash"])
    seen = chains(table, ["path"], lambda where: (None, None), _last_content)
    contents = carries(seen, None, lambda before, made: before if made[0] is None else made[0])
    cases = lambda content: (Current(hash=content, passed=True), Current(passed=True), NOTHING)
    results = chains(table, ["path"], lambda where: (cases(contents.get(where)), None), _fold) if seen else []

    def after(state: Current, made: tuple) -> Current:
        case = 2 if state.lamport is None else 1 if state.hash is None else 0
        return state if made[0][case].passed else made[0][case]

    known = {where: (state, None) for where, state in carries(results, NOTHING, after).items()}

    def rows(some: Runs, carry: list) -> tuple[dict[str, pa.Array], tuple]:
        out: list[tuple] = []
        starts = set(some.starts.tolist())
        run, state, stamp = -1, NOTHING, None
        for i, (lamport, device, hash, base, settled) in enumerate(_columns(some.rows)):
            if i in starts:
                run += 1
                state, stamp = carry[run]
            own = lamport, device, settled
            if settled:
                state = step(state, lamport, device, hash, base, True)[1]
                out.append(("settled", None, None, None, state.lamport, state.device, state.hash))
            elif own == stamp:
                out.append(("repeated", None, None, None, state.lamport, state.device, state.hash))
            else:
                before = state
                outcome, state = step(state, lamport, device, hash, base, False)
                loser = (before.lamport, before.device, before.hash) if outcome == "conflict" else (None, None, None)
                out.append((outcome, *loser, state.lamport, state.device, state.hash))
            stamp = own
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = [f.split()[0] for f in MADE.split(", ")]
        return {n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)}, (state, stamp)

    return along(table, ["path"], known, (NOTHING, None), rows, MADE).filter("outcome <> 'repeated'").drop("_entry")


def merged_state(merged: DataFrame) -> DataFrame:
    """The last state of each path of `merge_logs`: path, hash (null: deleted), lamport, device, and how many conflicts its entries had."""
    last = F.max_by(F.struct("state_hash", "state_lamport", "state_device"), F.struct(~F.col("settled"), "lamport", "device"))
    return (
        merged.groupBy("path")
        .agg(last.alias("s"), F.count_if(F.col("outcome").isin("conflict", "kept")).alias("conflicts"))
        .select("path", F.col("s.state_hash").alias("hash"), F.col("s.state_lamport").alias("lamport"), F.col("s.state_device").alias("device"), "conflicts")
    )
