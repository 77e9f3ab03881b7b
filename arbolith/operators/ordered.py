"""Folds along the rows of each key in order, at any number of rows a key.

`in_ranges` deals rows out in ranges of (key, order): one exchange, after which a key's rows lie in consecutive partitions. A run is what a
partition has of one key. A task goes through its partition by pieces of a few MB and carries the state of a run that a piece cuts, so its memory follows neither
the partition nor the run. Only a partition's first and last run can go on elsewhere, so `chains` brings two summaries a partition to
the driver, however many rows there are; they are folded there into what each first run has to know of the runs before it, and
`along` then works on all runs where they lie.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.sources.shared import saved

Where = tuple[int, str]
LOW = -(1 << 63)
#: Bytes of rows that a task works on at once.
PIECE = 8 << 20


def in_ranges(df: DataFrame, keys: list[str], order: list[str | Column], ties: list[str] | None = None) -> DataFrame:
    """`df`, saved, with `_part`: sorted by keys, order and ties within partitions that are ranges of keys and order; rows that are equal in these lie together."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, *(ties or []))
    return saved(dealt.withColumn("_part", F.spark_partition_id()))


def differs(column: pa.ChunkedArray) -> np.ndarray:
    """For each row, whether it differs from the one before (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, unlike.to_numpy(zero_copy_only=False).astype(bool)][: len(column)]


@dataclass
class Runs:
    """Some MB of a partition's rows, cut into runs; a run may have begun in the piece before, and its last one may go on in the next."""

    rows: pa.Table
    keys: list[str]
    goes_on: bool  # its first run is the last one of the piece before
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.flatnonzero(np.any([differs(self.rows[k]) for k in self.keys], axis=0))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, self.rows.num_rows])

    @property
    def run_of(self) -> np.ndarray:
        """The number of each row's run."""
        return np.repeat(np.arange(len(self.starts)), self.lengths)

    @property
    def part(self) -> int:
        return self.rows["_part"][0].as_py()

    def run(self, r: int) -> pa.Table:
        return self.rows.slice(int(self.starts[r]), int(self.lengths[r]))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most_bytes: int) -> Iterator[Runs]:
    """The rows in pieces of some `most_bytes`, wherever that cuts them."""
    held: list[pa.RecordBatch] = []
    size, before = 0, None

    def piece() -> Runs:
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = before is None or any(differs(pa.concat_tables([before, rows.slice(0, 1)])[k])[1] for k in keys)
        return Runs(rows, keys, not cut)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield (some := piece())
            before, held, size = some.rows.take([some.rows.num_rows - 1]), [], 0
    if held:
        yield piece()


def chains(table: DataFrame, keys: list[str], start: Callable[[Where], Any], more: Callable[[Any, pa.Table], Any]) -> list[list[tuple[Where, Any]]]:
    """Of each key whose rows lie in several partitions of `in_ranges`: its runs in order, with their summaries: `start`, taken on by `more` along the run's rows."""
    if table.rdd.getNumPartitions() < 2:
        return []
    most_bytes = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part, key, made = 0, 0, b"", None

        def summary() -> pa.RecordBatch:
            which = "first" if n == 1 else "last"
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "which": [which], "key": pa.array([key]), "made": pa.array([pickle.dumps(made)])})

        for some in runs(batches, keys, most_bytes):
            part, ends = some.part, {0, len(some.starts) - 1}  # what lies between goes on nowhere
            for r in sorted(ends):
                if r or not some.goes_on:
                    if n == 1:
                        yield summary()
                    n += 1
                    made = start((part, "first" if n == 1 else "last"))
                rows = some.run(r)
                key = pickle.dumps([rows[k][0].as_py() for k in keys])
                made = more(made, rows)
        if n:
            yield summary()

    found = sorted(table.mapInArrow(run, "part int, which string, key binary, made binary").collect(), key=lambda r: (r.part, r.which))
    out: list[list[tuple[Where, Any]]] = []
    last: tuple[int, Any] | None = None
    for r in found:
        one = ((r.part, r.which), pickle.loads(r.made))
        if last and last[0] != r.part and last[1] == r.key:
            out[-1].append(one)
        else:
            out.append([one])
        last = (r.part, r.key)
    return [c for c in out if len(c) > 1]


def carries(found: list[list[tuple[Where, Any]]], start: Any, after: Callable[[Any, Any], Any]) -> dict[Where, Any]:
    """What each run of a chain has to know of the runs before it: `start`, folded with their summaries."""
    out = {}
    for chain in found:
        carry = start
        for where, made in chain:
            out[where] = carry
            carry = after(carry, made)
    return out


def along(
    table: DataFrame, keys: list[str], known: dict[Where, Any], start: Any, rows: Callable[[Runs, list], tuple[dict[str, pa.Array], Any]], made: str
) -> DataFrame:
    """`table` without `_part`, with the columns of the DDL string `made`, which `rows` gives for some runs and their carries, with the last run's carry for rows that follow."""
    schema = T.StructType([*(f for f in table.schema if f.name != "_part"), *T.StructType.fromDDL(made)])
    most_bytes = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, state = False, None
        for some in runs(batches, keys, most_bytes):
            # a run that begins within the partition has no rows before it
            carry = [start] * len(some.starts)
            carry[0] = state if some.goes_on else start if began else known.get((some.part, "first"), start)
            columns, state = rows(some, carry)
            began = True
            out = some.rows.drop_columns(["_part"])
            for name, column in columns.items():
                out = out.append_column(name, column)
            yield from out.to_batches(max_chunksize=10_000)

    return table.mapInArrow(run, schema)


def counted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """`rows` with n, from 1 along `order` within each key."""
    table = in_ranges(rows, [key], [order])
    known = carries(chains(table, [key], lambda where: 0, lambda n, rows: n + rows.num_rows), 0, lambda a, b: a + b)

    def number(some: Runs, carry: list) -> tuple[dict[str, pa.Array], int]:
        place = np.arange(some.rows.num_rows) - np.repeat(some.starts, some.lengths)
        n = place + np.array(carry)[some.run_of] + 1
        return {"n": pa.array(n)}, int(n[-1])

    return along(table, [key], known, 0, number, "n long")


def running_max(rows: DataFrame, key: str, order: list[str], value: str, made: str, ties: list[str] | None = None, before: bool = False) -> DataFrame:
    """`rows` with `made`: the greatest `value` of the key so far (nulls don't count; null if none), without the row itself if `before`."""
    table = in_ranges(rows, [key], order, ties)
    top = lambda most, rows: max(most, LOW if (x := pc.max(rows[value]).as_py()) is None else int(x))
    known = carries(chains(table, [key], lambda where: LOW, top), LOW, max)

    def raised(some: Runs, carry: list) -> tuple[dict[str, pa.Array], int]:
        own, run = pd.Series(some.rows[value].cast(pa.int64()).fill_null(LOW).to_numpy()), some.run_of
        most = own.groupby(run).cummax()
        after = max(int(most.iloc[-1]), carry[-1])
        if before:
            most = most.groupby(run).shift(1, fill_value=LOW)
        most = np.maximum(most.to_numpy(), np.array(carry, np.int64)[run])
        return {made: pa.array(most, mask=most == LOW)}, after

    return along(table, [key], known, LOW, raised, f"{made} long")
