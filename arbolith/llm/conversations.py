"""Conversation repair: the cheapest edits that give each conversation the roles system?, (user, assistant)+, or none at all.

A conversation's rows are taken by turn (nulls first), then role, then text. A row's first fault counts: blank, duplicate (role and text seen
earlier), truncated (doesn't end a sentence). Keep costs 0, rerole to user or assistant 2, delete 3 (the only way for blank and duplicate rows),
insert an empty user or assistant row anywhere 2; a truncated row that stays adds 1. Of the cheapest repairs the one with the least audit
(the edits' initials in order) is taken.

Method: a node is a place between rows with a state of the roles so far (nothing, after system, after user, after assistant). A dynamic
program from the end gives each node its cost, and so the arcs (edits) that cheapest repairs use. Those arcs are ranked by prefix doubling: first
by their letter, then by audits of 2, 4, 8, ... letters, each by a pair of ranks: its own and that of the arc its pointer leads to. An edit leads
from a node to one node only, so an arc's pointer goes to the least arc there, and the pointers of a round are those of the round before, taken twice.
The start's arc of least rank begins the audit, which is read through the same pointers, twice as many edits a round.

Scale: rows are dealt out in ranges of (conversation, turn, role, text), so that a conversation of any size lies over as many tasks as its rows
need. A task solves what lies in it whole. A conversation over several tasks is composed of its pieces: each gives the costs between its four states
(min-plus matrices), costs to go come from the last piece to the first, and the states between pieces follow from the first to the last. There are two such
pieces a partition at most, whatever the number of rows. Repeated rows are found by a count of 128-bit keys, combined before the shuffle.
`report` writes down each conversation as one row; as a SHA-256 has to read a conversation's text in order, a task streams it there and holds
only its audit.

Null roles and texts are one space, so they are blank or need another role. Null ids are one conversation. Rows that are equal in all columns
are duplicates of each other but for one. An empty table gives no edits. Columns but the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import SPACE, bounded_join, saved, text_or_empty

LETTERS = ["", "D", "I", "K", "R"]  # by the order of audits
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 40
#: The states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A repair may end in 0 and 3.
AFTER_INSERT = np.array([2, 2, 3, 2])
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
INITIALS = "sua"
TO_KEEP = np.array([*(KEPT[c] for c in INITIALS), (-1,) * 4])
ACCEPTED = (0, 2 * INSERT, INSERT, 0)
ROLES = {2: "user", 3: "assistant"}
FAULTS = [None, "blank", "duplicate", "truncated"]


def _nullable(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A saved table (conv, turn, role, text, late, blank, truncated, part), in ranges by order; late: an equal role and text has a smaller turn."""
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), _nullable(F.col(role)).alias("role"), _nullable(F.col(text)).alias("text"))
    own = [F.col("conv").isNull(), text_or_empty("conv"), F.col("role"), F.col("text")]
    rows = rows.select("*", F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own).alias("h2"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    bare = F.btrim("text", F.lit(SPACE))
    found = bounded_join(rows, saved(firsts), ["h1", "h2"], "left").select(
        "conv", "turn", "role", "text",
        F.coalesce(order > F.col("first"), F.lit(False)).alias("late"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    dealt = found.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    return saved(dealt.withColumn("part", F.spark_partition_id()))


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """For each row, whether it differs from the one before (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, unlike.to_numpy(zero_copy_only=False).astype(bool)][: len(column)]


@dataclass
class Piece:
    """What a conversation's piece in one partition has to know of the others."""

    entry: int = 0
    to_go: tuple[int, ...] = ACCEPTED  # costs from each state at its end
    closes: bool = True  # it is the conversation's last piece
    before: tuple[str, int | None] | None = None  # initial and turn of the row before


@dataclass
class Stretch:
    """Rows of whole runs (a run: a conversation's rows in this partition), with what all passes need."""

    rows: pa.Table
    opens: bool  # begins the partition
    ends: bool
    starts: np.ndarray = field(init=False)
    kinds: np.ndarray = field(init=False)  # 4 * class of the initial + fault
    fault: np.ndarray = field(init=False)
    initial: list[str] = field(init=False)

    def __post_init__(self) -> None:
        rows = self.rows
        new_run = _differs(rows["conv"])
        self.starts = np.flatnonzero(new_run)
        same = ~(new_run | _differs(rows["turn"]) | _differs(rows["role"]) | _differs(rows["text"]))
        of = lambda name: rows[name].to_numpy().astype(bool)
        blank, repeated = of("blank"), of("late") | same
        self.fault = np.select([blank, repeated, of("truncated")], [1, 2, 3], 0)
        self.initial = pc.utf8_slice_codeunits(rows["role"], 0, 1).to_pylist()
        self.kinds = np.array([INITIALS.find(c) if c else 3 for c in self.initial]) % 4 * 4 + self.fault

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.kinds)])

    def borders(self) -> list[tuple[int, str]]:
        """The runs that other partitions may go on with."""
        return ([(0, "first")] if self.opens else []) + ([(len(self.starts) - 1, "last")] if self.ends and (len(self.starts) > 1 or not self.opens) else [])


def stretches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[Stretch]:
    """The partition's rows in stretches of whole runs and about `most_bytes`, or one longer run."""
    held: list[pa.RecordBatch] = []
    ready: pa.Table | None = None
    size, opens = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= most_bytes:
            joint = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            cut = np.flatnonzero(_differs(joint["conv"])[1:])
            if len(cut):
                rows = pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))]).combine_chunks()
                if ready is not None:
                    yield Stretch(ready, opens, False)
                    opens = False
                ready, held, size = rows, [], 0
                batch = batch.slice(int(cut[-1]))
        held.append(batch)
        size += batch.nbytes
    if held:
        if ready is not None:
            yield Stretch(ready, opens, False)
            opens = False
        ready = pa.Table.from_batches(held).combine_chunks()
    if ready is not None:
        yield Stretch(ready, opens, True)


def step_costs(kind: int) -> tuple[int, bool, list[int]]:
    """Of a kind of row: what it adds if it stays, whether it has to go, and the states that keeping it leads to from each (-1: it can't stay as it is)."""
    fault = kind % 4
    return TRUNCATED if fault == 3 else 0, fault in (1, 2), TO_KEEP[kind // 4].tolist()


STEPS = [step_costs(kind) for kind in range(16)]
REROLED = AFTER_INSERT.tolist()


def costs_before(kind: int, after: tuple[int, ...]) -> tuple[int, int, int, int]:
    """The costs to go of the four states before a row, from those after it."""
    extra, bound, to = STEPS[kind]
    a, b, c, d = (DELETE + x for x in after)
    if not bound:
        again = REROLE + extra
        user, assistant = again + after[2], again + after[3]
        a, b, c, d = min(a, user), min(b, user), min(c, assistant), min(d, user)
        if to[0] >= 0:
            a = min(a, extra + after[to[0]])
        if to[1] >= 0:
            b, d = min(b, extra + after[2]), min(d, extra + after[2])
        if to[2] >= 0:
            c = min(c, extra + after[3])
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


def between_states(kinds: list[int]) -> list[int]:
    """Costs from each state before the rows to each after them, row by row."""
    columns = []
    for last in range(4):
        after = tuple(0 if q == last else NEVER for q in range(4))
        for kind in reversed(kinds):
            after = costs_before(kind, after)
        columns.append(after)
    return [columns[b][a] for a in range(4) for b in range(4)]


def solve(stretch: Stretch, pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edits of all runs, in order: run, row (or -1), letter, state after it. Last: the state at each run's end for the four states at its start."""
    n_runs = len(pieces)
    lengths = stretch.lengths
    kinds, costs = stretch.kinds.tolist(), np.zeros((len(stretch.kinds) + n_runs, 4), np.int64)
    base = stretch.starts + np.arange(n_runs)  # of a run's first place
    for r, piece in enumerate(pieces):
        after, first, at = piece.to_go, int(stretch.starts[r]), int(base[r])
        costs[at + lengths[r]] = after
        for i in range(int(lengths[r]) - 1, -1, -1):
            after = costs_before(kinds[first + i], after)
            costs[at + i] = after
    final = base + lengths
    inner = np.ones(len(costs), bool)
    inner[final] = False
    place = np.flatnonzero(inner)
    kind = stretch.kinds
    extra, free = np.where(kind % 4 == 3, TRUNCATED, 0), ~np.isin(kind % 4, (1, 2))
    closed = np.sort(np.r_[place, final[[p.closes for p in pieces]]])  # places where rows may be inserted
    arcs = []
    for q in range(4):
        here, there = costs[place], costs[place + 1]
        to = TO_KEEP[kind // 4, q]
        kept = free & (to >= 0) & (here[:, q] == extra + np.take_along_axis(there, np.maximum(to, 0)[:, None], 1)[:, 0])
        changed = free & (here[:, q] == REROLE + extra + there[:, REROLED[q]])
        gone = here[:, q] == DELETE + there[:, q]
        filled = closed[costs[closed, q] == INSERT + costs[closed, REROLED[q]]]
        for letter, at, target in (
            (1, place[gone], 4 * (place[gone] + 1) + q),
            (2, filled, 4 * filled + REROLED[q]),
            (3, place[kept], 4 * (place[kept] + 1) + to[kept]),
            (4, place[changed], 4 * (place[changed] + 1) + REROLED[q]),
        ):
            arcs.append(np.stack([4 * at + q, target, np.full(len(at), letter)]))
    source, target, letter = np.concatenate([np.zeros((3, 1), np.int64), *arcs], axis=1)  # the first arc stands for the end
    starts = (4 * base[:, None] + np.arange(4)).ravel()
    chosen, pointers, counts = rank_arcs(source, target, letter, 4 * len(costs))
    begin = chosen[4 * base + np.array([p.entry for p in pieces])]
    run, path = read_paths(begin, pointers, counts)
    row_of = np.full(len(costs), -1)
    row_of[place] = np.arange(len(place))
    row = np.where(letter[path] == 2, -1, row_of[source[path] // 4])
    # a run's last state: its path's last arc, or where it began if there is none
    exits = np.tile(np.arange(4), n_runs)
    heads = chosen[starts]
    last = heads.copy()
    for pointer in reversed(pointers):
        ahead = pointer[last]
        last = np.where(ahead > 0, ahead, last)
    exits = np.where(heads > 0, target[last] % 4, exits).reshape(-1, 4)
    return run, row, letter[path], target[path] % 4, exits


def rank_arcs(source: np.ndarray, target: np.ndarray, letter: np.ndarray, n_nodes: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Prefix doubling: the least arc of each node (0 if none), pointers 1, 2, 4, ... arcs ahead, and how many arcs each passes."""

    def least(rank: np.ndarray) -> np.ndarray:
        chosen = np.zeros(n_nodes, np.int64)
        by = np.argsort(-rank[1:], kind="stable") + 1
        chosen[source[by]] = by  # the last one written has the least rank
        return chosen

    rank = letter.copy()
    chosen = least(rank)
    pointer, count = chosen[target], np.ones(len(source), np.int64)
    pointer[0] = count[0] = 0
    pointers, counts = [], []
    sharp = False
    while True:
        pointers.append(pointer)
        counts.append(count)
        if not pointer.any():
            return least(rank), pointers, counts
        if not sharp:
            _, rank = np.unique(rank * (len(source) + 1) + rank[pointer], return_inverse=True)
            sharp = int(rank.max()) == len(rank) - 1
        count = count + count[pointer]
        pointer = pointer[pointer]


def read_paths(begin: np.ndarray, pointers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(run, arc) along the path from each run's first arc, in order. Runs with paths of like length are read together."""
    total = counts[-1][begin]
    rounds = np.ceil(np.log2(np.maximum(total, 1))).astype(int)
    runs, places, arcs = [], [], []
    for k in np.unique(rounds[total > 0]):
        mine = np.flatnonzero((rounds == k) & (total > 0))
        path = begin[mine][:, None]
        for pointer in pointers[:k]:
            path = np.concatenate([path, pointer[path]], axis=1)
        which, at = np.nonzero(path)
        runs.append(mine[which])
        places.append(at)
        arcs.append(path[which, at])
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, at, arc = map(np.concatenate, (runs, places, arcs))
    by = np.lexsort([at, run])
    return run[by], arc[by]


def _pieces(table: DataFrame) -> dict[tuple[int, str], Piece]:
    """What the pieces at the partitions' borders need. The driver sees two rows a partition at most, however many rows there are."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in stretches(batches):
            for r, which in s.borders():
                a, b = int(s.starts[r]), int(s.starts[r] + s.lengths[r])
                ends = s.rows.slice(a, 1).to_pylist()[0], s.rows.slice(b - 1, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "conv": s.rows["conv"].slice(a, 1).combine_chunks(),
                        "part": pa.array([ends[0]["part"]], pa.int32()),
                        "which": [which],
                        "costs": pa.array([between_states(s.kinds[a:b].tolist())], pa.list_(pa.int64())),
                        "initial": [s.initial[b - 1]],
                        "turn": pa.array([ends[1]["turn"]], pa.int64()),
                    }
                )

    schema = T.StructType([table.schema["conv"], *T.StructType.fromDDL("part int, which string, costs array<long>, initial string, turn long")])
    found = sorted(table.mapInArrow(summary, schema).collect(), key=lambda r: (r.part, r.which))
    chains, pieces = [], {}
    for r in found:
        if chains and chains[-1][-1].conv == r.conv and chains[-1][-1].part != r.part:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    for chain in chains:
        to_go = ACCEPTED
        for k in range(len(chain) - 1, -1, -1):
            before = (chain[k - 1].initial, chain[k - 1].turn) if k else None
            pieces[chain[k].part, chain[k].which] = Piece(-1, to_go, k == len(chain) - 1, before)
            m = chain[k].costs
            to_go = tuple(min(m[4 * a + b] + to_go[b] for b in range(4)) for a in range(4))
    if not chains:
        return {}

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in stretches(batches):
            part = s.rows["part"][0].as_py()
            for r, which in s.borders():
                piece = pieces.get((part, which))
                if piece:
                    alone = Stretch(s.rows.slice(int(s.starts[r]), int(s.lengths[r])), False, False)
                    ends = solve(alone, [Piece(0, piece.to_go, piece.closes)])[-1][0]
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "which": [which], "ends": pa.array([ends.tolist()], pa.list_(pa.int32()))})

    ends = {(r.part, r.which): r.ends for r in table.mapInArrow(exits, "part int, which string, ends array<int>").collect()}
    for chain in chains:
        state = 0
        for r in chain:
            pieces[r.part, r.which].entry = state
            state = ends[r.part, r.which][state]
    return pieces


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit: `conv`, place (their order), edit (K, R, D, I), role and text (the repaired row's; null if deleted), cost; and of the row
    that was edited (null for I): turn, fault, illegal (its role can't follow the role before), new_turn (the row before has another turn)."""
    table = in_order(rows, conv, turn, role, text)
    pieces = _pieces(table)
    fields = "place long, edit string, role string, text string, cost long, turn long, fault string, illegal boolean, new_turn boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for s in stretches(batches):
            part = s.rows["part"][0].as_py()
            own = [Piece()] * len(s.starts)
            for r, which in s.borders():
                own[r] = pieces.get((part, which), own[r])
            which, row, letter, state, _ = solve(s, own)
            new_turn = _differs(s.rows["turn"]) | _differs(s.rows["conv"])
            illegal = np.array([a + b not in ("su", "ua", "au") for a, b in zip(["", *s.initial], s.initial)])
            for r, first in enumerate(s.starts.tolist()):
                before = own[r].before
                new_turn[first] = before is None or before[1] != s.rows["turn"][first].as_py()
                illegal[first] = before is not None and before[0] + s.initial[first] not in ("su", "ua", "au")
            taken = pa.array(np.where(row < 0, s.starts[which], row))
            old = s.rows.take(taken)
            inserted, gone = pa.array(row < 0), pa.array(letter == 1)
            made = pa.array([ROLES.get(q) for q in state.tolist()], pa.string())
            roles = pc.if_else(pa.array(letter == 3), old["role"], made)
            null = lambda kind: pa.scalar(None, kind)
            fault = s.fault[taken.to_numpy()]
            cost = np.select([letter == 1, letter == 2, letter == 3], [DELETE, INSERT, 0], REROLE) + np.where((letter > 2) & (fault == 3), TRUNCATED, 0)
            columns = [
                old["conv"],
                pa.array((part << 40) + done + np.arange(len(row))),
                pa.array(LETTERS).take(pa.array(letter)),
                pc.if_else(gone, null(pa.string()), roles),
                pc.if_else(gone, null(pa.string()), pc.if_else(inserted, pa.scalar(""), old["text"])),
                pa.array(cost),
                pc.if_else(inserted, null(pa.int64()), old["turn"]),
                pc.if_else(inserted, null(pa.string()), pa.array(FAULTS).take(pa.array(fault))),
                pc.if_else(inserted, null(pa.bool_()), pa.array(illegal[taken.to_numpy()])),
                pc.if_else(inserted, null(pa.bool_()), pa.array(new_turn[taken.to_numpy()])),
            ]
            done += len(row)
            names = ["conv", *(f.split()[0] for f in fields.split(", "))]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=10_000)

    out = table.mapInArrow(run, T.StructType([table.schema["conv"], *T.StructType.fromDDL(fields)]))
    return out.withColumnRenamed("conv", conv)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of `repair`'s edits: counts, cost, audit and the SHA-256 of the repaired `role:text`, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: pa.Scalar | None = None
        out: list[tuple] = []
        counts: dict[str | None, int] = {}

        def close() -> None:
            gaps = highest - lowest + 1 - turns if turns else 0
            digits = tuple(counts.get(k, 0) for k in ("blank", "duplicate", "truncated"))
            out.append((current, min(gaps, (1 << 63) - 1), *digits, illegal, cost, "".join(audit), sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
            ids = pa.array([c.as_py() for c in columns[0]], kind)
            out.clear()
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=names)

        names = ["conv", *(f.split()[0] for f in REPORT.split(", "))]
        for batch in batches:
            kind = batch.column("conv").type
            new = _differs(pa.chunked_array([batch.column("conv")])).tolist() if batch.num_rows else []
            columns = [batch.column(n).to_pylist() for n in ("edit", "role", "text", "cost", "turn", "fault", "illegal", "new_turn")]
            for i, (edit, role, text, price, turn, fault, odd, fresh) in enumerate(zip(*columns)):
                if new[i]:
                    conv_id = batch.column("conv")[i]
                    if current is None or not conv_id.equals(current):
                        if current is not None:
                            close()
                        current, counts, audit, sha = conv_id, {}, [], hashlib.sha256()
                        lowest = highest = turn
                        turns = illegal = cost = lines = 0
                audit.append(edit)
                cost += price
                counts[fault] = counts.get(fault, 0) + 1
                illegal += bool(odd)
                if fresh and turn is not None:
                    turns += 1
                    lowest, highest = turn if lowest is None else min(lowest, turn), turn if highest is None else max(highest, turn)
                if role is not None:
                    sha.update((("\n" if lines else "") + role + ":" + text).encode())
                    lines += 1
            if len(audit if current is not None else "") > 10_000:
                audit = ["".join(audit)]
            if len(out) >= 1000:
                yield flush()
        if current is not None:
            close()
            yield flush()

    rows = edits.withColumnRenamed(conv, "conv")
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "place")
    out = dealt.mapInArrow(run, T.StructType([dealt.schema["conv"], *T.StructType.fromDDL(REPORT)]))
    return out.withColumnRenamed("conv", conv)
