import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from arbolith.llm import conversations, queries
from arbolith.llm.conversations import rank_arcs, read_paths, repair, report

SCHEMA = "conv_id long, turn long, role string, text string, place long, h1 long"
BARE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    """first fault of each (turn, role, text), in order."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BARE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by trying all edits, from the end: the least of all cheapest audits."""
    best = {(len(rows), q): (0, "", ()) for q in (0, 3)} | {(len(rows), 1): (4, "II", ("user:", "assistant:")), (len(rows), 2): (2, "I", ("assistant:",))}
    for i in range(len(rows) - 1, -1, -1):
        _, role, text = rows[i]
        extra = found[i] == "truncated"
        for q in range(4):
            options = []
            for inserts in itertools.islice(itertools.count(), 4):
                state, added = q, []
                for _ in range(inserts):
                    state = 3 if state == 2 else 2
                    added.append("user:" if state == 2 else "assistant:")
                ways = [("D", 3, state, ())]
                if found[i] not in ("blank", "duplicate"):
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role[:1]))
                    if to:
                        ways.append(("K", extra, to, (f"{role}:{text}",)))
                    to = 3 if state == 2 else 2
                    ways.append(("R", 2 + extra, to, (("user:" if to == 2 else "assistant:") + text,)))
                for letter, cost, to, line in ways:
                    rest = best[i + 1, to]
                    options.append((2 * inserts + cost + rest[0], "I" * inserts + letter + rest[1], (*added, *line, *rest[2])))
            best[i, q] = min(options)
    return best[0, 0]


def expected(rows):
    rows = ordered(rows)
    found = faults(rows)
    cost, audit, lines = cheapest(rows, found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert LEGAL.match("".join(x[0] for x in lines))
    return gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def by_id(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def written(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def made(rng, n, sizes):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "unknown", " "]
    texts = ["Yes.", "No", "Why?", "", " \n", "One two three.", "and so on", "é!", "."]
    rows = []
    for conv in range(n):
        for i in range(rng.choice(sizes)):
            turn = rng.choice([i, i, i, i + 1, None])
            rows.append((conv if conv else None, turn, rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(i) + "."])))
    return rows


def test_repair_equals_brute_force(spark):
    rows = made(random.Random(5), 60, [1, 2, 3, 5, 8, 13])
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = written(report(repair(frame)))
    assert got == {k: expected(v) for k, v in by_id(rows).items()}


def test_a_conversation_over_many_partitions(spark):
    """Long conversations in pieces, of which some are a few rows, are repaired as if they lay together."""
    rows = [r for r in made(random.Random(9), 6, [150, 40, 3]) if r[0] in (None, 1, 2, 3, 4, 5)]
    rows = list({(c, t, r, x) for c, t, r, x in rows})
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = conversations.in_order(frame, "conv_id", "turn", "role", "text")
        assert table.select("part").distinct().count() > 12
        assert len(conversations._pieces(table)) > 12
        got = written(report(repair(frame)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
    assert got == {k: expected(v) for k, v in by_id(rows).items()}


def test_query_equals_brute_force(spark, small):
    got = written(queries.op12_conversation_repair(spark, small))
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv, turn, role, text in rows:
        mine = want.setdefault(conv, [])
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            mine += [row] * (2 if h == 3 else 1)
    assert got == {k: expected(v) for k, v in want.items()}


def test_arcs_are_ranked_by_their_audits():
    """Ranks order arcs as the whole audits from them do, and paths through doubled pointers are those of single steps."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        arcs = sorted({(a, int(rng.integers(a + 1, n)), letter) for a in range(n - 1) for letter in range(1, 5) if rng.random() < 0.5})
        source, target, letter = np.array([(0, 0, 0), *arcs]).T
        chosen, pointers, counts = rank_arcs(source, target, letter, n)
        audit = {n - 1: ()}
        for node in range(n - 1, -1, -1):
            own = [(x, *audit[b]) for a, b, x in arcs if a == node]
            first = min((x for x, *_ in own), default=None)
            audit[node] = next((p for p in own if p[0] == first), ())
        runs, path = read_paths(chosen[np.arange(n)], pointers, counts)
        for node in range(n):
            assert tuple(letter[path[runs == node]]) == audit[node]


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == [] and report(repair(empty)).collect() == []
    rows = [
        (None, None, None, None, 1, 2), (None, 1, "user", "Hi.", 1, 2), (None, 1, "user", "Hi.", 1, 2), (None, 1, "user", "Hi.", None, 2),
        (7, 3, "user", "word " * 200_000 + ".", 1, 2), (7, 4, "assistant", "x", 1, 2), (8, 5, "system", "Only.", 1, 2), (9, None, "assistant", "?", 1, 2),
        (10, -(1 << 63), "user", "a.", 1, 2), (10, (1 << 63) - 1, "assistant", "b.", 1, 2),
    ]
    got = written(report(repair(spark.createDataFrame(rows, SCHEMA))))
    text = lambda x: " " if x is None else x
    want = {k: expected([(t, text(r), text(x)) for t, r, x, *_ in v]) for k, v in by_id(rows).items()}
    want[10] = ((1 << 63) - 1, *want[10][1:])  # more turns are missing than a long can say
    assert got == want
    edits = repair(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 8").orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in edits] == [("D", None, None)]


def test_every_piece_has_the_same_answer_as_the_whole():
    """A run cut in two at any row: costs between states compose to the whole's costs."""
    rng = random.Random(2)
    for _ in range(50):
        kinds = [rng.randrange(16) for _ in range(rng.randint(2, 12))]
        whole = np.array(conversations.between_states(kinds)).reshape(4, 4)
        cut = rng.randrange(1, len(kinds))
        a, b = (np.array(conversations.between_states(k)).reshape(4, 4) for k in (kinds[:cut], kinds[cut:]))
        assert (np.min(a[:, :, None] + b[None], axis=1).clip(max=1 << 39) == whole.clip(max=1 << 39)).all()
