import hashlib
import random
import re

import numpy as np

from arbolith.llm import decontaminate, queries
from arbolith.llm.decontaminate import Windows, benchmark_hits, benchmark_words, runs_to_index, without_contaminated
from arbolith.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=13):
    found = {}
    for name, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for size, windows in found.items():
            for at in range(len(w) - size + 1):
                own = windows.get(tuple(w[at : at + size]))
                if own:
                    hit |= set(range(at, at + size))
                    names |= own
        out.append((str(i), len(w), len(hit), sorted(names)))
    return sorted(out)


def test_query_equals_brute_force(spark, small, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = {x[0]: x for x in brute([(i, t) for i, t, _ in sample], items)}
    got = queries.op7_decontamination(spark, small).collect()
    assert len(got) == len(sample) and any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    for r in got:
        _, n, hit, names = want[str(r.doc_id)]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_short_items_blocks_and_odd_rows(spark, odd, empty):
    items = [(1, "one"), (2, "SAME text as"), (3, "same text as"), (None, "words long"), (4, None), (5, " .,"), (6, "é 漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], items)
    for size in (4 << 20, 8):
        got = benchmark_hits(odd, bench, block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert benchmark_hits(empty, bench).collect() == []
    clean = without_contaminated(odd, bench)
    assert clean.columns == odd.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(i for i, n, hit, _ in want if not (hit and 20 * hit >= n))
    assert {r.n_hit for r in benchmark_hits(odd, bench.limit(0)).collect()} == {0}


def test_index_finds_every_occurrence():
    rng = random.Random(5)
    for _ in range(30):
        parts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 50))] for _ in range(rng.randrange(1, 5))]
        text = np.array([x for p in parts for x in [*p, 0]])
        index = FMIndex(text, 3)
        patterns = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))] for _ in range(20)]
        flat = np.array([x for p in patterns for x in p])
        length = np.array([len(p) for p in patterns])
        low, high = index.search(flat, np.cumsum(length) - length, length)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_only_runs_that_can_hold_a_window_are_indexed():
    """With windows of 13 words, a shard's scattered benchmark words are not indexed."""
    item = " ".join(f"w{i}" for i in range(20))
    windows = Windows([("a", item), ("b", ""), ("c", item + " w1")], 13)
    assert windows.least == 13 and len(windows.first) == 9 and windows.owners(0) == ["a", "c"] and windows.owners(8) == ["c"]
    text = f"w1 other w2 w3 {' '.join(f'w{i}' for i in range(12))} other {item} other w5"
    ids = np.array([windows.number.get(w, 0) for w in benchmark_words(text)] + [0])
    starts, ends = runs_to_index(ids, windows.least)
    assert (ends - starts).tolist() == [14, 20] and int(ends[0]) == 16
    assert Windows([], 13).least == 0 and Windows([("a", " .")], 13).least == 0


def test_windows_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        window = rng.randrange(1, 9)
        items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for k in range(rng.randrange(0, 6))]
        want = {}
        for name, text in items:
            w = text.split()
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                want.setdefault(tuple(w[i : i + size]), set()).add(name)
        windows = Windows(items, window)
        word = {n: w.decode() for w, n in windows.number.items()}
        got = {
            tuple(word[x] for x in windows.words[a : a + n].tolist()): set(windows.owners(k))
            for k, (a, n) in enumerate(zip(windows.first.tolist(), windows.length.tolist()))
        }
        assert got == want and len(got) == len(windows.first)


def test_large_benchmarks_are_searched_in_one_pass(spark):
    """Spans of several blocks are united in one pass without a join; with more blocks than a pass takes, passes are joined."""
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(k, draw(rng.randrange(1, 12))) for k in range(12)]
    docs = [(k, draw(rng.randrange(0, 60))) for k in range(40)] * 2
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for most, joined in ((64, False), (1, True), (2, True)):
        found = benchmark_hits(table, bench, window=5, block_bytes=20, pass_blocks=most)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and ("Join" in plan) == joined
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect()) == brute(docs, items, 5)


def test_a_shard_is_indexed_once_for_all_blocks(monkeypatch):
    built = []
    monkeypatch.setattr(decontaminate, "FMIndex", lambda *a: built.append(1) or FMIndex(*a))
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(str(k), draw(rng.randrange(0, 12))) for k in range(30)]
    docs = [(k, draw(rng.randrange(0, 80))) for k in range(40)]
    blocks = [Windows(items[k::7], 4) for k in range(7)]
    got = decontaminate.mark([t for _, t in docs], [lambda b=b: b for b in blocks])
    assert len(built) == 1
    one = decontaminate.mark([t for _, t in docs], [lambda: Windows(items, 4)])
    assert got == one
    want = brute(docs, items, 4)
    assert sorted((str(i), n, sum(h["last"] - h["first"] for h in hits), names) for (i, _), n, hits, names in zip(docs, *got)) == want
    assert decontaminate.mark(["", None], [lambda b=b: b for b in blocks]) == ([0, 0], [[], []], [[], []])
