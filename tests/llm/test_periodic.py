import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np

from arbolith.llm import queries
from arbolith.llm.periodic import Places, find_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least):
    """All runs, period by period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = same.index(False, i)
            length = j - i + q
            if length >= max(least, 2 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    for turn in range(400):
        monkeypatch.setattr(Places, "BLOCK", rng.choice([2, 4, 1024]))
        least, texts = rng.choice([2, 3, 4, 6, 12]), []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(0, 80)
            w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(n)]
            if n and turn % 2:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        assert find_runs([np.array(w, np.int32) for w in texts], least) == [brute(w, least) for w in texts]


def test_query_equals_brute_force(spark, small, sample):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, small).collect()}
    assert len(got) == len(sample)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for i, text, _ in sample:
        words = damaged(i, text)
        if len(words) > 1500:
            continue
        runs = brute(words, 12)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        row = got[i]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.n_runs == len(runs) and row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
        with_runs += bool(runs)
    assert with_runs > 10


def test_odd_rows(odd, empty):
    rows = [r for r in periodic_runs(odd).collect()]
    assert len(rows) == odd.count() and periodic_runs(empty).collect() == []
    by = {r.doc_id: r for r in rows}
    assert by[1].runs == by[2].runs == by[3].runs == [] and by[3].collapsed == ""
    assert [tuple(x) for x in by[7].runs] == [(0, 60000, 2)] and by[7].collapsed == "long words"
    assert by[5].collapsed == "The same text as another, twice over. line two"
    made = {r.doc_id: r.text for r in queries.made_periodic(odd).collect()}
    for r in odd.collect():
        if r.doc_id is not None:
            assert WORD.findall(made[r.doc_id]) == damaged(r.doc_id, r.text)


def test_long_text_in_bounded_memory():
    """20 MB of words that repeat, with a period of 1,000 and with random ones, beside each other."""
    code = """
import resource, numpy as np
from arbolith.llm.periodic import find_runs, collapsed
from arbolith.llm.quality import numbered
text = (" ".join(f"word{i}" for i in range(1000)) + " ") * 2500
raw = text.encode()
ids, _ = numbered(raw)
(runs,) = find_runs([ids], 12)
assert runs == [(0, len(ids), 1000)], runs[:3]
assert len(collapsed(raw, len(ids), runs).split()) == 1000
print(len(raw), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    size, most = map(int, out.stdout.split())
    assert size > 18_000_000 and most < 1500, most
