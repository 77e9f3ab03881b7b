import hashlib
from collections import Counter

from arbolith.llm import queries
from arbolith.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(texts, least):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    docs = [(t or "").split("\n") for t in texts]
    counts = Counter(k for d in docs for k in {key(x) for x in d})
    out = []
    for lines in docs:
        kept = [x for x in lines if not key(x) or counts[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_equals_brute_force(spark, small, sample):
    got = {r.doc_id: r for r in queries.op10_line_dedup(spark, small).collect()}
    for (i, _, _), (n, gone, kept) in zip(sample, brute([t for _, t, _ in sample], 10)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_odd_rows(spark, odd, empty):
    rows = odd.collect()
    for least in (2, 3):
        got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(odd, min_docs=least).collect())
        assert got == sorted((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text for r in rows], least)))
    assert dedup_lines(empty).collect() == []
    texts = ["A b\r\n x\nÀ", "\ta B \nà\n\n", "\n" * 50 + "a b", "a\x0bb\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs, min_docs=3).collect())
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 3))]
    for most in (0, 1):  # with lines and positions shuffled in place of broadcast
        assert got == sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs, min_docs=3, most_rows=most).collect())
