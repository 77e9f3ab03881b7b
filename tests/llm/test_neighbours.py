import numpy as np
from pyspark.sql import functions as F

from arbolith.llm import neighbours, queries
from arbolith.llm.neighbours import BITS, Coder, Split, best_split, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, h1 long, code string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1, "x", 2) for i, v in rows], SCHEMA)


def exact(rows, i, k):
    """(vec_id, score) of the k nearest other rows of row i, by score, then id."""
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    scores = [(-float((vectors[j] * vectors[i]).sum()), rows[j][0]) for j in range(len(rows)) if j != i]
    return [(b, -a) for a, b in sorted(scores)[:k]]


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, rows, k, step):
    hits = wanted = 0
    for i, (vec_id, _) in enumerate(rows):
        if vec_id % step == 0:
            want = exact(rows, i, k)
            mine = got[vec_id]
            assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
            assert all(abs(s - b) <= 1e-12 for (_, _, s), (_, b) in zip(mine, want[:1]) if (mine[0][1] == want[0][0]))
            assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
            hits += len({x for _, x, _ in mine} & {x for x, _ in want})
            wanted += len(want)
    return hits / wanted


def test_query_has_the_recall(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert recall(lists(queries.op11_nearest_neighbours(spark, small)), rows, 20, 20) >= 0.9


def test_recall_of_clusters_in_many_chunks(spark):
    """Clustered vectors of unequal lengths, an index in many chunks and lead bits: neighbours are close, so the radius is small."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + 0.2 * rng.normal(size=24)) * rng.uniform(0.9, 1.1)) for i in range(3000)]
    got = lists(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, k=10, chunk=100))
    assert recall(got, rows, 10, 50) >= 0.9


def test_all_codes_within_the_radius_are_found(spark, monkeypatch):
    """At a radius, what is found is every code within it, once: pigeonhole probing against a look at all pairs."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16) * (0.05 if i % 3 else 1) + (i % 5 == 0)) for i in range(300)]
    seen = {}

    def fixed(radius, n, chunk):
        seen["split"] = seen.get("split") or Split(26, 8, 2)
        return seen["split"] if "done" not in seen else best_split(radius, n, chunk)

    entries = {}
    encoded = neighbours._encoded

    def kept(frame, coder):
        out = encoded(frame, coder)
        entries["rows"] = out.collect()
        return out

    searched = neighbours._searched

    def looked(index, asked, split, k, chunk):
        found = searched(index, asked, split, 1000, chunk)
        if "found" not in seen:
            seen["found"] = found.collect()
            seen["done"] = True
        return found

    monkeypatch.setattr(neighbours, "best_split", fixed)
    monkeypatch.setattr(neighbours, "_encoded", kept)
    monkeypatch.setattr(neighbours, "_searched", looked)
    nearest(frame(spark, rows), F.col("vec_id") % 3 == 0, k=5, chunk=20).collect()
    pairs = sorted((r.h1, f.id) for r in seen["found"] for f in r.found)
    want = sorted(
        (a.h1, i) for a in entries["rows"] if a.asked for b in entries["rows"] for i in b.ids
        if bin((a.query_code ^ b.code) & ((1 << BITS) - 1)).count("1") <= 26
    )
    assert pairs == want and len(pairs) > 1000


def test_copies_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 1.0]), (41, [2.0, 2.0]), (41, [2.0, 2.0]), (42, [-1.0, -1.0])]
    got = lists(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5))
    assert sorted(got) == [0, 20, 40]
    assert got[0] == [(1, 41, 2.0), (2, 41, 2.0), (3, 1, 1.0), (4, 2, 1.0), (5, 3, 1.0)]
    assert got[20] == [(1, 41, 2.0), (2, 41, 2.0), (3, 0, 1.0), (4, 1, 1.0), (5, 2, 1.0)]
    assert got[40] == [(1, 41, 2.0), (2, 41, 2.0), (3, 0, 0.0), (4, 1, 0.0), (5, 2, 0.0)]
    same = lists(nearest(frame(spark, rows), F.col("vec_id") == 41, k=2))
    assert same == {41: [(1, 41, 8.0), (1, 41, 8.0), (2, 0, 2.0), (2, 0, 2.0)]}
    few = [(0, [1.0, 2.0, 3.0]), (20, [1.0, 0.0, 0.0]), (21, [0.0, 1.0, 0.0])]
    assert lists(nearest(frame(spark, few), F.col("vec_id") % 20 == 0)) == {0: [(1, 21, 2.0), (2, 20, 1.0)], 20: [(1, 0, 1.0), (2, 21, 0.0)]}
    assert nearest(frame(spark, few[:1]), F.col("vec_id") % 20 == 0).collect() == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1, 0, 0]), (1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [nan, 1, 0]), (6, [inf, 1, 0]), (7, [1, 2])]
    good = [(20, [1, 0, 0]), (40, [0, 1, 0]), (60, [1, 1, 1])]
    got = lists(nearest(frame(spark, odd + good), F.col("vec_id") % 20 == 0))
    assert {k: [x for _, x, _ in v] for k, v in got.items()} == {20: [60, 40], 40: [60, 20], 60: [20, 40]}
    assert nearest(frame(spark, odd), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(frame(spark, good), F.col("vec_id") == 1).collect() == []
    empty = nearest(frame(spark, []), F.col("vec_id") % 20 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_pigeonhole_radii():
    for radius in range(BITS + 1):
        for parts in (4, 8, 16):
            radii = Split(radius, parts).radii
            assert sum(r + 1 for r in radii) >= min(radius + 1, BITS)  # differing more in every substring is differing in more bits


def test_codes_keep_angles():
    """Codes of near vectors differ in fewer bits; learned rotations serve neighbours better than signs of the axes."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(2000, 32)) * np.linspace(2, 0.2, 32)
    coder = Coder.fit(data, float(np.sqrt((data**2).sum(axis=1)).max()))
    codes, asked = coder.codes(data, False), coder.codes(data[:50], True)
    apart = np.bitwise_count(asked[:, None] ^ codes)
    near = np.argsort(-(data[:50] @ data.T), axis=1)[:, :20]
    assert np.take_along_axis(apart, near, 1).mean() + 8 < apart.mean()
