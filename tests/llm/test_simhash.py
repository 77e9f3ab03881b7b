import random

import numpy as np
import pyarrow as pa
import xxhash

from arbolith.llm import queries
from arbolith.llm.simhash import _link, components, forest, near_duplicates, one_per_group


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints))


def test_query_equals_brute_force(spark, small, sample):
    got = queries.op1_simhash(spark, small).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute_components([(i, t) for i, t, _ in sample])


def test_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute_components(
        [(r.doc_id, r.text) for r in odd.collect()]
    )
    assert near_duplicates(empty).collect() == []


def test_dense_key_is_cut_exactly():
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centre for _ in range(900)}
    prints = np.array(sorted(prints), np.uint64)
    assert len(prints) > 1024

    def parts(edges):
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = {}
        for p in parent:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    every = [
        (int(prints[i]), int(x)) for i in range(len(prints)) for x in prints[np.bitwise_count(prints ^ prints[i]) <= 4]
    ]
    assert parts(forest(prints, 4)) == parts(every)


def test_one_per_group(spark, odd, empty, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for rows in (docs, odd):
        want = {c for *_, c in brute_components([(r.doc_id, r.text) for r in rows.collect()])}
        stay = one_per_group(rows)
        assert stay.columns == rows.columns
        assert sorted(map(str, (r.doc_id for r in stay.collect()))) == sorted(map(str, want))
    assert one_per_group(empty).collect() == []


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000, 1002: 1000}


def test_keys_that_span_batches():
    rng = random.Random(9)
    for _ in range(200):
        rows = sorted((rng.randrange(4), rng.getrandbits(3) | rng.choice([0, 0xFF00])) for _ in range(rng.randrange(1, 25)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(6))})
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows[a:b]], pa.int64()), pa.array([f for _, f in rows[a:b]], pa.int64())], names=["key", "fp"]
            )
            for a, b in zip(cuts, cuts[1:])
        ]
        batches.insert(rng.randrange(len(batches) + 1), batches[0].slice(0, 0))
        edges = {frozenset(e) for b in _link(2)(iter(batches)) for e in zip(*(c.to_pylist() for c in b.columns))}
        near = {
            frozenset((f, g)) for k, f in rows for m, g in rows if k == m and f != g and (f ^ g).bit_count() <= 2
        }
        assert edges <= near

        def groups(links):
            parts = {f: {f} for _, f in rows}
            for e in links:
                a, b = e
                both = parts[a] | parts[b]
                for x in both:
                    parts[x] = both
            return {frozenset(p) for p in parts.values()}

        # within each key the edges connect what the links connect; over all keys then too
        assert groups(edges) == groups(near)
