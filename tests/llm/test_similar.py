import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from arbolith.llm.simhash import majority_bits
from arbolith.llm.similar import band_keys, bits_apart, one_per_similar, shingle_set, split_by_prefix, thinned, wanted_bits


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The ids that stay, of (id, text) rows without null ids."""
    sets, parent, holders = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for w in s or [None]:
            holders.setdefault(w, []).append(k)
    for a, s in enumerate(sets):
        for b in {k for w in s or [None] for k in holders[w] if k < a}:
            both = len(s & sets[b])
            if 5 * both >= 4 * (len(s) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_stage_equals_brute_force_jaccard(spark, small):
    """Copies with a few words changed: similar by Jaccard, yet over 4 bits apart."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        text = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300)))
        rows += [(3 * g, text), (3 * g + 1, edited(rng, text, 0.015)), (3 * g + 2, edited(rng, text, 0.05))]
    want = brute(rows)
    assert len(want) < 2.5 * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == want


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    stay = one_per_similar(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == want


def test_odd_rows(odd, empty):
    assert sorted(str(r.doc_id) for r in one_per_similar(odd).collect()) == sorted(["1", "4", "5", "7", "8", "None"])
    assert one_per_similar(empty).collect() == []


def test_keys_with_many_members_lose_no_link(spark):
    """Families of copies of copies, so that links form chains past the leader; keys thinned by leaders, cut into blocks, and both."""
    rng = random.Random(11)
    rows = []
    for g in range(4):
        text = " ".join(f"g{g}w{rng.randrange(4000)}" for _ in range(120))
        family = [text]
        for _ in range(40):
            family.append(edited(rng, rng.choice(family), rng.choice([0.002, 0.01, 0.03])))
        rows += [(100 * g + i, t) for i, t in enumerate(family)]
    rng.shuffle(rows)
    want = brute(rows)
    assert 4 <= len(want) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most, rounds in ((2048, 4), (10, 3), (10, 0), (4, 1)):
        assert sorted(r.doc_id for r in one_per_similar(docs, most=most, rounds=rounds).collect()) == want


def test_lookalikes_are_not_copied(spark):
    """Pages of one template: half of each is the same, half its own. A key of them makes about as many rows as it has, with all links."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for g in range(900):
        page = template + [f"p{g}x{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * g, " ".join(page)))
        if g % 10 == 0:  # a near copy
            page[150] = "other"
            rows.append((2 * g + 1, " ".join(page)))
    sets = [(i, np.unique(shingle_set(text, 5))) for i, text in rows]
    near = spark.createDataFrame([(7, i, bytearray(s.tobytes())) for i, s in sets], "key long, node long, hashes binary")
    edges, left = thinned(near, 80, most=100, rounds=4)
    assert left.count() <= 1.5 * len(rows)
    sizes = [r["count"] for r in left.groupBy("key").count().collect()]
    assert not sizes or max(sizes) <= 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want) == 900
    assert sorted(r.doc_id for r in one_per_similar(docs, most=100).collect()) == want


def test_no_text_is_shuffled_beyond_the_limit(spark):
    """With more wanted documents than may be broadcast, sets of those alone are shuffled, and the same documents stay."""
    rng = random.Random(13)
    rows = []
    for g in range(40):
        text = " ".join(f"w{rng.randrange(4000)}" for _ in range(100))
        rows += [(3 * g, text), (3 * g + 1, edited(rng, text, 0.01)), (3 * g + 2, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(r.doc_id for r in one_per_similar(docs, most_rows=5).collect()) == want
    wanted = spark.createDataFrame([(i,) for i in range(1000)], "x long")
    bits = wanted_bits(wanted, ["x"], 1 << 12)
    assert sum(bin(int(w)).count("1") for w in bits) > 800
    at = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 12)).alias("at")).toPandas()["at"].to_numpy()
    assert ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all()


def test_prefixes_lose_no_link(spark):
    """Every pair at the similarity shares a key after the split, whatever the sizes of sets."""
    rng = random.Random(14)
    sets = {}
    for i in range(200):
        base = rng.randrange(12)
        size = rng.randrange(1, 40)
        sets[i] = {base * 100 + x for x in range(size)} if rng.random() < 0.7 else {rng.randrange(10**6) for _ in range(size)}
    packed = [(1, i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in sets.items()]
    keys = {}
    for r in split_by_prefix(spark.createDataFrame(packed, "key long, node long, hashes binary"), 80).collect():
        keys.setdefault(r.node, set()).add(r.key)
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(pairs) > 100 and all(keys.get(a, set()) & keys.get(b, set()) for a, b in pairs)


def test_fingerprints_cannot_reach_the_similarity():
    """The reason for MinHash: at 0.8 more bits differ than blocks of a useful size allow."""
    assert 9 < bits_apart(0.8) < 10.5 and bits_apart(0.95) > 4.5


def test_fingerprints_find_what_shares_no_minhash_key(spark):
    """Texts at 0.8 whose MinHash keys all differ, with fingerprints 4 and 3 bits apart: their component of fingerprints joins them."""
    rows, found = [], [
        ("w67806 w3956 w76067 w62261 w23247 w75187 w91455 w60595 w213 w35250 w85326 w73561", "e26", "e27", 4),
        ("w80694 w13740 w48120 w37614 w4080 w4275 w83936 w424 w20942 w28131 w22431 w37393", "e3", "e6", 3),
    ]
    for k, (text, a, b, bits) in enumerate(found):
        x, y = (shingle_set(f"{text} {end}", 5) for end in (a, b))
        assert not set(band_keys(x)) & set(band_keys(y)) and (majority_bits(x) ^ majority_bits(y)).bit_count() == bits
        rows += [(10 * k, f"{text} {a}"), (10 * k + 1, f"{text} {b}"), (10 * k + 2, f"{text} other words that go on and on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert want == [0, 2, 10, 12]
    for most in (512, 1):
        assert sorted(r.doc_id for r in one_per_similar(docs, most=most).collect()) == want
