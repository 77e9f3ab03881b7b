import heapq
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from arbolith.llm import queries
from arbolith.llm.sharding import _fill_bins, schedule_bins, shard_documents


def check(rows, texts, shards):
    """Slots have no gaps, copies stay together, sizes are nearly equal."""
    assert len(rows) == len(texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    of = {}
    for r in rows:
        assert of.setdefault((r.size, r.text_crc32), r.shard) == r.shard


def test_query_is_balanced_like_plain_scheduling(spark, small, sample):
    rows = queries.op4_sharding(spark, small).collect()
    check(rows, [(i, t) for i, t, _ in sample], 16)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    groups = Counter()
    for _, t, _ in sample:
        groups[t] += len(t.encode()) + 1
    heap = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert max(load.values()) <= 1.01 * max(heap)


def test_many_groups_in_one_bucket(spark, small, sample):
    rows = shard_documents(spark.read.parquet(f"{small}/documents.parquet"), shards=4, buckets=3, salts=2).collect()
    check(rows, [(i, t) for i, t, _ in sample], 4)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) < 1.15 * min(load.values())


def test_a_third_of_all_rows_in_one_group(spark):
    texts = [(i, "copy") for i in range(300)] + [(i, f"text {i}") for i in range(300, 900)]
    check(shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), buckets=8).collect(), texts, 16)


def test_odd_rows(odd, empty):
    check(shard_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], 16)
    assert shard_documents(empty).collect() == []
    carried = shard_documents(odd, carry=True)
    assert carried.columns == ["given_size" if c == "size" else c for c in odd.columns] + ["size", "text_crc32", "shard", "slot"]
    given = sorted(str(tuple(r)) for r in odd.collect())
    assert sorted(str(tuple(r)[: len(odd.columns)]) for r in carried.collect()) == given
    assert carried.count() == odd.count()


def test_bins_go_to_the_least_loaded_shard():
    assert schedule_bins([(0, 0, 5, 1), (0, 1, 4, 2), (1, 0, 3, 3), (1, 1, 3, 1)], 2) == [
        (0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 1, 2), (1, 1, 0, 1)
    ]


def test_cells_that_span_batches():
    rng = random.Random(1)
    rows = []
    for bucket in range(3):
        groups = sorted(((rng.randrange(1, 50), g) for g in range(rng.randrange(1, 9))), reverse=True)
        for size, g in groups:
            ahead = 0
            for salt in range(rng.randrange(1, 4)):
                rows.append((bucket, g, g, salt, ahead, size, 9, 2, 5))
                ahead += 2
    names = ["bucket", "g1", "g2", "salt", "ahead", "group_bytes", "group_rows", "cell_rows", "cell_bytes"]
    kinds = {"bucket": pa.int32(), "salt": pa.int32()}

    def placed(step):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names=names)
            for p in parts
        ]
        return [r for b in _fill_bins(4)(iter(batches)) for r in b.to_pylist()]

    whole = placed(1000)
    assert placed(1) == placed(2) == placed(3) == whole
    for r, (bucket, g, *_) in zip(whole, rows):
        assert r["bin"] == next(x["bin"] for x in whole if (x["bucket"], x["g1"]) == (bucket, g))


def longest_first(sizes, shards):
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return max(heap)


def test_loads_stay_near_plain_scheduling_with_skewed_sizes(spark):
    """Within the docstring's bound; with one bucket and no more groups than bins, exactly plain scheduling."""
    rng = random.Random(3)
    sizes = [int(20 / (1 - rng.random()) ** 0.8) for _ in range(3000)]
    texts = [(i, f"{i:05d}".ljust(n, "x")) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    whole = [len(t) + 1 for _, t in texts]
    best = longest_first(whole, 16)
    for buckets, slack in ((None, 1.0), (1, 1.0), (5, 1.01), (64, 1.02)):
        load = Counter()
        for r in shard_documents(table, buckets=buckets).collect():
            load[r.shard] += r.size
        assert sum(load.values()) == sum(whole)
        assert max(load.values()) <= slack * best
        assert max(load.values()) <= max(sum(whole) / 16 * (1 + 1 / 128) + max(whole), max(whole))


def test_null_and_equal_ids_in_one_group_are_spread(spark):
    """A third of all rows are one text under a null id, a third one text under one id; no cell holds many of them."""
    texts = [(None, "copy")] * 400 + [(7, "other copy")] * 400 + [(i, f"text {i}") for i in range(400)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for carry in (False, True):
        check(shard_documents(table, carry=carry).collect(), texts, 16)
    cells = Counter()
    rows = table.select("doc_id", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h")).collect()
    cells.update((r.doc_id, r.h % 1024) for r in rows if r.doc_id in (None, 7))
    assert max(cells.values()) <= 8


def test_buckets_follow_the_number_of_groups(spark):
    texts = [(i, f"text {i} " + "x" * (i % 50)) for i in range(2000)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shard_documents(table, bucket_groups=300, most_buckets=5).collect()
    check(rows, texts, 16)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.01 * longest_first([len(t) + 1 for _, t in texts], 16)


def test_groups_are_counted_not_their_cells(spark):
    """Few groups of very many rows lie in many cells, but they are few groups: plain longest-processing-time scheduling."""
    texts = [(i, f"text {i % 100} " + "x" * (37 * (i % 100) % 59)) for i in range(100_000)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), bucket_groups=100).collect()
    check(rows, texts, 16)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    sizes = Counter()
    for _, t in texts:
        sizes[t] += len(t) + 1
    assert max(load.values()) <= 1.01 * max(longest_first(list(sizes.values()), 16), sum(sizes.values()) / 16)
