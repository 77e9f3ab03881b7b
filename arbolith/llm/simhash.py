"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

A text is lower-cased (A-Z), split into words and shingled; a bit of its 64-bit
fingerprint is 1 when it is set in over half of the shingles' XXH64 hashes. Two fingerprints
link when they differ in at most `distance` bits. The 64 bits are cut into `blocks` blocks:
a pair that close agrees on at least blocks - distance of them, so each fingerprint
is keyed by every choice of that many blocks, and only fingerprints that share a key are
compared. With 8 blocks and distance 4 a key holds 32 bits.

Scale: copies share a fingerprint, so only distinct fingerprints are keyed: the size of a
group of copies doesn't matter. A task streams its sorted keys; fingerprints under one key
are compared in numpy and come out as a spanning forest (fewer edges than members),
never as all pairs. A key with more than `MOST` members is cut again by blocks of the bits
that its members needn't share, which is exact too. Components grow by alternating stars
over tables in the shared checkpoint folder.

Texts without words (null, empty, white space) have fingerprint 0 and link like any other. A
component's id is its smallest non-null document id. Rows that repeat get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import bounded_join, saved, skew_join, slices, text_or_empty, wide_hash

#: Fingerprints under one key that are compared all at once.
MOST = 1024


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined shingles of a lower-cased text; of the whole sequence if it is shorter."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = 4) -> int:
    return majority_bits(shingle_hashes((text or "").encode().lower(), shingle))


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per input row: the columns of `keep`, and fp (the 64 bits as a signed long)."""
    columns = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints = np.array([simhash(t, shingle) for t in batch.column("_text").to_pylist()], np.uint64)
            kept = batch.drop_columns(["_text"])
            yield kept.append_column("fp", pa.array(prints.view(np.int64)))

    return columns.mapInArrow(run, T.StructType([*columns.drop("_text").schema, T.StructField("fp", T.LongType())]))


def block_masks(bits: list[int], blocks: int, shared: int) -> list[int]:
    """A mask for every choice of `shared` of the `blocks` blocks into which `bits` are cut."""
    cuts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    return [sum(choice) for choice in combinations(cuts, shared)]


def forest(prints: np.ndarray, distance: int, bits: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that join the distinct fingerprints (uint64) connected by links, fewer than there are fingerprints
    for each key; `bits` are those in which they can differ."""
    differ = int(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = [b for b in (range(64) if bits is None else bits) if differ >> b & 1]
    if len(prints) > MOST and len(bits) > 2 * distance:
        edges: list[tuple[int, int]] = []
        for mask in block_masks(bits, 2 * distance, distance):
            masked = prints & np.uint64(mask)
            order = np.argsort(masked, kind="stable")
            cuts = np.flatnonzero(np.diff(masked[order])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(order)]
            free = [b for b in bits if not mask >> b & 1]
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                edges += forest(prints[order[a:b]], distance, free)
        return edges
    edges, left = [], np.ones(len(prints), bool)
    for seed in range(len(prints)):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(prints ^ prints[at]) <= distance))
            left[near] = False
            todo += near.tolist()
            edges += [(at, x) for x in near.tolist()]
    return [(int(prints[a]), int(prints[b])) for a, b in edges]


def _link(distance: int):
    """Streams (key, fp) rows sorted by key and yields verified links within each key."""

    def one_key(prints: np.ndarray) -> list[tuple[int, int]]:
        return forest(np.unique(prints), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for batch in chain((b for b in batches if b.num_rows), [None]):
            if batch is None:
                batch = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["key", "fp"])
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            edges: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            first = int(ends[0]) if len(keys) and held_key == keys[0] else 0
            if first:
                held.append(prints[:first])
            if held and (first < len(keys) or not len(keys)):  # the key held from earlier batches is over
                edges += one_key(np.concatenate(held))
                held = []
            if first < len(keys):
                held_key, held = int(keys[-1]), [prints[starts[-1] :].copy()]
                inner = (starts >= first) & (ends - starts > 1) & (ends < len(keys))
                pairs = inner & (ends - starts == 2)
                a, b = prints[starts[pairs]], prints[starts[pairs] + 1]
                near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
                edges += zip(a[near].tolist(), b[near].tolist())
                for s, e in zip(starts[inner & ~pairs], ends[inner & ~pairs]):
                    edges += one_key(prints[s:e])
            if edges:
                both = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = 4, blocks: int = 8) -> DataFrame:
    """Links (a, b) that connect the distinct values of `fp`, of a saved table, within `distance` bits."""
    masks = block_masks(list(range(64)), blocks, blocks - distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choice = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed)])
    # each row becomes as many as there are masks: small partitions, which Spark doesn't unite as their number is given
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + prints.count() * len(masks) // 4_000_000)
    keyed = prints.select("fp").repartition(parts, "fp").select("fp", F.explode(choice).alias("c")).select(
        F.xxhash64(F.col("c.i"), F.col("fp").bitwiseAND(F.col("c.m"))).alias("key"), "fp"
    )
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(distance), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node that it reaches.

    Large-star and small-star steps in turn, each a shuffle of the edges, until nothing changes. Rounds grow with the logarithm of
    the longest path; if `most_rounds` don't do, it raises and drops nothing.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = skew_join(both.filter("b > a"), low, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(down, low, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # done when each node has one edge, down to a node that has none
        many = after.groupBy("a").count().filter("count > 1").limit(1)
        inner = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").select("a").limit(1)
        now = after
        if many.unionByName(inner.select("a", F.lit(0).cast("long").alias("count"))).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def roots(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """`nodes`, with one row for each value of fp, and root: the least fp that it reaches."""
    nodes = saved(nodes)
    found = components(links(nodes.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 8
) -> DataFrame:
    """One row per input row: `id_col`, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = saved(fingerprints(docs, [F.col(id_col).alias("id")], text_col, shingle))
    rooted = saved(roots(rows.groupBy("fp").agg(F.min("id").alias("least_id")), distance, blocks))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = skew_join(rooted, least, ["root"], "inner").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each row of `stay`: id, and the text's hash t1, t2.

    Ids and hashes decide which rows go. The texts are read once more and stay where they are, unless too many rows go to broadcast
    their hashes; only rows of which one of several equal ones stays are shuffled in any case.
    """
    keys, text = ["_key", "_k1", "_k2"], wide_hash(text_or_empty(text_col), "t")
    as_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  # so that null ids are joined
    names = [f"c{k}" for k in range(len(docs.columns))]
    hashes = [as_key(id_col).alias("_key"), *(h.alias(k) for h, k in zip(text, keys[1:]))]
    named = docs.select(*hashes, *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    first = stay.toDF("_id", "_t1", "_t2").select(as_key("_id").alias("_key"), F.col("_t1").alias("_k1"), F.col("_t2").alias("_k2"), F.lit(True).alias("_one"))
    marks = saved(
        skew_join(docs.select(*hashes).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), first, keys, "left")
        .filter("_one is null or _n > 1")
        .select(*keys, F.coalesce("_one", F.lit(False)).alias("_one"))
    )
    kept = bounded_join(named, marks, keys, "left_anti")
    several = marks.filter("_one").drop("_one")
    if not several.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        kept = kept.unionByName(bounded_join(named, several, keys, "left_semi").withColumn("_nth", nth).filter("_nth = 1").drop("_nth"))
    return kept.select(*names).toDF(*docs.columns)


def one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 8
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the one with the smallest id (null last) stays."""
    text = wide_hash(text_or_empty(text_col), "t")
    rows = saved(fingerprints(docs, [F.col(id_col).alias("id"), *text], text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2")).alias("first")
    rooted = roots(rows.groupBy("fp").agg(first), distance, blocks)
    stay = rooted.groupBy("root").agg(F.min("first").alias("k")).select("k.id", "k.t1", "k.t2")
    return keep_first(docs, stay, id_col, text_col)
