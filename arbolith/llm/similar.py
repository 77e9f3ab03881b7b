"""Near-dedup by similarity: SimHash components and MinHash keys find candidates, shingle sets decide, components follow.

A text is lower-cased (A-Z), split into words and shingled as for SimHash. Two texts link when the Jaccard
similarity of their sets of shingles is `percent` hundredths or more. Sets have fingerprints, which link within `distance` bits and make components as in
`simhash`; the members of one are compared by their whole sets, so no link is false.

Fingerprints don't reach all such pairs: at 0.8 two texts differ in some 10 of 64 bits and often in 16 (`bits_apart` gives the expectation), and blocks that
every such pair shares would have 3 bits each. For the rest, 64 MinHash values make 16 keys of 4, and sets that share a key are compared too. A pair of
similarity s shares no key with a chance of (1 - s^4)^16: 0.0003 at 0.8, under 0.000001 at 0.9; it is lost only if it lies in no component of fingerprints either.

Scale: texts with one set of shingles are one node. Keys are 136 bytes a node; sets are made only for nodes that share a
key with others, from one text each, and shuffled once by key; keys with the same members are compared once. A key's members are compared in one task, which holds their
sets, `most` of them; they come out as a spanning forest (fewer edges than members). A key with more members is thinned first: all
are compared with one of them, the leader, in as many tasks as Spark cuts the key into. 1 - Jaccard is a metric, so
of those that link to the leader only such as are nearly as far from it as the nearest member that doesn't link can have
a link that the leader doesn't imply, and the others are left out: near copies of one text are gone after a round. Members that are alike but less
than that, as pages of one template are, stay. Two sets that link share one of the first |x| - ceil(s |x|) + 1 of their shingles in any common order; by
rarity within the key, most sets' first shingles are their own, and sets without a shared one leave. The others are split by the shingles that they share
there, which hold few members; a split that is too large goes on with a further leader. What is still too large after `rounds` is compared block by block, each
pair of blocks in one task. Nothing is lost by any of these.

A document's text stays where it is. Sets are made where the text lies, for those documents only that a bitmap of the wanted ones lets pass, and they are what
is shuffled; the bitmap has 16 MB at most.

Texts without words are alike. Of each component the row with the smallest id (null last) stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import bounded_join, saved, skew_join, slices, text_or_empty, wide_hash
from arbolith.llm.simhash import components, keep_first, majority_bits, roots, shingle_hashes

BANDS, ROWS = 16, 4
_RANDOM = np.random.default_rng(17)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode().lower(), shingle))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of MinHash values; none without hashes."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * FACTORS + SHIFTS
        least = np.minimum(least, mixed.min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row per input row: id, t1 and t2 (the text's hash), node (the hash of its shingles), fp (their fingerprint) and keys."""
    columns = docs.select(
        F.col(id_col).alias("id"), *wide_hash(text_or_empty(text_col), "t"), F.col(text_col).cast("string").alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingle_set(t, shingle) for t in batch.column("_text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            kept = batch.drop_columns(["_text"]).append_column("node", pa.array(nodes))
            yield kept.append_column("fp", pa.array(prints)).append_column("keys", keys)

    more = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return columns.mapInArrow(run, T.StructType([*columns.drop("_text").schema, *more]))


def print_keys(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(node, key): nodes (node, fp) whose fingerprints reach each other within `distance` bits share a key."""
    rooted = roots(nodes.select("fp").distinct(), distance, blocks)
    return saved(skew_join(nodes, rooted, ["fp"], "inner").select("node", F.xxhash64(F.lit("fp"), "root").alias("key")))


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int, most_rows: int) -> DataFrame:
    """key, node and hashes (the bytes of its sorted shingle hashes) for `wanted` (node, keys, key_id, t1, t2) from texts (key_id, t1, t2, text)."""
    named = ["key_id", "t1", "t2"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        bits = bitmap.value if bitmap else None
        for batch in slices(batches, "text"):
            if bits is not None:
                at = batch.column("at").to_numpy()
                batch = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            fresh = []
            for i, own in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())):
                if own not in seen:
                    seen.add(own)
                    fresh.append(i)
            rows = batch.take(pa.array(fresh, pa.int32()))
            made = [shingle_set(t, shingle).tobytes() for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), pa.array(made, pa.binary())], names=[*kept, "hashes"])

    if wanted.count() <= most_rows:
        kept, bitmap = ["node", "keys"], None
        found = texts.join(F.broadcast(wanted), named).select("node", "keys", "t1", "t2", "text").mapInArrow(sets, "node long, keys array<long>, hashes binary")
        return found.select(F.explode("keys").alias("key"), "node", "hashes")
    bits = wanted_bits(wanted, named)
    kept, bitmap = named, texts.sparkSession.sparkContext.broadcast(bits)
    at = F.pmod(F.xxhash64(*named), F.lit(32 * len(bits))).alias("at")
    found = texts.select(*named, at, "text").mapInArrow(sets, "key_id string, t1 long, t2 long, hashes binary")
    return found.join(wanted, named).select(F.explode("keys").alias("key"), "node", "hashes")


def split_by_prefix(near: DataFrame, percent: int) -> DataFrame:
    """(key, node) with more and smaller keys, so that any two nodes of a key of `near` (key, node, hashes) that link share one."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(iter([batch]), "hashes", 1 << 20):
                sets = [np.frombuffer(h, np.int64) for h in some.column("hashes").to_pylist()]
                lengths = np.array([len(x) for x in sets], np.int64)
                ids = [pa.array(np.repeat(some.column(n).to_numpy(), lengths)) for n in ("key", "node")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.repeat(lengths, lengths)), pa.array(np.concatenate(sets))], names=["key", "node", "size", "shingle"])

    held = saved(near.mapInArrow(unpacked, "key long, node long, size long, shingle long"))
    # shingles that one member alone has come first of all, and link nobody
    counts = held.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("key", "node")
    shared = skew_join(held, counts, ["key", "shingle"], "inner").withColumn("shared", F.count(F.lit(1)).over(own))
    # of size - ceil(s * size) + 1 shingles, size - shared are the member's own
    first = F.col("shared") - F.ceil(F.col("size") * percent / 100 - 1e-9) + 1
    rank = F.row_number().over(own.orderBy("n", "shingle"))
    prefix = saved(shared.withColumn("first", first).filter("first > 0").withColumn("rank", rank).filter("rank <= first").select(F.xxhash64("key", "shingle").alias("key"), "node", F.col("key").alias("from")))
    return skew_join(prefix, distinct_keys(prefix), ["key"], "inner")


def distinct_keys(bands: DataFrame) -> DataFrame:
    """Of the keys of (key, node) with the same members, two at least, one."""
    return (
        bands.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key")
    )


def wanted_bits(wanted: DataFrame, keys: list[str], bits: int = 1 << 27) -> np.ndarray:
    """A bitmap over a hash of `keys`: a bit for each row of `wanted`."""
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    bit = F.bit_or(F.expr("shiftleft(1L, cast(at % 32 AS int))")).alias("set")
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(bit)
    out = np.zeros(bits // 32, np.uint32)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["set"].to_numpy().astype(np.uint32)
    return out


def similar(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join the nodes connected by links, fewer than there are nodes."""
    sizes, edges = np.array([len(s) for s in sets], np.int64), []
    left = np.arange(len(sets))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            ends = np.cumsum(sizes[left])
            hits = np.cumsum(np.isin(np.concatenate([sets[i] for i in left]), sets[at]))[ends - 1]
            common = np.diff(hits, prepend=0)
            near = 100 * common >= percent * (sizes[left] + sizes[at] - common)
            todo += left[near].tolist()
            edges += [(nodes[at], nodes[x]) for x in left[near]]
            left = left[~near]
    return edges


def _link(percent: int):
    """Streams (key, node, hashes) rows sorted by key and node and yields links within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, nodes, sets = None, [], []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            rows = zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), batch.column("hashes").to_pylist())
            for key, node, hashes in rows:
                if key != held_key:
                    edges += similar(nodes, sets, percent)
                    held_key, nodes, sets = key, [], []
                elif node == nodes[-1]:
                    continue  # made by two tasks
                nodes.append(node)
                sets.append(np.frombuffer(hashes, np.uint64))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in zip(*edges)], names=["a", "b"])
        if edges := similar(nodes, sets, percent):
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in zip(*edges)], names=["a", "b"])

    return run


def bits_apart(jaccard: float, bits: int = 64) -> float:
    """Bits in which SimHash fingerprints of two equally large sets are expected to differ."""
    return bits * math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def _to_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = []
        for hashes, lead in zip(batch.column("hashes").to_pylist(), batch.column("lead_hashes").to_pylist()):
            a, b = np.frombuffer(hashes, np.uint64), np.frombuffer(lead, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            far.append(1 - common / (len(a) + len(b) - common))
        yield batch.drop_columns(["lead_hashes"]).append_column("far", pa.array(far, pa.float64()))


def in_blocks(large: DataFrame, most: int) -> DataFrame:
    """(key, node, hashes) with a key for each pair of blocks of a key of `large` (key, node, hashes, n), so that any two members share one of `most` members or so."""
    blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return large.select(F.explode(others).alias("key"), "node", "hashes")


def cut(large: DataFrame, percent: int, most: int) -> DataFrame:
    """(key, node, hashes) of keys that leaders don't thin, with about `most` members a key: in blocks, but first split by prefixes if blocks would copy each set over 16 times."""
    huge = saved(large.filter(F.col("n") > 8 * most))
    if huge.isEmpty():
        return in_blocks(large, most)
    split = split_by_prefix(huge, percent).groupBy("from", "node").agg(F.collect_list("key").alias("keys"))
    sets = huge.select(F.col("key").alias("from"), "node", "hashes").join(split, ["from", "node"])
    parts = saved(sets.select(F.explode("keys").alias("key"), "node", "hashes"))
    sizes = saved(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    small = bounded_join(parts, sizes.select("key"), ["key"], "left_anti")
    return in_blocks(large.filter(F.col("n") <= 8 * most), most).unionByName(small).unionByName(in_blocks(bounded_join(parts, sizes, ["key"], "inner"), most))


def thinned(near: DataFrame, percent: int, most: int, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """Links (a, b) found on the way, or None, and `near` (key, node, hashes) with at most `most` members a key.

    The members of a key that stay too many are dealt to blocks; a key is then one of a pair of blocks.
    """
    reach, slack = 1 - percent / 100, 1e-9
    edges: list[DataFrame] = []
    done: list[DataFrame] = []
    before = None
    for k in range(rounds + 1):
        sizes = near.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        # a leader that takes hardly anybody away won't be followed by one that does
        stuck = F.lit(k == rounds) if before is None else F.lit(k == rounds) | F.coalesce(F.col("n") > 0.9 * F.col("before"), F.lit(False))
        sizes = saved((sizes if before is None else sizes.join(before, "key", "left")).select("key", "n", stuck.alias("stuck")))
        if sizes.isEmpty():
            done.append(near)
            break
        done.append(bounded_join(near, sizes.select("key"), ["key"], "left_anti"))
        large = bounded_join(near, sizes, ["key"], "inner")  # members stay dealt as they are
        done.append(cut(large.filter("stuck").drop("stuck"), percent, most))
        large, before = large.filter("not stuck").drop("stuck"), sizes.select("key", F.col("n").alias("before"))
        if sizes.filter("not stuck").isEmpty():
            break
        leads = saved(large.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("lead"), F.col("hashes").alias("lead_hashes")), F.xxhash64("node", F.lit(k))).alias("l")))
        leads = leads.select("key", "l.lead", "l.lead_hashes")
        few = (leads.agg(F.sum(F.octet_length("lead_hashes"))).first()[0] or 0) <= 64 << 20
        measured = large.drop("n").join(F.broadcast(leads), "key") if few else skew_join(large.drop("n"), leads, ["key"], "inner")
        measured = measured.select("key", "node", "hashes", "lead", "lead_hashes")
        measured = saved(measured.mapInArrow(_to_leader, "key long, node long, hashes binary, lead long, far double"))
        linked = F.col("far") <= reach + slack
        edges.append(saved(measured.filter(linked & (F.col("node") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("node").alias("b"))))
        nearest = measured.groupBy("key").agg(F.min(F.when(~linked & (F.col("far") <= 2 * reach + slack), F.col("far"))).alias("nearest"))
        left = bounded_join(measured, saved(nearest), ["key"], "inner").filter(~linked | (F.col("far") >= F.col("nearest") - reach - slack))
        near = saved(left.select("key", "node", "hashes"))
    return reduce(DataFrame.unionByName, edges) if edges else None, reduce(DataFrame.unionByName, done)


def one_per_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    most: int = 512,
    rounds: int = 4,
    most_rows: int = 200_000,
    distance: int = 4,
    blocks: int = 8,
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the one with the smallest id (null last) stays. `most_rows` bounds what is broadcast."""
    rows = keyed(docs, id_col, text_col, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2", "fp", "keys")).alias("first")
    nodes = saved(rows.groupBy("node").agg(first))
    groups = print_keys(nodes.select("node", "first.fp"), distance, blocks)
    bands = nodes.select("node", F.explode("first.keys").alias("key")).unionByName(groups)
    members = saved(skew_join(bands, distinct_keys(bands), ["key"], "inner"))
    as_key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key_id")
    texts = docs.select(as_key, *wide_hash(text_or_empty(text_col), "t"), text_or_empty(text_col).alias("text"))
    first_row = nodes.select("node", F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("key_id"), "first.t1", "first.t2")

    def with_sets(some: DataFrame) -> DataFrame:
        """key, node and hashes for (key, node) rows; of the documents of a node one is read."""
        wanted = saved(some.groupBy("node").agg(F.collect_list("key").alias("keys")).join(first_row, "node"))  # 17 keys at most
        return shingle_sets(texts, wanted, shingle, most_rows)

    large = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"))
    if large.isEmpty():
        found, near = None, with_sets(members)
    else:
        found, near = thinned(saved(with_sets(bounded_join(members, large, ["key"], "left_semi"))), percent, most, rounds)
        near = with_sets(bounded_join(members, large, ["key"], "left_anti")).unionByName(near)
    edges = near.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_link(percent), "a long, b long")
    rooted = nodes.join(components(edges if found is None else edges.unionByName(found)), "node", "left")
    stay = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("k")).select("k.id", "k.t1", "k.t2")
    return keep_first(docs, stay, id_col, text_col)
