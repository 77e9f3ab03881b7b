"""Nearest neighbours by inner product, by multi-index hashing of learned binary codes.

Vectors get one more component that makes their lengths equal (so the largest inner product is the smallest angle), are centred, turned to
their principal axes and rotated so that signs lose as little as possible (iterative quantization); the signs are a 64-bit code. Codes are cut into
m substrings. If two codes differ in at most r bits, then for radii r_j with sum r - m + 1 some substring j differs in at most r_j bits
(pigeonhole). So each substring is an index of its own: a query probes all its values within r_j bits, and what is found is every code within r
bits, each taken at the first substring that finds it. Those are ranked by their inner products in double precision.

The rotation is learned on at most `sample` vectors. r is the number of bits within which a share `recall` of the true neighbours of `trials` queries lie,
which one pass over all vectors finds; m is what makes least work at that r. A query that finds too few goes on with a larger radius, at last
with all bits. Vectors without structure (as directions drawn at random) need a radius at which most codes are near, so
most pairs are looked at; where neighbours are close, radii are small and few values are probed.

Scale: equal vectors are one entry with their k + 1 smallest ids, as no more of them can be in a result; a query's own row is taken out of k + 1
results. So a vector that a third of all rows hold is one entry, searched for once. Entries are dealt out by substring and leading bits of
its value, in chunks of a bounded number, so that a task holds one chunk of index while queries stream past. A query goes
to a chunk once, and a chunk returns its k + 1 best at most.

Vectors that are null, zero, not of the usual length or hold null or non-finite components take no part, nor do rows without an id. Rows with
equal id and vector are rows of their own. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import saved, skew_join

BITS = 64
RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "array<struct<neg:double,id:long,own:boolean>>"


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


@dataclass
class Coder:
    """Vectors to codes: (vector, missing length) - mean, times axes, signs."""

    longest: float
    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, rounds: int = 30, seed: int = 7) -> Coder:
        coder = cls(longest, np.zeros(sample.shape[1] + 1), np.zeros(0))
        data = coder.placed(sample)
        coder.mean = data.mean(axis=0)
        data = data - coder.mean
        rng = np.random.default_rng(seed)
        _, vectors = np.linalg.eigh(data.T @ data)
        axes = vectors[:, ::-1][:, :BITS]
        if axes.shape[1] < BITS:  # fewer dimensions than bits: more directions, drawn
            axes = np.c_[axes, rng.normal(size=(axes.shape[0], BITS - axes.shape[1])) / np.sqrt(axes.shape[0])]
        data = data @ axes
        turn, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(data @ turn >= 0, 1.0, -1.0).T @ data)
            turn = (left @ right).T
        coder.axes = axes @ turn
        return coder

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as points on the unit sphere in one more dimension."""
        scaled = vectors / self.longest
        rest = 1.0 - (scaled * scaled).sum(axis=1)
        return np.c_[scaled, np.sqrt(np.maximum(rest, 0.0))]

    def codes(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        if queries:  # of length one and without the further component, as scores of a query don't depend on its length
            lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            points = np.c_[vectors / np.maximum(lengths, 1e-300), np.zeros(len(vectors))]
        else:
            points = self.placed(vectors)
        signs = (points - self.mean) @ self.axes >= 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]


@dataclass(frozen=True)
class Split:
    """Codes cut into `parts` substrings of `width` bits with their radii; groups are the substrings' first `lead` bits."""

    radius: int
    parts: int
    lead: int = 0

    @property
    def width(self) -> int:
        return BITS // self.parts

    @property
    def radii(self) -> list[int]:
        """Of the substrings, with sum radius - parts + 1; -1 where nothing is probed."""
        each, more = divmod(self.radius - self.parts + 1, self.parts)
        return [min(max(each + (j < more), -1), self.width) for j in range(self.parts)]

    def part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def work(self, n: int) -> float:
        """Values probed and codes met for one query among `n` codes, if codes are spread evenly."""
        ball = [sum(comb(self.width, i) for i in range(r + 1)) for r in self.radii]
        return sum(b + n * b / 2**self.width for b in ball)


def best_split(radius: int, n: int, chunk: int) -> Split:
    parts = min((4, 8, 16), key=lambda m: Split(radius, m).work(n))
    lead = int(np.ceil(np.log2(max(n / chunk, 1))))
    return Split(radius, parts, min(lead, BITS // parts))


def _usable(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, v, ids): one row for each vector, with its k smallest ids."""
    order = Window.partitionBy("h1", "h2").orderBy("id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _encoded(entries: DataFrame, coder: Coder) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"))
            codes = [pa.array(coder.codes(vectors, queries).view(np.int64)) if len(vectors) else pa.array([], pa.int64()) for queries in (False, True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *codes], names=[*batch.schema.names, "code", "query_code"])

    return entries.mapInArrow(run, T.StructType([*entries.schema, *T.StructType.fromDDL("code long, query_code long")]))


def _radius(entries: DataFrame, k: int, recall: float, trials: int) -> int | None:
    """The number of bits within which the share `recall` of true neighbours lie; None without queries."""
    tried = entries.filter("asked").orderBy("h1", "h2").limit(trials).select("h1", "h2", "v", "query_code").collect()
    if not tried:
        return None
    queries = np.array([r.v for r in tried], np.float64)
    codes = np.array([r.query_code for r in tried], np.int64).view(np.uint64)
    keys = np.array([r.h1 for r in tried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                scores = queries @ matrix(part.column("v")).T
                scores[keys[:, None] == part.column("h1").to_numpy()] = -np.inf
                apart = np.bitwise_count(codes[:, None] ^ part.column("code").to_numpy().view(np.uint64)).astype(np.int64)
                joint = np.c_[kept[0], scores], np.c_[kept[1], apart]
                by = np.argpartition(-joint[0], k - 1, axis=1)[:, :k]
                kept = tuple(np.take_along_axis(x, by, 1) for x in joint)
        q, i = np.nonzero(kept[0] > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "score": pa.array(kept[0][q, i]), "apart": pa.array(kept[1][q, i])})

    found = entries.select("h1", "v", "code").mapInArrow(run, "q long, score double, apart long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "apart")
    near = sorted(r.apart for r in found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("apart").collect())
    return near[max(int(np.ceil(recall * len(near))) - 1, 0)] if near else 0


def _dealt(entries: DataFrame, split: Split, chunks: np.ndarray, queries: bool) -> DataFrame:
    """Entries, or queries, with the chunk (`g`) that they belong to, or search."""
    lead = split.lead
    first = np.r_[0, np.cumsum(chunks)]  # of a cell's chunks

    def near(tops: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, value) for all values of `lead` bits within `most` bits of a row's."""
        if most < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = np.array([sum(1 << b for b in bits) for n in range(min(most, lead) + 1) for bits in combinations(range(lead), n)], np.int64)
        return np.repeat(np.arange(len(tops)), len(masks)), (tops[:, None] ^ masks).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                codes = batch.column("query_code" if queries else "code").to_numpy().view(np.uint64)
                spread = batch.column("h2").to_numpy()
                for j, most in enumerate(split.radii):
                    tops = split.part(codes, j) >> (split.width - lead)
                    row, top = near(tops, most) if queries else (np.arange(len(tops)), tops)
                    if most < 0 or not len(row):
                        continue
                    cell = (j << lead) + top
                    many = chunks[cell]
                    if queries:  # all chunks of the cell
                        before = np.repeat(np.cumsum(many) - many, many)
                        row, cell = np.repeat(row, many), np.repeat(cell, many)
                        within = np.arange(len(row)) - before
                    else:
                        within = spread[row] % many
                    for a in range(0, len(row), 8192):
                        out = batch.take(pa.array(row[a : a + 8192]))
                        g = first[cell[a : a + 8192]] + within[a : a + 8192]
                        names = ["g", "part", "asks", *out.schema.names]
                        n = out.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(n, j, np.int32)), pa.array(np.full(n, queries)), *out.columns], names=names)

    return entries.mapInArrow(run, T.StructType([*T.StructType.fromDDL("g long, part int, asks boolean"), *entries.schema]))


class Chunk:
    """Entries of one chunk, by the value of their substring `j`."""

    def __init__(self, rows: pa.Table, split: Split, j: int):
        codes = rows["code"].to_numpy().view(np.uint64)
        values = split.part(codes, j)
        by = np.argsort(values, kind="stable")
        self.split, self.j, self.codes, self.vectors = split, j, codes[by], matrix(rows["v"].combine_chunks())[by]
        self.h1, self.h2 = rows["h1"].to_numpy()[by], rows["h2"].to_numpy()[by]
        ids = rows["ids"].combine_chunks()
        starts = ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]
        self.n_ids, self.first_id = np.diff(ids.offsets.to_numpy())[by], starts[by]
        self.ids = ids.flatten().to_numpy()
        self.least = self.ids[self.first_id]
        self.values, self.at = np.unique(values[by], return_index=True)
        self.ends = np.r_[self.at[1:], len(by)]

    def search(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """The k best rows found for each query of the batch, by score, then id."""
        split, j = self.split, self.j
        codes, queries = batch.column("query_code").to_numpy().view(np.uint64), matrix(batch.column("v"))
        mine = split.part(codes, j)
        slack = 1e-9 * np.maximum(np.abs(queries).sum(axis=1) * np.abs(self.vectors).max(), 1e-300)
        bar = np.full(len(queries), -np.inf)
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for value, a, b in zip(self.values, self.at, self.ends):
            asks = np.flatnonzero(np.bitwise_count(mine ^ value) <= split.radii[j])
            for lo in range(a, b, max(1, (1 << 20) // max(len(asks), 1))):
                hi = min(b, lo + max(1, (1 << 20) // max(len(asks), 1)))
                apart = codes[asks, None] ^ self.codes[None, lo:hi]
                scores = queries[asks] @ self.vectors[lo:hi].T
                q, e = np.nonzero((np.bitwise_count(apart) <= split.radius) & (scores >= (bar - slack)[asks, None]))
                xor = apart[q, e]
                fresh = np.ones(len(q), bool)  # no substring before finds the pair
                for i in range(j):
                    fresh &= np.bitwise_count(split.part(xor, i)) > split.radii[i]
                if fresh.any():
                    pending.append((asks[q[fresh]], e[fresh] + lo))
                    waiting += int(fresh.sum())
                if waiting > 100_000:
                    best, bar = self.ranked(queries, best, pending, bar, k)
                    pending, waiting = [], 0
        best, bar = self.ranked(queries, best, pending, bar, k)
        q, e, score = best
        if not len(q):
            return None
        # entries to rows: each has its smallest ids
        n = self.n_ids[e]
        flat = np.repeat(self.first_id[e] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        q, e, score, ids = np.repeat(q, n), np.repeat(e, n), np.repeat(score, n), self.ids[flat]
        by = np.lexsort([ids, -score, q])
        q, e, score, ids = q[by], e[by], score[by], ids[by]
        keep = first_of_each(q, k)
        q, e, score, ids = q[keep], e[keep], score[keep], ids[keep]
        own = (self.h1[e] == batch.column("h1").to_numpy()[q]) & (self.h2[e] == batch.column("h2").to_numpy()[q])
        asked, offsets = np.unique(q, return_index=True)
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids), pa.array(own)], names=["neg", "id", "own"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[offsets, len(q)], pa.int32()), found)
        taken = batch.take(pa.array(asked))
        return pa.RecordBatch.from_arrays([taken.column("h1"), taken.column("h2"), lists], names=["h1", "h2", "found"])

    def ranked(self, queries: np.ndarray, best: tuple, pending: list, bar: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
        """Best entries with what is pending, k for each query, and the scores that further ones have to reach."""
        if not pending:
            return best, bar
        q, e = (np.concatenate(x) for x in zip(*pending))
        score = np.concatenate([(queries[q[a : a + 65536]] * self.vectors[e[a : a + 65536]]).sum(axis=1) for a in range(0, len(q), 65536)])
        q, e, score = np.r_[best[0], q], np.r_[best[1], e], np.r_[best[2], score]
        by = np.lexsort([self.least[e], -score, q])
        q, e, score = q[by], e[by], score[by]
        keep = first_of_each(q, k)
        q, e, score = q[keep], e[keep], score[keep]
        bar = bar.copy()
        full = np.flatnonzero(np.bincount(q, minlength=len(bar)) == k)
        last = np.searchsorted(q, full, "right") - 1
        bar[full] = score[last]
        return (q, e, score), bar


def first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted `groups` are among the first k of theirs."""
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(np.r_[True, groups[1:] != groups[:-1]], at, 0)) < k if len(groups) else np.zeros(0, bool)


def _searched(index: DataFrame, asked: DataFrame, split: Split, k: int, chunk: int) -> DataFrame:
    """(h1, h2, found) for each query and chunk that has something within the radius."""
    cell = [F.lit(j << split.lead) + F.shiftrightunsigned("code", j * split.width + split.width - split.lead).bitwiseAND((1 << split.lead) - 1) for j in range(split.parts)]
    counts = index.select(F.explode(F.array(*cell)).alias("cell")).groupBy("cell").count().collect()  # at most parts << lead rows
    chunks = np.zeros(split.parts << split.lead, np.int64)
    for r in counts:
        chunks[r.cell] = -(-r["count"] // chunk)
    both = _dealt(index, split, chunks, False).unionByName(_dealt(asked, split, chunks, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, built = -1, [], None
        for big in batches:
            g, asks = big.column("g").to_numpy(), big.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (asks[1:] != asks[:-1])]) if len(g) else []
            for a, b in zip(cuts, [*cuts[1:], len(g)]):
                if g[a] != current:
                    current, held, built = g[a], [], None
                part = big.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if built is None and held:
                    built = Chunk(pa.Table.from_batches(held), split, part.column("part")[0].as_py())
                    held = []
                for c in range(0, part.num_rows, 512) if built else ():
                    if (out := built.search(part.slice(c, 512), k)) is not None:
                        yield out

    dealt = both.drop("asked").repartition("g").sortWithinPartitions("g", "asks")
    return dealt.mapInArrow(run, f"h1 long, h2 long, found {FOUND}")


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    recall: float = 0.97, sample: int = 10_000, trials: int = 128, chunk: int = 16_384,
) -> DataFrame:
    """For each row of `vectors` for which `asks` holds: RESULT, its k nearest other rows (all, if there are fewer), nearest first, ties by smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(asks, F.lit(False)).alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == usual.dim).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    n_rows = usual["count"]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(length)).first()[0]
    keys = rows.filter("ask").select("id", "h1", "h2")
    asked = keys.select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    entries = saved(_entries(rows, k + 1).join(asked, ["h1", "h2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    at_most = max(100, min(sample, (64 << 20) // (8 * usual.dim)))
    learned = np.array([r.v for r in entries.orderBy("h2", "h1").limit(at_most).select("v").collect()], np.float64)
    entries = saved(_encoded(entries, Coder.fit(learned, longest)))
    radius = _radius(entries, k, recall, trials)
    if radius is None:
        return spark.createDataFrame([], RESULT)
    n_entries, open_queries, done = entries.count(), entries.filter("asked"), []
    while True:
        split = best_split(radius, n_entries, chunk)
        found = _searched(entries, open_queries, split, k + 1, chunk).groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
        found = saved(found)
        enough = F.size("found") >= min(k + 1, n_rows)
        done.append(found.filter(enough) if radius < BITS else found)
        if radius >= BITS:
            break
        open_queries = saved(open_queries.join(done[-1].select("h1", "h2"), ["h1", "h2"], "left_anti"))
        if open_queries.isEmpty():
            break
        radius = min(BITS, max(2 * radius, 8))
    results = done[0]
    for more in done[1:]:
        results = results.unionByName(more)
    own = F.array_position(F.transform("found", lambda f: f["own"] & (f["id"] == F.col("id"))), True)
    others = F.filter("found", lambda f, i: i + 1 != own)
    return (
        skew_join(keys, results, ["h1", "h2"], "inner")
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.neg")).alias("score"))
    )
