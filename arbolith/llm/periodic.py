"""Periodic runs of words: stretches that repeat with a period, and texts with each run cut down to its first period.

A run is a stretch of consecutive words with smallest period q, of at least max(`least_words`, 2 q) words, that no neighbouring word
extends. The words of a text are numbered and sorted into a suffix array. Kruskal's method takes its pairs of neighbours
by descending common prefix and unites their classes; a class keeps its positions in order. When two classes meet at a prefix of
length l, the positions that become adjacent have a common prefix of exactly l, so a distance d <= l makes the words
from the first position on, d + l of them, a stretch of period d that can't be extended to the right. Each run is seeded this way
at its first word, and d is then its smallest period: a shorter one would have put another position of the class in between.

Scale: one pass without a shuffle; a task sorts the texts of about 1 MB at a time. Only prefixes of half of `least_words` or
more are united, so that few positions of ordinary text take part. A position moves into a larger class at most log n times. Memory
is linear in the longest text.

Null and empty texts have no words and no runs. Rows that repeat get the same answer each; no column but the id and the text is read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from arbolith.llm.common import slices
from arbolith.llm.quality import numbered, pieces
from arbolith.llm.suffixes import previous_prefixes

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FIELDS = {"runs": RUNS, "collapsed": pa.string()}


class Places:
    """An ordered set of positions, in blocks of at most `BLOCK`."""

    BLOCK = 1024
    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, place: int):
        self.blocks, self.lasts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int, int]:
        """The positions before and after the new one; -1 where there is none."""
        at = bisect_left(self.lasts, place)
        if at == len(self.blocks):  # behind all others
            block = self.blocks[-1]
            before, after = block[-1], -1
            block.append(place)
            at -= 1
        else:
            block = self.blocks[at]
            k = bisect_left(block, place)
            after = block[k]
            before = block[k - 1] if k else self.lasts[at - 1] if at else -1
            block.insert(k, place)
        self.lasts[at] = block[-1]
        self.size += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.lasts[at : at + 1] = [block[half - 1], block[-1]]
        return before, after


def runs_of(ids: np.ndarray, least_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `ids`, by start, then period. Each text in it ends with a number of its own."""
    before, common = previous_prefixes(ids)
    at = np.flatnonzero(common >= (least_words + 1) // 2)
    at = at[np.argsort(-common[at], kind="stable")]
    live, flat = np.unique(np.concatenate([at, before[at]]), return_inverse=True)
    firsts, seconds, prefixes = flat[: len(at)].tolist(), flat[len(at) :].tolist(), common[at].tolist()
    places = live.tolist()
    parent = list(range(len(places)))
    classes: list[Places | None] = [None] * len(places)
    seeds: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, prefix in zip(firsts, seconds, prefixes):
        a, b = root(a), root(b)
        large, small = classes[a] or Places(places[a]), classes[b] or Places(places[b])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b], classes[a], classes[b] = a, large, None
        last, pending = -1, -1  # the smaller class's position before, and the position behind it
        for place in small:
            if 0 <= pending < place and pending - last <= prefix:
                seeds.append((last, pending - last, prefix))
            left, pending = large.add(place)
            if left > last and left >= 0 and place - left <= prefix:
                seeds.append((left, place - left, prefix))
            last = place
        if pending >= 0 and pending - last <= prefix:
            seeds.append((last, pending - last, prefix))
    if not seeds:
        return []
    start, period, prefix = np.array(seeds, np.int64).T
    whole = (period + prefix >= least_words) & (ids[start - 1] != ids[start + period - 1])  # begins where no word before extends it
    start, length, period = start[whole], (period + prefix)[whole], period[whole]
    by = np.lexsort([period, start])
    return list(zip(start[by].tolist(), length[by].tolist(), period[by].tolist()))


def find_runs(texts: list[np.ndarray], least_words: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each sequence of word numbers."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, starts, owners, used, at = [], [], [], 0, 0
    for i, own in enumerate(texts):
        if len(own) < least_words:
            continue
        ids += [own + used, np.array([used + int(own.max()) + 1], np.int32)]  # texts share no number, so no class
        used += int(own.max()) + 2
        starts.append(at)
        owners.append(i)
        at += len(own) + 1
    if ids:
        bounds = np.array(starts)
        for start, length, period in runs_of(np.concatenate(ids), least_words):
            k = int(np.searchsorted(bounds, start, "right")) - 1
            found[owners[k]].append((start - starts[k], length, period))
    return found


def collapsed(raw: bytes, n: int, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text but for those that a run holds after its first period, joined by spaces."""
    change = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stays = np.cumsum(change[:n]) == 0
    parts, at = [], 0
    for piece in pieces(raw):
        words = piece.split()
        kept = stays[at : at + len(words)]
        at += len(words)
        parts.append(b" ".join(words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k]))
    return b" ".join(p for p in parts if p).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 12) -> DataFrame:
    """One row per input row: `id_col`, runs (array of start, length, period in words, by start, then period) and collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raws = [t.encode() for t in batch.column("text").fill_null("").to_pylist()]
            ids = [numbered(raw)[0] for raw in raws]
            found = find_runs(ids, least_words)
            texts = [collapsed(raw, len(own), runs) for raw, own, runs in zip(raws, ids, found)]
            flat = [np.array([r[k] for runs in found for r in runs], np.int64) for k in range(3)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(RUNS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), runs, pa.array(texts, pa.string())], names=["id", *FIELDS])

    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = from_arrow_schema(pa.schema(list(FIELDS.items())))
    return columns.mapInArrow(run, T.StructType([columns.schema["id"], *fields])).withColumnRenamed("id", id_col)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of those the one with the smallest start, then period; null if there is none."""
    return F.aggregate(
        runs,
        F.lit(None).cast(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),
    )
