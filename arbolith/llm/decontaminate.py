"""Benchmark decontamination: an FM-index per training shard, searched for benchmark windows.

A window is `window` consecutive words of a benchmark item, or the whole of a shorter item. A
task takes about 4 MB of documents as a shard, numbers its words by the benchmark's vocabulary
and indexes every run of such words that is long enough for the shortest window; a
window can't occur elsewhere, so nothing is lost. Backward search finds all windows at once,
sampled suffix positions locate every occurrence, and the covered spans are united.

Scale: documents are read once and never shuffled. The benchmark's windows are broadcast as arrays of word numbers, about as
large as its text. A benchmark of over `block_bytes` is cut into blocks of that size (an item stays whole), each a broadcast of its own.
A shard then numbers its own words, is indexed once, and is searched for one block after the other: a worker holds one block, an
executor's disk up to `pass_blocks` of them, 1 GB, the driver one at a time. Only each further GB of benchmark takes one
more pass, whose finds are kept by the text's hash in the shared folder and joined.

Null and empty texts have no words, on either side; an item without words is no item. Items with
equal texts are all named; an item with a null id is named "". Rows that repeat get the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import saved, skew_join, slices, text_or_empty, wide_hash
from arbolith.llm.fm_index import FMIndex

#: Lower-cases A-Z; ASCII other than letters and digits separates words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def benchmark_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]), equal for equal pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _window_numbers(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of `window` ids, equal for equal runs: pairs of runs half as long, and two that overlap at the end."""
    runs, width = ids, 1
    while 2 * width <= window:
        runs, width = _pairs(runs[: len(runs) - width], runs[width:]), 2 * width
    rest = window - width
    return _pairs(runs[: len(runs) - rest], runs[rest:]) if rest else runs


class Windows:
    """The distinct windows of some items: word numbers, places and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids = [[self.number.setdefault(w, len(self.number) + 1) for w in benchmark_words(text)] for _, text in items]
        sizes = np.array([len(x) for x in ids], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.words = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        # whole windows, alike if their runs are
        places = [np.arange(b, b + n - window + 1) for b, n in zip(begins.tolist(), sizes.tolist()) if n >= window]
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        owner = np.searchsorted(begins, at, "right") - 1  # items without words begin where the next one does
        runs = _window_numbers(self.words.astype(np.int64), window)[at] if len(at) else at
        _, first, which = np.unique(runs, return_index=True, return_inverse=True)
        pairs = np.unique(which * max(1, len(items)) + owner)
        # items that are shorter
        short: dict[tuple[int, ...], list[int]] = {}
        for k, own in enumerate(ids):
            if 0 < len(own) < window:
                short.setdefault(tuple(own), []).append(k)
        some = np.array([held[0] for held in short.values()], np.int64)
        self.first = np.concatenate([at[first], begins[some]])
        self.length = np.concatenate([np.full(len(first), window, np.int64), sizes[some]])
        counts = [*np.bincount(pairs // max(1, len(items)), minlength=len(first)), *map(len, short.values())]
        self.owner_ends = np.cumsum(counts, dtype=np.int64)
        self.owner_items = np.concatenate([pairs % max(1, len(items)), np.array([k for held in short.values() for k in held], np.int64)])
        #: Words of the shortest window.
        self.least = int(self.length.min()) if len(self.length) else 0

    def owners(self, window: int) -> list[str]:
        begin = int(self.owner_ends[window - 1]) if window else 0
        return [self.names[k] for k in self.owner_items[begin : int(self.owner_ends[window])].tolist()]


def runs_to_index(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero ids that are `least` long or longer."""
    inside = np.r_[False, ids > 0, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


class Shard:
    """The word sequences of some texts and one index of them, for the windows of any number of blocks.

    `number` gives words their numbers, 0 to those that no window holds; runs of fewer than `least` others aren't indexed.
    """

    def __init__(self, words: list[list[bytes]], number: dict[bytes, int], least: int):
        self.number, self.index = number, None
        ids = np.concatenate([np.array([*map(number.get, w, repeat(0)), 0], np.int64) for w in words])  # each text is followed by one 0
        starts, ends = runs_to_index(ids, least)
        if not len(starts):
            return
        sizes = ends - starts + 1  # a run and the 0 after it
        begins = np.cumsum(sizes) - sizes
        self.place = np.arange(sizes.sum()) + np.repeat(starts - begins, sizes)
        text = ids[self.place]
        text[begins + sizes - 1] = 0
        self.index = FMIndex(text, len(number))

    def search(self, windows: Windows, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the windows: window, place."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        words, live = windows.words, np.arange(len(windows.first))
        if self.number is not windows.number:  # by the shard's numbers; windows with words that it lacks can't occur
            words = np.array([0, *map(self.number.get, windows.number, repeat(0))], np.int64)[words]
            lacks = np.r_[0, np.cumsum(words == 0)]
            live = np.flatnonzero(lacks[windows.first + windows.length] == lacks[windows.first])
        for at in range(0, len(live) if self.index else 0, step):
            part = live[at : at + step]
            low, high = self.index.search(words, windows.first[part], windows.length[part])
            times = high - low
            which = np.repeat(part, times)
            rows = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
            found.append((which, self.place[self.index.locate(rows)]))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


def mark(texts: list[str | None], blocks: Sequence[Callable[[], Windows]]):
    """For each text: its number of words, the united spans of windows and the sorted items. Blocks are held one at a time."""
    words = [benchmark_words(t) for t in texts]
    shard = None
    if len(blocks) > 1:  # the shard's own numbers, so that one index serves all blocks
        own: dict[bytes, int] = {}
        for w in chain.from_iterable(words):
            own.setdefault(w, len(own) + 1)
        shard = Shard(words, own, 1)
    bounds = np.cumsum([0, *(len(w) + 1 for w in words)])
    covered = np.zeros(bounds[-1] + 1, np.int64)
    names: list[set[str]] = [set() for _ in words]
    for block in blocks:
        windows = block()
        which, at = (shard or Shard(words, windows.number, windows.least)).search(windows)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + windows.length[which], -1)
        owner = np.searchsorted(bounds, at, "right") - 1
        for x in np.unique(owner + which * len(words)).tolist():
            names[x % len(words)].update(windows.owners(x // len(words)))
    inside = np.r_[False, np.cumsum(covered) > 0]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    hits: list[list[dict]] = [[] for _ in words]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        hits[k].append({"first": a - int(bounds[k]), "last": b - int(bounds[k])})
    return [len(w) for w in words], hits, [sorted(x) for x in names]


def _taken(block: Broadcast, keep: bool) -> Windows:
    """A broadcast block, read from the executor's disk again at the next call unless `keep`."""
    windows = block.value
    if not keep:
        vars(block).pop("_value", None)
    return windows


def _search_shards(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """`rows` with _n_words, _hits and _items in place of _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [partial(_taken, b, len(blocks) == 1) for b in blocks]
        for batch in slices(batches, "_text", (4 if len(held) == 1 else 16) << 20):  # more texts for each reading of many blocks
            n, hits, names = mark(batch.column("_text").to_pylist(), held)
            more = {"_n_words": pa.array(n, pa.int64()), "_hits": pa.array(hits, SPAN), "_items": pa.array(names, pa.list_(pa.string()))}
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *more.values()], names=[*kept.schema.names, *more])

    found = "_n_words long, _hits array<struct<first:int,last:int>>, _items array<string>"
    return rows.mapInArrow(run, T.StructType([*rows.drop("_text").schema, *T.StructType.fromDDL(found)]))


def _united(spans: Column) -> Column:
    """Spans with those that overlap or touch united, by place."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        F.array_sort(spans),
        none,
        lambda done, s: F.when((F.size(done) == 0) | (s["first"] > last(done)["last"]), F.concat(done, F.array(s))).otherwise(
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(last(done)["first"].alias("first"), F.greatest(last(done)["last"], s["last"]).alias("last"))),
            )
        ),
    )


def _marked(rows: DataFrame, benchmark: DataFrame, item_id_col: str, item_text_col: str, window: int, block_bytes: int, pass_blocks: int) -> DataFrame:
    """`rows` (with _text) and _n_words, _hits, _items, _n_hit, without _text."""
    items = benchmark.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("name"), text_or_empty(item_text_col).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    passes = [range(k, min(k + pass_blocks, blocks)) for k in range(0, blocks, pass_blocks)]

    def windows(k: int) -> Broadcast:
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        found = Windows([(r.name, r.text) for r in part.collect()], window)  # about block_bytes
        return rows.sparkSession.sparkContext.broadcast(found)

    keys = wide_hash(F.coalesce("_text", F.lit("")), "_t")
    marked = _search_shards(rows.select("*", *keys) if len(passes) > 1 else rows, list(map(windows, passes[0])))
    if len(passes) > 1:
        texts = rows.select("_text", *keys)
        later = []
        for own in passes[1:]:
            taken = list(map(windows, own))
            later.append(saved(_search_shards(texts, taken).filter(F.size("_hits") > 0).select("_t1", "_t2", "_hits", "_items")))
        more = reduce(DataFrame.unionByName, later).groupBy("_t1", "_t2")  # at most `passes` unlike rows a text
        more = more.agg(F.flatten(F.collect_set("_hits")).alias("_h"), F.flatten(F.collect_set("_items")).alias("_i"))
        marked = skew_join(marked, more, ["_t1", "_t2"], "left").withColumns(
            {
                "_hits": F.when(F.col("_h").isNull(), F.col("_hits")).otherwise(_united(F.concat("_hits", F.col("_h")))),
                "_items": F.when(F.col("_i").isNull(), F.col("_items")).otherwise(F.array_sort(F.array_union("_items", F.col("_i")))),
            }
        )
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]).cast("long"))
    return marked.withColumn("_n_hit", n_hit)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = 16 << 20,
    pass_blocks: int = 64,
) -> DataFrame:
    """One row per input row: `id_col`, n_words, hits (united spans of word places), items (sorted names), n_hit."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    marked = _marked(rows, benchmark, item_id_col, item_text_col, window, block_bytes, pass_blocks)
    return marked.select(F.col(id_col), *(F.col(f"_{c}").alias(c) for c in ("n_words", "hits", "items", "n_hit")))


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = 16 << 20,
    pass_blocks: int = 64,
) -> DataFrame:
    """The rows of `docs` that are not contaminated, in one pass without a shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("_text", F.col(names[docs.columns.index(text_col)]).cast("string"))
    marked = _marked(rows, benchmark, item_id_col, item_text_col, window, block_bytes, pass_blocks)
    return marked.filter(~contaminated(F.col("_n_hit"), F.col("_n_words"))).select(*names).toDF(*docs.columns)
