"""BLAKE3 as the published specification has it, computed with numpy over all chunks at once, and over many tasks for one file.

A content is cut into chunks of 1 KiB, each hashed to a chaining value; values are merged in pairs, level by level, an odd last one going up as it is, until the root. So a
part that begins at a multiple of its size, a power of two chunks, is a subtree: its value can be made by itself, and the parts' values are merged in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, BLOCK = 1024, 64
#: Fixed values of the specification: initial words, the order of message words from round to round, and flags.
INITIAL = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
START, END, PARENT, ROOT = 1, 2, 4, 8
ROUNDS = 7
#: The words that each quarter of a round mixes: columns, then diagonals.
MIXED = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compressed(values: np.ndarray, blocks: np.ndarray, counters: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8 rows) after one block (16 rows) each; a column is one compression."""
    n = values.shape[1]
    state = np.empty((16, n), np.uint32)
    state[:8], state[8:12] = values, INITIAL[:4, None]
    state[12], state[13] = counters & np.uint64(0xFFFFFFFF), counters >> np.uint64(32)
    state[14], state[15] = lengths, flags
    words = list(range(16))
    for _ in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(MIXED):
            for word, left, right in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                state[a] += state[b] + blocks[word]
                state[d] = _turned(state[d] ^ state[a], left)
                state[c] += state[d]
                state[b] = _turned(state[b] ^ state[c], right)
        words = [words[i] for i in ORDER]
    return state[:8] ^ state[8:]


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes (a row a block) as columns of 16 words."""
    return np.ascontiguousarray(data.reshape(-1, BLOCK)).view("<u4").T


def chunk_values(content: bytes, first: int = 0, root: bool = False) -> np.ndarray:
    """The chaining value of each chunk (8 rows), the first of which has the number `first`. `root`: the content is one chunk and no more."""
    raw = np.frombuffer(content, np.uint8)
    n = max(1, -(-len(raw) // CHUNK))
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(raw)] = raw
    blocks = padded.reshape(n, CHUNK // BLOCK, BLOCK)
    sizes = np.minimum(CHUNK, len(raw) - CHUNK * np.arange(n))
    numbers = np.uint64(first) + np.arange(n, dtype=np.uint64)
    values = np.repeat(INITIAL[:, None], n, axis=1)
    for k in range(CHUNK // BLOCK):
        live = np.flatnonzero((sizes > k * BLOCK) | (k == 0))
        ends = sizes[live] <= (k + 1) * BLOCK
        flags = np.where(ends, END, 0) | (START if k == 0 else 0) | np.where(ends & root, ROOT, 0)
        lengths = np.clip(sizes[live] - k * BLOCK, 0, BLOCK)
        values[:, live] = compressed(values[:, live], _words(blocks[live, k]), numbers[live], lengths, flags)
    return values


def merged(values: np.ndarray, root: bool) -> np.ndarray:
    """One value from those of subtrees that follow each other; with `root` the digest's words."""
    while values.shape[1] > 1:
        pairs = values.shape[1] // 2
        blocks = np.concatenate([values[:, 0 : 2 * pairs : 2], values[:, 1 : 2 * pairs : 2]])
        last = root and values.shape[1] == 2
        flags = np.full(pairs, PARENT | (ROOT if last else 0))
        made = compressed(np.repeat(INITIAL[:, None], pairs, axis=1), blocks, np.zeros(pairs, np.uint64), np.full(pairs, BLOCK), flags)
        values = np.concatenate([made, values[:, 2 * pairs :]], axis=1)
    return values


def part_value(content: bytes, first: int, only: bool) -> bytes:
    """The value of a part that begins with chunk `first`; of a content that is `only` this part, its digest."""
    values = chunk_values(content, first, root=only and len(content) <= CHUNK)
    return merged(values, root=only)[:, 0].astype("<u4").tobytes()


def joined(parts: list[bytes]) -> str:
    """The digest, in hexadecimal, from the values of all parts of a content."""
    if len(parts) > 1:
        values = np.stack([np.frombuffer(p, "<u4").astype(np.uint32) for p in parts], axis=1)
        parts = [merged(values, root=True)[:, 0].astype("<u4").tobytes()]
    return parts[0].hex()


def digest(content: bytes) -> str:
    return joined([part_value(content, 0, True)])


@F.pandas_udf(T.BinaryType())
def _values(content: pd.Series, first: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([part_value(c, f // CHUNK, n == 1) for c, f, n in zip(content, first, parts)], dtype=object)


@F.pandas_udf(T.StringType())
def _joined(values: pd.Series) -> pd.Series:
    return values.map(lambda v: joined([bytes(x) for x in v]))


def part_bytes_of(most: int) -> int:
    """The largest power of two chunks in `most` bytes: parts of that size are subtrees."""
    return CHUNK << max(0, (most // CHUNK).bit_length() - 1)


def joined_digests(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and hash of contents given as parts: keys, part (from 0), parts, first (its first byte), content. Parts have one size, of `part_bytes_of`, but for the last.

    Values are 32 bytes a part, brought together by content.
    """
    valued = parts.select(*keys, "part", _values(F.col("content"), F.col("first"), F.col("parts")).alias("value"))
    together = valued.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("v"))
    return together.select(*keys, _joined(F.col("v.value")).alias("hash"))


def file_digests(files: DataFrame, root: str, part_bytes: int = 16 << 20) -> DataFrame:
    """path and hash of `files` (path, raw_path, size), each part of a file read and hashed by a task of its own."""
    step = part_bytes_of(part_bytes)
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / step)).cast("long")
    each = files.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = each.withColumn("first", F.col("part") * step).repartition(files.sparkSession.sparkContext.defaultParallelism, "path", "part")
    kept = ["path", "part", "parts", "first"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(f"{root.rstrip('/')}/{row['raw_path']}", "rb") as f:
                    f.seek(row["first"])
                    value = part_value(f.read(step), row["first"] // CHUNK, row["parts"] == 1)
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "part": pa.array([row["part"]], pa.int64()), "value": pa.array([value], pa.binary())})

    valued = dealt.select(*kept, "raw_path").mapInArrow(read, "path string, part long, value binary")
    together = valued.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("v"))
    return together.select("path", _joined(F.col("v.value")).alias("hash"))


def text_parts(text: Column, part_bytes: int) -> Column:
    """part, parts, first and content of each part of a text's bytes, as an array."""
    step, raw = part_bytes_of(part_bytes), text.cast("binary")
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / step)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.struct(k.alias("part"), parts.alias("parts"), (k * step).cast("long").alias("first"), F.substring(raw, k * step + 1, F.lit(step)).alias("content")),
    )
