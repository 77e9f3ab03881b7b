"""Quality rules with suffix-array repetition.

The words of a text form a sequence of integers; a suffix array over it, with the
longest common prefixes of neighbouring suffixes, gives every maximal repeated substring of at
least `repeat_words` words. The spans of all their occurrences are united. A text is
rejected when it is too short, when repeats cover too large a fraction of its words or of its
characters, or when one repeat is too long.

Scale: one pass without a shuffle; a task sorts the texts of about 1 MB at a time,
and after the first round only words that the text repeats. Memory is linear in the longest text: under 100 bytes a word,
whose words are numbered in pieces and never listed whole.

Null and empty texts have no words and are rejected as too short. Rows that repeat get the
same answer; no column but the id and the text is read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from arbolith.llm.common import slices
from arbolith.llm.suffixes import longest_repeats

WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
FIELDS = {
    name: pa.int64()
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_bytes", "word_bytes", "longest_repeat")
} | {"repeats": SPANS, "base_failed": pa.bool_(), "kept": pa.bool_()}


@dataclass(frozen=True)
class Rules:
    """base_failed: under `least_words` words, or repeats of `repeat_words` words or more cover over `most_percent` of them.

    kept: not base_failed, repeats cover at most `most_percent` of the words' bytes, and none is longer than `most_repeat` words.
    """

    repeat_words: int = 8
    least_words: int = 20
    most_percent: int = 30
    most_repeat: int = 200


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """`raw` cut at white space into pieces of about `size` bytes."""
    at = 0
    while len(raw) - at > size:
        cut = SPACE.search(raw, at + size)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def numbered(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of a text, equal for equal words, and the words' lengths in bytes."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids, sizes = [], []
    for piece in pieces(raw):
        words = piece.split()
        ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        sizes.append(np.fromiter(map(len, words), np.int32, len(words)))
    return np.concatenate(ids), np.concatenate(sizes)


def repeated_spans(texts: list[np.ndarray], repeat_words: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each sequence of word numbers: the united spans [first, last) of its repeats, and the longest repeat's length."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    longest = [0] * len(texts)
    ids, starts, owners, used, at = [], [], [], 0, 0
    for i, own in enumerate(texts):
        if len(own) <= repeat_words:
            continue
        ids.append(own + used)
        used += int(own.max()) + 1
        ids.append(np.array([used], np.int32))  # ends the text; occurs nowhere else
        used += 1
        starts.append(at)
        owners.append(i)
        at += len(own) + 1
    if not ids:
        return spans, longest
    lengths = longest_repeats(np.concatenate(ids))
    begin = np.flatnonzero(lengths >= repeat_words)
    if not len(begin):
        return spans, longest
    # spans begin in order; a new united span begins where all earlier ones have ended
    reach = np.maximum.accumulate(begin + lengths[begin])
    fresh = np.r_[True, begin[1:] > reach[:-1]]
    lasts = reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(reach) - 1]]
    bounds = np.array(starts)
    for first, last in zip(begin[fresh].tolist(), lasts.tolist()):
        k = int(np.searchsorted(bounds, first, "right")) - 1
        spans[owners[k]].append((first - starts[k], last - starts[k]))
    for k, most in zip(*_most(np.searchsorted(bounds, begin, "right") - 1, lengths[begin])):
        longest[owners[k]] = most
    return spans, longest


def _most(groups: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return groups[first].tolist(), np.maximum.reduceat(values, first).tolist()


def measure(texts: list[str | None], rules: Rules) -> dict[str, list]:
    """The columns of FIELDS for each text."""
    texts = [t or "" for t in texts]
    encoded = [t.encode() for t in texts]
    ids, sizes = zip(*map(numbered, encoded)) if texts else ((), ())
    spans, longest = repeated_spans(list(ids), rules.repeat_words)
    out: dict[str, list] = {name: [] for name in FIELDS}
    for text, raw, ws, found, most in zip(texts, encoded, sizes, spans, longest):
        lines = [x for x in raw.split(b"\n") if x.strip()]
        solid = len(raw.translate(None, WHITE))
        repeated = sum(b - a for a, b in found)
        covered = sum(int(ws[a:b].sum()) for a, b in found)
        failed = len(ws) < rules.least_words or 100 * repeated > rules.most_percent * len(ws)
        row = {
            "n_words": len(ws),
            "word_chars": len(text) - (len(raw) - solid),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeated,
            "n_repeat_bytes": covered,
            "word_bytes": solid,
            "longest_repeat": most,
            "repeats": [{"first": a, "last": b} for a, b in found],
            "base_failed": failed,
            "kept": not failed and 100 * covered <= rules.most_percent * solid and most <= rules.most_repeat,
        }
        for name, value in row.items():
            out[name].append(value)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: `id_col` and FIELDS (repeats in word positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            measured = measure(batch.column("text").to_pylist(), rules)
            arrays = [pa.array(measured[name], kind) for name, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *FIELDS])

    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = from_arrow_schema(pa.schema(list(FIELDS.items())))
    return columns.mapInArrow(run, T.StructType([columns.schema["id"], *fields])).withColumnRenamed("id", id_col)


def passing(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that the rules keep, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text" if cast else text_col, 1 << 20):
            texts = batch.column("_text" if cast else text_col).to_pylist()
            rows = batch.drop_columns(["_text"]) if cast else batch
            yield rows.filter(pa.array(measure(texts, rules)["kept"], pa.bool_()))

    cast = docs.schema[text_col].dataType != T.StringType()  # the column itself stays as it is
    given = docs.withColumn("_text", F.col(text_col).cast("string")) if cast else docs
    return given.mapInArrow(run, docs.schema)
