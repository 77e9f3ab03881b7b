"""Spans: how scans give them to Spark in bounded memory, and how the queries write them down."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a row's spans of the second kind, so many lie in one row; more make further rows, with `piece` 1, 2, ...
PIECE = 10_000


class SpanColumn:
    """A column of lists of structs, built from tuples; the tuples of a few thousand spans are there at a time."""

    def __init__(self, kind: pa.StructType):
        self.kind, self.held, self.parts, self.offsets, self.n = kind, [], [], [0], 0

    def add(self, span: tuple) -> None:
        self.held.append(span)
        self.n += 1
        if len(self.held) >= PIECE:
            self._pack()

    def end_row(self) -> None:
        self.offsets.append(self.n)

    def _pack(self) -> None:
        columns = list(zip(*self.held)) if self.held else [()] * self.kind.num_fields
        self.parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.kind)], fields=list(self.kind)))
        self.held = []

    def array(self) -> pa.ListArray:
        self._pack()
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.concat_arrays(self.parts))


def span_rows(
    batch: pa.RecordBatch, base: Callable[[str], Iterable[tuple]], more: Callable[[str, list[tuple[int, int]]], Iterable[tuple]], kind: pa.StructType,
    most: int = PIECE,
) -> Iterator[pa.RecordBatch]:
    """The batch's columns but text, with piece, base and more for each text; `more` gets the places of the base spans, in their order.

    All base spans are in piece 0.
    """
    others = [n for n in batch.schema.names if n != "text"]

    def packed() -> pa.RecordBatch:
        kept = [batch.column(n).take(pa.array(rows, pa.int32())) for n in others]
        return pa.RecordBatch.from_arrays([*kept, pa.array(pieces, pa.int32()), first.array(), second.array()], names=[*others, "piece", "base", "more"])

    rows, pieces, first, second = [], [], SpanColumn(kind), SpanColumn(kind)
    for i, text in enumerate(batch.column("text")):
        text, places = text.as_py() or "", []
        for span in base(text):
            first.add(span)
            places.append((span[1], span[2]))
        piece = begun = 0
        for span in more(text, places):
            if begun == most:
                rows.append(i)
                pieces.append(piece)
                first.end_row()
                second.end_row()
                yield packed()
                rows, pieces, first, second = [], [], SpanColumn(kind), SpanColumn(kind)
                piece, begun = piece + 1, 0
            second.add(span)
            begun += 1
        rows.append(i)
        pieces.append(piece)
        first.end_row()
        second.end_row()
        if first.n + second.n >= PIECE:
            yield packed()
            rows, pieces, first, second = [], [], SpanColumn(kind), SpanColumn(kind)
    if rows:
        yield packed()


def span_text(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:first:last of each span, by start, then by the order of `kinds`, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["first"].alias("first"), F.array_position(order, s["kind"]).alias("k"), s["last"].alias("last"), s["kind"].alias("kind")
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))
        ),
        ",",
    )


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_digest(spans: Column, kinds: Sequence[str]) -> Column:
    return F.sha2(span_text(spans, kinds).cast("binary"), 256)
