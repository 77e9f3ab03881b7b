"""Line dedup: drop lines that many documents share, keep the rest in order.

Every line is normalised (white space stripped at both ends, A-Z lower-cased) and hashed
to 128 bits. Each document counts once for each of its lines; hashes that reach
`min_docs` documents are frequent, and all their lines go.

Scale: the counts combine before the shuffle, so a line found in a third of all documents
costs one row a task. Positions to drop travel back to the texts under a 128-bit key of
the text, which is the same for copies and needs no unique id. Frequent lines, and then positions, are counted first: if there are few
enough they are broadcast, and neither lines nor texts are shuffled. Else both joins are ones that Spark can split
where a line or a text is very common, as their other sides have one row for each.

Null and empty texts are one empty line, which is never dropped while `min_chars` >= 1.
Rows that repeat count once each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.llm.common import SPACE, bounded_join, lower_ascii, saved, text_or_empty, wide_hash


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (h1, h2) of the line keys found in at least `min_docs` rows, with the count `n_docs`."""
    keys = F.array_distinct(F.transform(F.split(text_or_empty(text_col), "\n"), line_key))
    return (
        docs.select(F.explode(keys).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(*wide_hash(F.col("key"), "h"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs)
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most_rows: int = 500_000
) -> DataFrame:
    """One row per input row: `id_col`, n_lines, n_dropped (long), kept_text. `most_rows` bounds what is broadcast."""
    frequent = saved(frequent_lines(docs, text_col, min_docs, min_chars).select("h1", "h2"))
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text")).select(
        F.col(id_col), "_text", *wide_hash(F.col("_text"), "_t")
    )
    places = (
        texts.select("_t1", "_t2", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.length("_key") >= min_chars)
        .select("_t1", "_t2", "_pos", *wide_hash(F.col("_key"), "h"))
    )
    gone = bounded_join(places, frequent, ["h1", "h2"], "left_semi", most_rows)
    dropped = saved(gone.groupBy("_t1", "_t2").agg(F.collect_set("_pos").alias("_gone")))
    n_gone = dropped.agg(F.sum(F.size("_gone"))).first()[0] or 0  # positions, not rows, make its size
    lines = F.split("_text", "\n")
    none = F.array().cast("array<int>")
    return (
        bounded_join(texts, dropped, ["_t1", "_t2"], "left", most_rows if n_gone <= 10 * most_rows else 0)
        .withColumn("_lines", lines)
        .withColumn(
            "_stay",
            F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce(F.col("_gone"), none)),
        )
        .select(
            F.col(id_col),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_stay")).cast("long").alias("n_dropped"),
            F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n").alias("kept_text"),
        )
    )
