"""Mixing sources to target weights by capped water-filling.

Every source has a weight; together the sources share `budget` times all words. A source
stops at `max_epochs` times its own size and what it can't use is dealt to the others by
weight, in rounds, until none is above its cap. A round's level is (budget - caps of the clamped sources) / (weights of the others); a
source whose weight * level is above its cap is clamped for good, as levels only rise.

Each document is then taken floor(target / size) whole times, and a seeded fraction of the source once
more: documents in the order of a seeded hash of id and text, whole ones until the share is reached;
the one at the border gives part of its words. So a source misses its target by less than
a word, and no document exceeds its cap.

Scale: one pre-aggregated row per source decides the targets; sources are ranked by ranges and each round is an aggregate over their
rows, so no task holds them all. The border of a source is found without sorting it: sizes are summed by the hash's first two
digits, then by two more among the rows of the bucket with the border, and only the rows of that one, one in 65,536, are looked at one by
one. A window sees 256 sums a source. What a document gives
follows from its own hash and its source's row, which is broadcast if sources are few enough; so neither texts nor sizes are
shuffled, whatever the size of a source. All of it is DataFrame functions.

Null sources form one source, ordered last. Null or empty texts have size 0 and are taken
0 times. Rows equal in id, source and `tie` have one hash and are taken alike: at the border each gives an equal part, rounded down.
A table without words has targets 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.llm.common import bounded_join, saved, text_or_empty, word_count, words_of


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """`df`, saved, with rank, from 0 by `order`: ranges are numbered on their own and follow each other."""
    pieces = saved(df.repartitionByRange(order).withColumn("_piece", F.spark_partition_id()))
    counts = {r._piece: r.n for r in pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, at = [], 0
    for piece in sorted(counts):
        starts.append((piece, at))
        at += counts[piece]
    offsets = df.sparkSession.createDataFrame(starts, "_piece int, _start long")
    nth = F.row_number().over(Window.partitionBy("_piece").orderBy(order)) - 1
    return pieces.withColumn("_nth", nth).join(F.broadcast(offsets), "_piece").withColumn("rank", F.col("_start") + F.col("_nth")).drop("_piece", "_nth", "_start")


def source_targets(
    sizes: DataFrame,
    source_col: str = "source",
    size_col: str = "size",
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: int = 2,
) -> DataFrame:
    """One row per source: source, source_size, n_docs (long), weight, target (double)."""
    per_source = sizes.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(size_col).alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), F.col("rank") % len(weights)).cast("long")
    sources = saved(
        ranked(per_source, F.col("source").asc_nulls_last())
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .drop("rank")
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:  # what a level leaves above its cap stays so at the higher ones to come
        over = F.col("weight") * F.lit(level) > F.col("cap")
        sums = sources.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("open")
        ).first()
        if sums.n == clamped or sums.open is None:
            break
        clamped, level = sums.n, (total * float(budget) - (sums.cap or 0)) / sums.open
    cap = F.col("cap").cast("double")
    return sources.select("source", "source_size", "n_docs", "weight", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def seeded_hash(id_col: str, tie: Column, seed: int) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(id_col), tie)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def borders(hashed: DataFrame, targets: DataFrame, levels: Sequence[int] = (2, 4)) -> DataFrame:
    """`targets`, with _whole, and for a fraction of a source: _cut, the hash of its border, and _part, what each row with that hash gives.

    `hashed` is a saved table of _source, _size and _hash. `levels` are the digits of the hash by which sizes are summed, in turn.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = targets.withColumn("_whole", F.floor(ratio)).withColumn("_share", F.floor((ratio - F.col("_whole")) * F.col("source_size")))
    shares = saved(shares.select("*", F.struct("source").alias("_key")))  # a struct is never null, so that the null source joins too
    rows = hashed.select(F.struct(F.col("_source").alias("source")).alias("_key"), "_hash", "_size")
    at = saved(shares.filter("_share > 0").select("_key", F.lit("").alias("_bucket"), "_share", F.lit(0).cast("long").alias("_base")))
    for before, digits in zip((0, *levels), (*levels, 32)):
        inside = bounded_join(rows.withColumn("_bucket", F.substring("_hash", 1, before)), at, ["_key", "_bucket"], "inner")
        sums = inside.groupBy("_key", "_share", "_base", F.substring("_hash", 1, digits).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n")
        )
        earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = F.col("_base") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
        found = sums.withColumn("_base", base).filter((F.col("_base") < F.col("_share")) & (F.col("_base") + F.col("_sum") >= F.col("_share")))
        at = saved(found.select("_key", "_bucket", "_share", "_base", "_n"))
    cut = at.select("_key", F.col("_bucket").alias("_cut"), F.floor((F.col("_share") - F.col("_base")) / F.col("_n")).alias("_part"))
    return shares.join(cut, "_key", "left").drop("_share")


def mix(
    sizes: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    tie: Column | None = None,  # tells rows with equal ids apart, such as a hash of the text
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    levels: Sequence[int] = (2, 4),
) -> DataFrame:
    """`sizes` with columns mix_source_size, mix_target, mix_whole (whole repetitions), mix_part
    (words of one more, partial when below the size) and mix_taken (words in all)."""
    hashed = sizes.withColumn("_hash", seeded_hash(id_col, F.lit("") if tie is None else tie, seed))
    slim = saved(hashed.select(F.col(source_col).alias("_source"), F.col(size_col).alias("_size"), "_hash"))
    targets = source_targets(slim, "_source", "_size", weights, budget, max_epochs)
    plan = saved(
        borders(slim, targets, levels).select(
            "_key", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("_whole").alias("mix_whole"), "_cut", "_part"
        )
    )
    size = F.col(size_col)
    once_more = F.when(F.col("_hash") < F.col("_cut"), size).when(F.col("_hash") == F.col("_cut"), F.least("_part", size))
    return (
        bounded_join(hashed.withColumn("_key", F.struct(F.col(source_col).alias("source"))), plan, ["_key"], "inner", 100_000)
        .withColumn("mix_part", F.coalesce(once_more, F.lit(0)).cast("long"))
        .withColumn("mix_taken", F.col("mix_whole") * size + F.col("mix_part"))
        .select(*sizes.columns, "mix_source_size", "mix_target", "mix_whole", "mix_part", "mix_taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of `docs`.

    A part of a document is its first words, joined by single spaces. A column n_chars counts the characters of the part then, in its
    own type; other columns stay as they are. Documents without words are taken 0 times.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    text = F.col(of[text_col]).cast("string")
    rows = rows.withColumns({"_size": word_count(text_or_empty(of[text_col])), "_tie": F.md5(text.cast("binary"))})
    mixed = mix(rows, of[id_col], of[source_col], "_size", F.col("_tie"), **options)
    part = (F.col("mix_part") > 0) & (F.col("mix_part") < F.col("_size"))
    whole = F.col("mix_whole") + F.when(F.col("mix_part") >= F.col("_size"), 1).otherwise(0)
    none = F.array().cast("array<boolean>")
    copies = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(True), whole.cast("int"))).otherwise(none),
        F.when(part, F.array(F.lit(False))).otherwise(none),
    )
    first = F.array_join(F.slice(words_of(text), F.lit(1), F.col("mix_part").cast("int")), " ")
    changed = {text_col: F.when(F.col("_whole"), text).otherwise(first)}
    if "n_chars" in of:
        kept = F.col(of["n_chars"])
        changed["n_chars"] = F.when(F.col("_whole"), kept).otherwise(F.length(first).cast(docs.schema["n_chars"].dataType))
    return (
        mixed.filter(F.col("_size") > 0)
        .withColumn("_whole", F.explode(copies))
        .select(*(changed.get(c, F.col(n)).alias(c) for c, n in of.items()))
    )
