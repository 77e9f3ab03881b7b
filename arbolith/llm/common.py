"""Helpers shared by the training-data operators: paths, checkpoints and expressions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder that all executors share.

    The cluster names the folder in spark.checkpoint.dir; only a local session where that is unset
    (tests, a laptop) takes a temporary folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set on first use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else; strings of ASCII alone take the faster function."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    """Number of maximal runs of characters outside SPACE (long)."""
    return F.size(words_of(c)).cast("long")


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, r"[\x20\x09-\x0D]"), "")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that have one (maps have none)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def wide_hash(c: Column, prefix: str) -> list[Column]:
    """Two 64-bit hashes of `c` with unlike seeds: a 128-bit key for equality of long texts."""
    return [F.xxhash64(c).alias(f"{prefix}1"), F.xxhash64(F.lit(1), c).alias(f"{prefix}2")]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most_bytes` of `column` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker stays for later tasks


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join of `left` with a `right` that has been aggregated by `keys`.

    Joined on `keys` alone, the right side would keep its partitioning, and Spark splits skewed partitions only where it
    has shuffled both sides for the join. One more key, a hash of the others, makes it do so.
    """
    extra = F.xxhash64(*keys).alias("_spread")
    return left.select("*", extra).join(right.select("*", extra), [*keys, "_spread"], how).drop("_spread")


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, most_rows: int = 500_000) -> DataFrame:
    """An equi-join that leaves `left` where it is if `right`, a saved table of narrow rows, has at most `most_rows` of them:
    it is broadcast then, some 50 MB. Else both are shuffled."""
    if right.count() <= most_rows:
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, how)
