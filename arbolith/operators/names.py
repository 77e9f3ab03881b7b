"""Names that devices have to agree on: copies of conflicts, names that differ in case only, and folders without files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.sources.shared import saved

#: How a conflict's copy is named, before the extension; a number follows where that name is taken.
COPY = r"^(.* \(conflicted copy [0-9TZ-]+ from [^/()]*\))(?: ([1-9][0-9]{0,8}))?$"


@F.pandas_udf(T.StringType())
def _folded(path: pd.Series) -> pd.Series:
    fold = lambda p: unicodedata.normalize("NFC", unicodedata.normalize("NFD", p).casefold())
    return path.map(lambda p: None if p is None else fold(fold(p)))


def with_folded(df: DataFrame, path: str, folded: str = "folded") -> DataFrame:
    """`df` with `path` under full Unicode case folding, composed: names that some file systems hold to be one are equal. Only paths
    beyond ASCII go to Python. Null paths stay null."""
    plain = F.coalesce(F.octet_length(path) == F.length(path), F.lit(True))
    ascii_only = df.filter(plain).withColumn(folded, F.lower(path))
    return ascii_only.unionByName(df.filter(~plain).withColumn(folded, _folded(F.col(path))))


def _ancestors(path: Column) -> Column:
    """The path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def case_collisions(paths: DataFrame) -> DataFrame:
    """path and at: of each path that collides, the shortest prefix (folded) that another spelling shares. A folder's collision is one of all below it.

    Prefixes are made distinct in each task before they are shuffled, so a folder that holds all paths costs a row a task.
    """
    each = paths.select("path", F.explode(_ancestors(F.col("path"))).alias("prefix"))
    prefixes = with_folded(saved(each.select("prefix").distinct()), "prefix")
    spellings = Window.partitionBy("folded")
    colliding = saved(prefixes.withColumn("n", F.count(F.lit(1)).over(spellings)).filter("n > 1").select("prefix", "folded"))
    return each.join(colliding, "prefix").groupBy("path").agg(F.min_by("folded", F.length("prefix")).alias("at"))


def split_name(path: Column) -> tuple[Column, Column]:
    """A path up to its extension, and the extension with its dot (empty if there is none; a name that only begins with a dot has none)."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(ext)), ext


def conflict_copies(losers: DataFrame, existing: DataFrame) -> DataFrame:
    """`losers` (path, lamport, device, at) with copy, the path that the loser's content moves to.

    The name says when (`at`, UTC as in 2026-08-14T12-30-00Z) and from which device, before the extension. A path that is such a copy itself keeps its name and gets a number.
    Where a name is taken, by an `existing` path or another loser, the losers get the least free numbers in the order of their stamps. The free numbers are
    found without trying: the taken ones t0 < t1 < ... leave t - i numbers free below the i-th, so the k-th free one is k plus how many t - i are at most k.
    """
    named = lambda stem: F.regexp_extract(stem, COPY, 1)
    stem, ext = split_name(F.col("path"))
    clean = F.regexp_replace(F.col("device"), r"[/()]", "-")
    fresh = F.concat(stem, F.lit(" (conflicted copy "), F.col("at"), F.lit(" from "), clean, F.lit(")"))
    wanted = losers.select("*", F.when(named(stem) != "", named(stem)).otherwise(fresh).alias("base"), ext.alias("ext"))
    own = Window.partitionBy("base", "ext").orderBy("lamport", "device", "path")
    wanted = wanted.withColumn("k", F.row_number().over(own).cast("long") - 1)
    there, there_ext = split_name(F.col("path"))
    number = F.regexp_extract(there, COPY, 2)
    taken = existing.select(named(there).alias("base"), there_ext.alias("ext"), F.when(number == "", 0).otherwise(number.cast("long")).alias("t")).filter("base <> ''").distinct()
    by_number = Window.partitionBy("base", "ext").orderBy("t")
    taken = taken.withColumn("k", F.col("t") - F.row_number().over(by_number) + 1)  # numbers that are free below it
    both = wanted.withColumn("is_taken", F.lit(0)).unionByName(taken.select("base", "ext", "k", F.lit(1).alias("is_taken")), allowMissingColumns=True)
    upto = Window.partitionBy("base", "ext").orderBy("k", F.desc("is_taken")).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("number", F.col("k") + F.sum("is_taken").over(upto)).filter("is_taken = 0")
    suffix = F.when(F.col("number") == 0, "").otherwise(F.concat(F.lit(" "), F.col("number").cast("string")))
    return counted.select(*losers.columns, F.concat("base", suffix, "ext").alias("copy"))


def empty_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Of `folders` (path) the topmost ones without a file (path of `files`) anywhere below; one of them is enough to make all below it empty too.

    Files roll up to the distinct folders above them, task by task before the shuffle.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    full = files.select(parent.alias("path")).filter("path <> ''").distinct().select(F.explode(_ancestors(F.col("path"))).alias("path")).distinct()
    empty = saved(folders.select("path").distinct().join(full, "path", "left_anti"))
    above = empty.select(F.col("path").alias("above"))
    return empty.withColumn("above", parent).join(above, "above", "left_anti").select("path")
