"""Three-way comparison of keyed snapshots: what must change so that local and remote agree.

The snapshots are tagged, united and grouped by path: one shuffle, with partial aggregation, and no join. A path that has
a null or no last_synced_hash counts as absent from the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.schemas import KINDS


def last_wins(local: DataFrame, *order: str) -> DataFrame:
    """Of rows that share a path (distinct raw names can share a canonical one) the last by `order`."""
    latest = Window.partitionBy("path").orderBy(*[F.col(c).desc() for c in order])
    return local.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1").drop("_nth")


def three_way(local: DataFrame, baseline: DataFrame, remote: DataFrame) -> DataFrame:
    """path, local_hash, base_hash, remote_hash: one row for each path of any side."""
    tagged = (
        local.select("path", F.col("hash").alias("l"))
        .unionByName(baseline.select("path", F.col("last_synced_hash").alias("b")), allowMissingColumns=True)
        .unionByName(remote.select("path", F.col("content_hash").alias("r")), allowMissingColumns=True)
    )
    return tagged.groupBy("path").agg(
        F.max("l").alias("local_hash"), F.max("b").alias("base_hash"), F.max("r").alias("remote_hash")
    )


def classify(current: Column, base: Column) -> Column:
    """unchanged, created, modified or deleted, of a side against the baseline."""
    return (
        F.when(current.eqNullSafe(base), "unchanged")
        .when(base.isNull(), "created")
        .when(current.isNull(), "deleted")
        .otherwise("modified")
    )


def decide(here: Column, there: Column, local_hash: Column, remote_hash: Column) -> Column:
    """The action for two changes, null if there is nothing to do."""
    changed_here, changed_there = here.isin("created", "modified"), there.isin("created", "modified")
    return (
        F.when((here == "unchanged") & changed_there, "download")
        .when(changed_here & (there == "unchanged"), "upload")
        .when((here == "unchanged") & (there == "deleted"), "delete-local")
        .when((here == "deleted") & (there == "unchanged"), "delete-remote")
        .when(changed_here & changed_there & (local_hash != remote_hash), "conflict")
        .when((changed_here & (there == "deleted")) | ((here == "deleted") & changed_there), "conflict")
    )


def changes(local: DataFrame, baseline: DataFrame, remote: DataFrame) -> DataFrame:
    """three_way with here, there and kind."""
    compared = three_way(local, baseline, remote)
    return (
        compared.withColumn("here", classify(F.col("local_hash"), F.col("base_hash")))
        .withColumn("there", classify(F.col("remote_hash"), F.col("base_hash")))
        .withColumn("kind", decide(F.col("here"), F.col("there"), F.col("local_hash"), F.col("remote_hash")))
    )


def kind_order(kind: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1).cast("int")


def plan(changed: DataFrame) -> DataFrame:
    """kind_ord, kind, path of the paths with something to do; unordered (see ordered)."""
    return changed.filter(F.col("kind").isNotNull()).select(kind_order(F.col("kind")).alias("kind_ord"), "kind", "path")


def ordered(actions: DataFrame) -> DataFrame:
    """Transfers before deletes, conflicts last; by path, byte by byte, within a kind."""
    return actions.orderBy("kind_ord", "path")


def of_kind(actions: DataFrame, kind: str) -> DataFrame:
    return actions.filter(F.col("kind") == kind)


def summary(actions: DataFrame) -> DataFrame:
    """One row with the count of every kind, zeros included."""
    return actions.agg(*[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in KINDS])


def bookkeeping(changed: DataFrame) -> DataFrame:
    """Baseline rows to mend though nothing moves: adopt (both sides made the same change), forget (both deleted)."""
    both = (F.col("here") == F.col("there")) | (F.col("here").isin("created", "modified") & F.col("there").isin("created", "modified"))
    step = (
        F.when(both & (F.col("here") == "deleted"), "forget").when(
            F.col("here").isin("created", "modified")
            & F.col("there").isin("created", "modified")
            & (F.col("local_hash") == F.col("remote_hash")),
            "adopt",
        )
    )
    return changed.select("path", step.alias("step"), F.col("local_hash").alias("hash")).filter("step is not null")


def shown(kind: Column, path: Column) -> Column:
    """A line of the plan: the action's name, padded, and the path."""
    return F.concat(F.rpad(kind, 14, " "), F.lit(" "), path)
