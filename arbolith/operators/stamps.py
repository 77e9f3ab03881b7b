"""Lamport stamps of devices' logs: each operation gets max(the device's stamp before, the stamp of the operation that it has seen) + 1.

Along a device's log an operation is a map x -> max(x, s) + 1, with s the stamp it has seen (0 if none). Such maps compose to
x -> max(x + n, b), so the n-th operation's stamp is n + max(0, s_j - j + 1 over all j up to n): a running count and a running maximum, both folded in pieces
(`ordered`). What is seen depends on other devices' stamps, so the maxima are raised round by round, from 0, until none changes. Only operations that
have seen another device take part in rounds, and a round more is needed for each change of device in the longest chain of what has seen what; within
a device any length is one round. Tables between rounds are in the shared folder.

An operation that has seen one of its own device, or one that isn't in the table, has seen nothing new. Histories in which operations have seen each other
in a circle are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.operators.ordered import counted, running_max
from arbolith.sources.shared import saved


def lamport_stamps(operations: DataFrame, device: str = "device", sequence: str = "sequence", op: str = "op", sees: str = "sees") -> DataFrame:
    """`device`, `sequence`, `op`, `sees` and lamport."""
    rows = operations.select(F.col(device).alias("device"), F.col(sequence).alias("sequence"), F.col(op).alias("op"), F.col(sees).alias("sees"))
    log = saved(counted(rows, "device", "sequence"))
    seen = log.select(F.col("op").alias("sees"), F.col("device").alias("from"), F.col("n").alias("at"))
    reads = saved(log.filter("sees is not null").select("device", "n", "op", "sees").join(seen, "sees").filter(~F.col("device").eqNullSafe(F.col("from"))))
    # each read's source: the last read of the other device up to what was seen there, whose maximum holds then
    asks = reads.select(F.col("from").alias("device"), F.col("at").alias("n"), F.lit(None).cast("long").alias("place"), F.col("op").alias("asker"))
    places = reads.select("device", "n", F.col("n").alias("place"), F.lit(None).cast(reads.schema["op"].dataType).alias("asker"))
    both = running_max(places.unionByName(asks).withColumn("_ask", F.col("asker").isNotNull()), "device", ["n", "_ask"], "place", "source")
    sources = both.filter("asker is not null").select(F.col("asker").alias("op"), "source")
    reads = saved(reads.join(sources, "op"))
    total = log.count()
    rounds, tops = 0, reads.select("device", "n", F.lit(0).cast("long").alias("top"))
    while True:
        known = tops.select(F.col("device").alias("from"), F.col("n").alias("source"), F.col("top").alias("there"))
        raised = reads.join(known, ["from", "source"], "left").select("device", "n", (F.col("at") + F.coalesce("there", F.lit(0)) - F.col("n") + 1).alias("gain"))
        new = saved(running_max(raised, "device", ["n"], "gain", "most").select("device", "n", F.greatest(F.col("most"), F.lit(0)).alias("top")))
        changed = new.join(tops.withColumnRenamed("top", "old"), ["device", "n"]).agg(F.count_if(F.col("top") != F.col("old")), F.max(F.col("top") + F.col("n"))).first()
        tops, rounds = new, rounds + 1
        if not changed[0]:
            break
        if changed[1] > total:
            raise ValueError("operations have seen each other in a circle")
    all_rows = log.withColumn("gain", F.lit(None).cast("long")).unionByName(
        tops.select("device", "n", F.col("top").alias("gain")), allowMissingColumns=True
    )
    stamped = running_max(all_rows.withColumn("_own", F.col("gain").isNull()), "device", ["n", "_own"], "gain", "top")
    return stamped.filter("_own").select("device", "sequence", "op", "sees", (F.col("n") + F.coalesce("top", F.lit(0))).alias("lamport"))
