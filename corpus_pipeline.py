"""A training corpus from `documents`, in five stages; each stage's rows are written and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbolith.llm.common import delete_folder, folder_exists, read_table, shared_folder
from arbolith.llm.decontaminate import without_contaminated
from arbolith.llm.mixing import mix_documents
from arbolith.llm.quality import passing
from arbolith.llm.sharding import shard_documents
from arbolith.llm.similar import one_per_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id.

    Found by SimHash fingerprints, and by MinHash keys what lies beyond their reach; whole sets decide."""
    return one_per_similar(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth is benchmark text."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is two rows."""
    return mix_documents(docs, weights=(5, 2, 1), budget=1.5, max_epochs=2)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return shard_documents(docs, shards=16, carry=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can express neither suffix arrays nor fingerprints; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over `documents`. With a `folder`, that all executors share, stages stay there and a later run goes on after the last
    one that is whole; without, a stage's table is deleted as soon as the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    own = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        if not (folder and folder_exists(spark, f"{own}/{name}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{own}/{name}")
        docs = spark.read.parquet(f"{own}/{name}")
        if before and not folder:
            delete_folder(spark, before)
        before = f"{own}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
