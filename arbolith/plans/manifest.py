"""The encrypted manifest: sealed rows in a folder for each generation, and one sealed head that names the folder.

The head is eight bytes of generation and a sealed JSON body with the number of rows; it is replaced atomically, after
its rows are written, which lie in ranges of paths, by path in each file. Every row is sealed with the manifest's key and generation
as context, so rows of another generation don't open, and the count tells if any are missing. The generation before
stays for readers that have begun; older ones are deleted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions import envelope
from arbolith.schemas import MANIFEST
from arbolith.sources.objects import FolderStore
from arbolith.sources.tables import State, keep_latest, local_uri


class Rollback(ValueError):
    """The store has an older manifest than this device has seen, or none where there was one."""


def _head_key(prefix: str) -> str:
    return f"{prefix}manifest.bin"


def _context(prefix: str, generation: int):
    return envelope.manifest_context(_head_key(prefix), F.lit(generation))


def write_manifest(
    entries: DataFrame, store: FolderStore, prefix: str, generation: int, key: Callable[[], bytes]
) -> None:
    spark, secret = entries.sparkSession, envelope.secret_column(key)
    folder = f"{prefix}manifest/{generation}"
    content = F.to_json(F.struct(*MANIFEST.names)).cast("binary")
    ordered = entries.repartitionByRange("path").sortWithinPartitions("path")
    boxes = ordered.select(envelope.sealed(content, secret(F.col("path")), _context(prefix, generation)).alias("box"))
    rows_uri = local_uri(f"{store.root}/{folder}")
    boxes.write.mode("overwrite").parquet(rows_uri)
    rows = spark.read.parquet(rows_uri).count()
    head = spark.createDataFrame([(json.dumps({"folder": folder, "rows": rows}),)], "body string")
    box = envelope.sealed(F.col("body").cast("binary"), secret(F.col("body")), _context(prefix, generation))
    payload = head.select(F.concat(envelope.generation_bytes(F.lit(generation)), box).alias("p")).first()["p"]
    store.put(_head_key(prefix), iter([bytes(payload)]))
    keep_latest(os.path.join(store.root, f"{prefix}manifest"), "", generation)


def read_manifest(
    spark: SparkSession, store: FolderStore, prefix: str, state: State, key: Callable[[], bytes]
) -> DataFrame:
    """The manifest's entries. An older generation than this device has seen is refused, a newer one recorded."""
    highest = state.generation()
    if store.head(_head_key(prefix)) is None:
        if highest:
            raise Rollback(f"no manifest, but generation {highest} was seen")
        return spark.createDataFrame([], MANIFEST)
    secret = envelope.secret_column(key)
    head = spark.createDataFrame([(bytearray(store.get(_head_key(prefix))),)], "payload binary")
    generation = head.select(envelope.generation_of(F.col("payload")).alias("g")).first()["g"]
    if generation < highest:
        raise Rollback(f"manifest has generation {generation}, but {highest} was seen")
    opened = envelope.opened(envelope.body_of(F.col("payload")), secret(F.col("payload")), _context(prefix, generation))
    body = head.select(opened.cast("string").alias("b")).first()["b"]
    if body is None:
        raise ValueError("the manifest doesn't open with this key")
    facts = json.loads(body)
    boxes = spark.read.schema("box binary").parquet(local_uri(f"{store.root}/{facts['folder']}"))
    if boxes.count() != facts["rows"]:
        raise ValueError("the manifest lacks rows")
    refused = F.raise_error(F.lit("a manifest row doesn't open")).cast("string")
    text = envelope.opened(F.col("box"), secret(F.col("box")), _context(prefix, generation)).cast("string")
    entries = boxes.select(F.from_json(F.coalesce(text, refused), MANIFEST).alias("e")).select("e.*")
    if generation > highest:
        state.commit(generation=generation)
    return entries
