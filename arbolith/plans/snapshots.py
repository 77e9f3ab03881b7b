"""Three snapshots derived from `documents`: every combination of absent and three versions on each side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions.digest import digest
from arbolith.functions.keys import object_key

#: A public test key; its pads show in plans.
TEST_KEY = bytes([7] * 32)
NOW = 1_700_000_000


@dataclass(frozen=True)
class Snapshots:
    local: DataFrame
    baseline: DataFrame
    remote: DataFrame


def _version(text: Column, version: Column) -> Column:
    return digest(F.concat(text, F.lit("#"), version.cast("string")))


def path_of() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def snapshots(spark: SparkSession, sf_dir: str) -> Snapshots:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", path_of().alias("path"))
    version = lambda step: (F.expr(f"doc_id div {step}") % 4).cast("long")
    size = lambda v: (F.octet_length("text") + v).cast("long").alias("size")
    time = lambda v: ((F.col("doc_id") * 1000 + v) * 1_000_000).alias("mtime_ns")
    lv, bv, rv = version(1), version(4), version(16)
    base = _version(F.col("text"), bv)
    return Snapshots(
        local=docs.filter(lv > 0).select("path", size(lv), time(lv), _version(F.col("text"), lv).alias("hash")),
        baseline=docs.filter(bv > 0).select(
            "path",
            size(bv),
            time(bv),
            base.alias("content_hash"),
            F.when(F.expr("(doc_id div 64) % 3") != 2, base).alias("last_synced_hash"),
            (F.col("doc_id") + NOW - 1_000_000).alias("updated_at"),
        ),
        remote=docs.filter(rv > 0).select(
            "path", size(rv), _version(F.col("text"), rv).alias("content_hash"), object_key(TEST_KEY, F.col("path")).alias("object_key")
        ),
    )


def _sql_object_key(path: str) -> str:
    inner, outer = (bytes(b ^ pad for b in TEST_KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    mac = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({path}))))"
    digit = lambda i: (
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(mac, {10 * (i // 8) + 1}, 10) AS BIGINT) >> {35 - 5 * (i % 8)}) & 31 AS INTEGER), 1)"
    )
    name = " || ".join(("'/' || " if i in (2, 4) else "") + digit(i) for i in range(26))
    return f"(SELECT {name} FROM (SELECT {mac} AS mac))"


SQL_OBJECT_KEY = _sql_object_key

#: The same snapshots for DuckDB; `plan` and what leads to it.
SNAPSHOTS_SQL = f"""
docs AS (
  SELECT doc_id, text, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         doc_id % 4 AS lv, (doc_id // 4) % 4 AS bv, (doc_id // 16) % 4 AS rv, (doc_id // 64) % 3 AS ep FROM documents
), local AS (
  SELECT path, strlen(text) + lv AS size, (doc_id * 1000 + lv) * 1000000 AS mtime_ns, sha256(text || '#' || lv) AS hash
  FROM docs WHERE lv > 0
), baseline AS (
  SELECT path, strlen(text) + bv AS size, (doc_id * 1000 + bv) * 1000000 AS mtime_ns, sha256(text || '#' || bv) AS content_hash,
         CASE WHEN ep <> 2 THEN sha256(text || '#' || bv) END AS last_synced_hash, doc_id + {NOW - 1_000_000} AS updated_at
  FROM docs WHERE bv > 0
), remote AS (
  SELECT path, strlen(text) + rv AS size, sha256(text || '#' || rv) AS content_hash, {_sql_object_key("path")} AS object_key
  FROM docs WHERE rv > 0
), compared AS (
  SELECT path, l.hash AS local_hash, b.last_synced_hash AS base_hash, r.content_hash AS remote_hash
  FROM local l FULL JOIN (SELECT path, last_synced_hash FROM baseline) b USING (path) FULL JOIN remote r USING (path)
), changes AS (
  SELECT *, CASE WHEN local_hash IS NOT DISTINCT FROM base_hash THEN 'unchanged' WHEN base_hash IS NULL THEN 'created'
                 WHEN local_hash IS NULL THEN 'deleted' ELSE 'modified' END AS here,
         CASE WHEN remote_hash IS NOT DISTINCT FROM base_hash THEN 'unchanged' WHEN base_hash IS NULL THEN 'created'
              WHEN remote_hash IS NULL THEN 'deleted' ELSE 'modified' END AS there
  FROM compared
), decided AS (
  SELECT *, CASE
    WHEN here = 'unchanged' AND there IN ('created', 'modified') THEN 'download'
    WHEN here IN ('created', 'modified') AND there = 'unchanged' THEN 'upload'
    WHEN here = 'unchanged' AND there = 'deleted' THEN 'delete-local'
    WHEN here = 'deleted' AND there = 'unchanged' THEN 'delete-remote'
    WHEN here IN ('created', 'modified') AND there IN ('created', 'modified') AND local_hash = remote_hash THEN NULL
    WHEN here = 'unchanged' OR there = 'unchanged' OR (here = 'deleted' AND there = 'deleted') THEN NULL
    ELSE 'conflict' END AS kind
  FROM changes
), plan AS (
  SELECT path, kind, CASE kind WHEN 'download' THEN 0 WHEN 'upload' THEN 1 WHEN 'delete-local' THEN 2
                               WHEN 'delete-remote' THEN 3 ELSE 4 END AS kind_ord
  FROM decided WHERE kind IS NOT NULL
), bookkeeping AS (
  SELECT path, CASE WHEN here = 'deleted' AND there = 'deleted' THEN 'forget' ELSE 'adopt' END AS step, local_hash AS hash
  FROM decided WHERE (here = 'deleted' AND there = 'deleted')
    OR (here IN ('created', 'modified') AND there IN ('created', 'modified') AND local_hash = remote_hash)
)"""
