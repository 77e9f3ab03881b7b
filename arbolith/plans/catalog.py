"""The registered queries of the snapshot engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.functions import blake3, envelope, paths
from arbolith.functions.digest import digest, formatted, parsed, saturated
from arbolith.functions.keys import object_key
from arbolith.operators import reconcile, state
from arbolith.operators.merge import merge_logs, merged_state
from arbolith.operators.names import case_collisions, conflict_copies, empty_folders
from arbolith.operators.stamps import lamport_stamps
from arbolith.plans.deltalog import DeltaLog, expired
from arbolith.plans.manifest import read_manifest, write_manifest
from arbolith.plans.parts import part_plan
from arbolith.plans.snapshots import NOW, SNAPSHOTS_SQL, SQL_OBJECT_KEY, TEST_KEY, path_of, snapshots
from arbolith.sources.objects import FolderStore, listed
from arbolith.sources.shared import local_path, saved, shared_folder
from arbolith.sources.tables import State
from arbolith.streaming.hints import debounced


def _changes(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return reconcile.changes(s.local, s.baseline, s.remote)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.plan(_changes(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("path", "here", "there")


def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("path", "kind")


def plan_with_rank(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.ordered(_plan(spark, d))


def plan_uploads(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.of_kind(_plan(spark, d), "upload").select("path")


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.summary(_plan(spark, d))


def plan_bookkeeping(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.bookkeeping(_changes(spark, d))


def all_paths(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return reconcile.three_way(s.local, s.baseline, s.remote).select("path")


def scan_hash(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(
        path_of().alias("path"), F.octet_length("text").cast("long").alias("size"), digest(F.col("text")).alias("hash")
    )


def hash_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return state.reuse_hashes(s.local.drop("hash"), s.baseline)


def _awkward_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths as they come: with excluded names, climbing, absolute, doubled and decomposed parts."""
    return spark.sql(
        """
        SELECT doc_id, CASE doc_id % 11
            WHEN 0 THEN concat(source, '/.mirror/', doc_id) WHEN 1 THEN concat(source, '/.DS_Store')
            WHEN 2 THEN concat('../', source, '/', doc_id) WHEN 3 THEN concat('/', source, '/', doc_id)
            WHEN 4 THEN concat(source, '/../', doc_id) WHEN 5 THEN concat('./', source, '/', doc_id)
            WHEN 6 THEN concat(source, '/Thumbs.db.txt/', doc_id) WHEN 7 THEN concat(lang, '/desktop.ini/', doc_id)
            WHEN 8 THEN concat(lang, '/cafe\u0301/', doc_id) WHEN 9 THEN concat(lang, '//', doc_id, '/.hidden')
            ELSE concat(source, '/', lang, '/', doc_id, '.txt') END AS path
        FROM {docs}
        """,
        docs=_documents(spark, d),
    )


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    return _awkward_paths(spark, d).filter(paths.included(F.col("path")))


def safe_path_filter(spark: SparkSession, d: str) -> DataFrame:
    return _awkward_paths(spark, d).filter(paths.safe(F.col("path")))


def nfc_paths(spark: SparkSession, d: str) -> DataFrame:
    return _awkward_paths(spark, d).select("doc_id", paths.canonical(F.col("path")).alias("canonical"))


def prefix_list(spark: SparkSession, d: str) -> DataFrame:
    keys = _documents(spark, d).select(path_of().alias("key"), F.octet_length("text").cast("long").alias("size"))
    return keys.filter(paths.under(F.col("key"), "src1/"))


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(path_of().alias("path")).select(
        "path", F.concat(F.lit("vault/"), object_key(TEST_KEY, F.col("path"))).alias("store_key")
    )


def upsert_record_scan(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return state.record_scan(s.baseline, s.local, NOW)


def upsert_confirm_sync(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return state.confirm_sync(s.baseline, s.local, NOW)


def baseline_delete(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return state.remove(s.baseline, s.remote)


def download_entries(spark: SparkSession, d: str) -> DataFrame:
    return state.download_entries(_plan(spark, d), snapshots(spark, d).remote)


def remote_delete_keys(spark: SparkSession, d: str) -> DataFrame:
    return state.remote_deletes(_plan(spark, d), snapshots(spark, d).remote)


def manifest_after_apply(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    uploaded = s.local.select("path", "size", F.col("hash").alias("content_hash"), object_key(TEST_KEY, F.col("path")).alias("object_key"))
    return state.manifest_after(s.remote, _plan(spark, d), uploaded)


def baseline_after_apply(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    changed = _changes(spark, d)
    arrived = s.remote.select("path", "size", F.lit(NOW * 1_000_000_000).alias("mtime_ns"), F.col("content_hash").alias("hash"))
    return state.baseline_after(s.baseline, reconcile.plan(changed), s.local, arrived, reconcile.bookkeeping(changed), NOW)


def generation_guard(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", "user_id", F.floor("value").cast("long").alias("generation")
    )
    return state.guard_generations(log, "user_id", "event_id", "generation")


def generation_codec(spark: SparkSession, d: str) -> DataFrame:
    """Generations of documents, some large, as eight bytes and back."""
    generation = F.when(F.col("doc_id") % 7 == 0, F.lit((1 << 63) - 1) - F.col("doc_id")).otherwise(F.col("doc_id") * F.col("n_chars"))
    rows = _documents(spark, d).select("doc_id", generation.alias("generation"))
    payload = envelope.generation_bytes(F.col("generation"))
    return rows.select("doc_id", F.lower(F.hex(payload)).alias("prefix"), envelope.generation_of(payload).alias("generation"))


def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    """Each manifest entry as JSON and read back."""
    schema = "path string, size long, content_hash string, object_key string"
    entry = F.from_json(F.to_json(F.struct("path", "size", "content_hash", "object_key")), schema)
    return snapshots(spark, d).remote.select(entry.alias("e")).select("e.*")


def envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document sealed and opened again, and what a wrong context opens (nothing)."""
    key = F.unhex(F.lit(TEST_KEY.hex()))
    context = envelope.frame_context(path_of(), F.lit(0), F.lit(True))
    # the nonce is random: sealing happens once, before the rows are dealt out
    boxes = _documents(spark, d).select("doc_id", "text", context.alias("context"), envelope.sealed(F.col("text").cast("binary"), key, context).alias("box"))
    boxes = boxes.repartition("doc_id")
    return boxes.select(
        "doc_id",
        (F.octet_length("box") - F.octet_length("text")).alias("overhead"),
        digest(envelope.opened(F.col("box"), key, F.col("context"))).alias("opened_hash"),
        envelope.opened(F.col("box"), key, F.concat("context", F.lit("x"))).isNull().alias("refused"),
    )


def payload_guard(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of every length from none on: those shorter than a generation are refused, -1."""
    payload = F.substring(F.concat(envelope.generation_bytes(F.col("doc_id") * F.col("n_chars")), F.lit(b"body")), 1, F.col("doc_id").cast("int") % 13)
    rows = _documents(spark, d).select("doc_id", payload.alias("payload"))
    generation = envelope.accepted_generation(F.col("payload"))
    refused = generation.isNull().alias("refused")
    return rows.select("doc_id", F.octet_length("payload").alias("bytes"), F.coalesce(generation, F.lit(-1)).alias("generation"), refused)


def tampered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sealed manifest rows, some with a byte changed in nonce, content or tag, or read as another generation's: what still opens."""
    key, entry = F.unhex(F.lit(TEST_KEY.hex())), F.to_json(F.struct("path", "size", "content_hash", "object_key"))
    context = lambda generation: envelope.manifest_context("v/manifest.bin", F.lit(generation))
    boxes = snapshots(spark, d).remote.select("path", "size", entry.alias("entry"), envelope.sealed(entry.cast("binary"), key, context(5)).alias("box"))
    boxes = boxes.repartition("path").withColumn("variant", (F.col("size") % 5).cast("int"))
    size = F.octet_length("box")
    at = F.when(F.col("variant") == 1, 1).when(F.col("variant") == 2, 20).otherwise(size)
    flipped = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("box", at, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0"))
    changed = F.concat(F.substring("box", F.lit(1), at - 1), flipped, F.substring("box", at + 1, size))
    box = F.when(F.col("variant").isin(1, 2, 3), changed).otherwise(F.col("box"))
    text = F.when(F.col("variant") == 4, envelope.opened(box, key, context(6))).otherwise(envelope.opened(box, key, context(5)))
    return boxes.select("path", "variant", (text.cast("string") == F.col("entry")).alias("opens_same"), text.isNull().alias("refused"))


def store_listing(spark: SparkSession, d: str) -> DataFrame:
    """The objects of a store under a prefix: keys of all documents, of which some are writes that weren't finished."""
    name = F.concat(F.lit("vault/"), object_key(TEST_KEY, F.col("path")))
    objects = _documents(spark, d).select("doc_id", path_of().alias("path"), F.octet_length("text").cast("long").alias("size")).select(
        F.when(F.col("doc_id") % 13 == 0, F.concat(name, F.lit(".part"))).otherwise(name).alias("key"), "size"
    )
    return listed(objects, "vault/A")


def plan_lines(spark: SparkSession, d: str) -> DataFrame:
    """The plan as it is shown: the padded name of each action and its path."""
    return reconcile.ordered(_plan(spark, d)).select("kind_ord", "path", reconcile.shown(F.col("kind"), F.col("path")).alias("line"))


def hash_codec(spark: SparkSession, d: str) -> DataFrame:
    """Digests of all documents, some in capitals, cut or with a wrong digit, as bytes and back."""
    whole, case = digest(F.col("text")), F.col("doc_id") % 5
    given = F.when(case == 1, F.upper(whole)).when(case == 2, F.substring(whole, 1, 63)).when(case == 3, F.concat(F.lit("g"), F.substring(whole, 2, 63)))
    rows = _documents(spark, d).select("doc_id", given.otherwise(whole).alias("given"))
    value = parsed(F.col("given"))
    return rows.select("doc_id", F.coalesce(F.octet_length(value), F.lit(0)).alias("bytes"), F.coalesce(formatted(value), F.lit("refused")).alias("hash"))


def saturated_casts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers around both ends of a long."""
    scale = F.lit(1 << 62).cast("decimal(38,0)")
    number = (F.col("doc_id") % 9 - 4).cast("decimal(10,0)") * scale + F.col("n_chars").cast("decimal(10,0)")
    return _documents(spark, d).select("doc_id", saturated(number).alias("size"))


def _device_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of four devices' logs; a third of them belong to one path. Content 0 is a deletion."""
    return spark.sql(
        """
        SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE concat(event_type, '/', user_id % 1000) END AS path,
               event_id div 3 AS lamport, concat('d', event_id % 4) AS device,
               nullif(sha2(cast(cast(floor(value) AS bigint) % 4 AS string), 256), sha2('0', 256)) AS hash,
               nullif(sha2(cast(event_id * 7 div 3 % 4 AS string), 256), sha2('0', 256)) AS base_hash
        FROM {events}
        """,
        events=spark.read.parquet(f"{d}/events.parquet"),
    )


def merged_log(spark: SparkSession, d: str) -> DataFrame:
    """What became of each entry of four devices' logs, and who lost each conflict."""
    return merge_logs(_device_log(spark, d)).drop("settled", "state_hash")


def merged_paths(spark: SparkSession, d: str) -> DataFrame:
    return merged_state(merge_logs(_device_log(spark, d)))


def stamped_operations(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations of seven devices, of which every fifth has seen one a sixth of the history ago."""
    operations = spark.sql(
        """
        SELECT concat('d', user_id % 7) AS device, event_id AS sequence, event_id AS op,
               CASE WHEN event_id % 5 = 0 AND event_id >= span THEN event_id - span END AS sees
        FROM (SELECT *, (SELECT (max(event_id) + 1) div 6 FROM {events}) AS span FROM {events})
        """,
        events=spark.read.parquet(f"{d}/events.parquet"),
    )
    return lamport_stamps(operations)


def _kept_log(spark: SparkSession, entries: DataFrame, compactions: tuple[int, ...]) -> DeltaLog:
    """`entries` as deltas of three passes, with compactions after the passes named."""
    log = DeltaLog(spark, f"{shared_folder(spark)}/deltalog-{uuid.uuid4().hex}")
    step = (entries.agg(F.max("lamport")).first()[0] or 0) // 3 + 1
    for turn in range(3):
        log.append(entries.filter(F.col("lamport").between(turn * step, (turn + 1) * step - 1)))
        if turn in compactions:
            log.compact()
    return log


def delta_log_state(spark: SparkSession, d: str) -> DataFrame:
    """Every path's state, read from a log's newest snapshot and the deltas after it."""
    return _kept_log(spark, _device_log(spark, d), (1,)).current()


def swept_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the devices' logs that neither a kept snapshot nor a kept delta names; an object is the content of one path."""
    named = _device_log(spark, d)
    content = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.concat("path", F.lit(":"), c), 256)).alias(c)
    entries = saved(named.select("path", "lamport", "device", content("hash"), content("base_hash")))
    log = _kept_log(spark, entries, (1, 2))
    objects = entries.filter("hash is not null").select("hash").distinct()
    return log.unreferenced(objects)


def _seconds(name: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast({name} AS timestamp_ntz))")


def expired_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Deletions that all devices have seen and that lie more than a day before the last event."""
    events = spark.read.parquet(f"{d}/events.parquet")
    log = _device_log(spark, d)
    times = events.select(F.expr("event_id div 3").alias("lamport"), F.expr("concat('d', event_id % 4)").alias("device"), _seconds("ts").alias("deleted_at"))
    gone = merged_state(merge_logs(log)).filter("hash is null").drop("conflicts").join(times, ["lamport", "device"])
    # a device has read what others wrote up to its own last entry but one tenth of its stamp
    acknowledged = log.groupBy("device").agg(F.expr("max(lamport) - max(lamport) div 10").alias("lamport"))
    oldest = (events.agg(F.max(_seconds("ts"))).first()[0] or 0) - 86_400
    return expired(gone, acknowledged, oldest).drop("hash")


def debounced_hints(spark: SparkSession, d: str) -> DataFrame:
    """Events as hints about paths, in bursts with at most a quiet hour; a few say that hints were lost."""
    hints = spark.read.parquet(f"{d}/events.parquet").select(
        F.when(F.col("event_id") % 50 != 0, F.concat("event_type", F.lit("/"), (F.col("user_id") % 4).cast("string"))).alias("path"),
        "ts",
        F.when(F.col("event_id") % 7 == 0, "remove").otherwise("write").alias("kind"),
    )
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({} AS timestamp_ntz))"
    return debounced(hints, "1 hour", "1 day").withColumns({c: F.expr(since.format(c)) for c in ("first", "last")})


def upload_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of all documents as files; parts of 1,000 bytes and up, so that longer texts than 20 of them have larger ones."""
    sizes = _documents(spark, d).select(path_of().alias("path"), F.octet_length("text").cast("long").alias("size"))
    return part_plan(sizes, part_bytes=1000, most=20, unit=100)


def case_folded_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents in folders whose names differ in case, in how letters are composed or in forms that folding makes one."""
    spelled = F.element_at(
        F.array(*(F.lit(x) for x in ("Straße", "STRASSE", "σας", "ΣΑΣ", "CAF\u00c9", "cafe\u0301", "plain", "Notes", "notes"))), (F.col("doc_id") % 9 + 1).cast("int")
    )
    name = F.when(F.col("doc_id") % 4 == 0, F.upper("lang")).otherwise(F.col("lang"))
    number = F.concat(F.expr("doc_id div 2").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".txt"))
    return case_collisions(_documents(spark, d).select(F.concat_ws("/", "source", F.when(F.col("doc_id") % 5 == 0, spelled), name, number).alias("path")))


def conflict_names(spark: SparkSession, d: str) -> DataFrame:
    """Copies for documents that lost conflicts, where some names are taken already and some losers are copies themselves."""
    at, device = F.lit("2026-08-14T12-30-00Z"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"))
    tag = F.concat(F.lit(" (conflicted copy "), at, F.lit(" from "), device, F.lit(")"))
    stem = F.concat_ws("/", "source", F.concat("lang", (F.col("doc_id") % 5).cast("string")))
    ext = F.when(F.col("doc_id") % 2 == 0, ".tar.gz").otherwise("")
    docs = _documents(spark, d).select("doc_id", stem.alias("stem"), tag.alias("tag"), device.alias("device"), ext.alias("ext"))
    copied = F.concat("stem", F.when(F.col("doc_id") % 7 == 0, F.col("tag")).otherwise(""), "ext")
    losers = docs.filter("doc_id % 3 <> 1").select(copied.alias("path"), F.col("doc_id").alias("lamport"), "device", at.alias("at"))
    number = F.expr("doc_id div 30 * 2")
    taken = F.when(number > 0, F.concat(F.lit(" "), number.cast("string"))).otherwise("")
    # the tag of a name with an inner extension stands before the last one
    inner = F.regexp_extract("ext", r"^(.*?)(\.[^.]*)?$", 1)
    there = docs.filter("doc_id % 3 = 1").select(F.concat("stem", inner, "tag", taken, F.substring("ext", F.length(inner) + 1, F.lit(9))).alias("path"))
    return conflict_copies(losers, there)


def topmost_empty_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders by source, language and number, of which only some hold documents."""
    folder = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 40).cast("string"), (F.col("doc_id") % 3).cast("string"))
    docs = _documents(spark, d).select("doc_id", folder.alias("folder"))
    files = docs.filter("doc_id % 40 < 15 and (doc_id % 3 = 0 or doc_id % 40 > 10)").select(F.concat("folder", F.lit("/"), "doc_id").alias("path"))
    parts = F.split("folder", "/")
    folders = docs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return empty_folders(files, folders)


def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """BLAKE3 of each document's text, its parts of 4 KiB hashed one by one and joined."""
    parts = _documents(spark, d).select("doc_id", F.explode(blake3.text_parts(F.coalesce("text", F.lit("")), 4096)).alias("p")).select("doc_id", "p.*")
    dealt = parts.repartition(spark.sparkContext.defaultParallelism, "doc_id", "part")  # hashing is the work here, not reading
    return blake3.joined_digests(dealt, ["doc_id"])


def sealed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a sealed manifest, written to a store in two generations, read back by a device that has seen the first."""
    folder = f"{local_path(shared_folder(spark))}/manifest-{uuid.uuid4().hex}"
    store, device = FolderStore(f"{folder}/store"), State(spark, f"{folder}/state")
    entries = snapshots(spark, d).remote
    write_manifest(entries.filter("size % 2 = 0"), store, "v/", 1, lambda: TEST_KEY)
    read_manifest(spark, store, "v/", device, lambda: TEST_KEY)
    write_manifest(entries, store, "v/", 2, lambda: TEST_KEY)
    return read_manifest(spark, store, "v/", device, lambda: TEST_KEY).withColumn("generation", F.lit(device.generation()).cast("long"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    reconcile_plan, change_classes, plan_summary, plan_with_rank, plan_uploads, plan_bookkeeping, all_paths, scan_hash,
    hash_cache_reuse, exclude_filter, safe_path_filter, nfc_paths, prefix_list, object_keys, upsert_record_scan,
    upsert_confirm_sync, baseline_delete, download_entries, remote_delete_keys, manifest_after_apply,
    baseline_after_apply, generation_guard, generation_codec, manifest_json, envelope_roundtrip, payload_guard, tampered_rows,
    store_listing, plan_lines, hash_codec, saturated_casts, merged_log, merged_paths, stamped_operations, delta_log_state, swept_objects,
    expired_tombstones, debounced_hints, upload_parts, case_folded_collisions, conflict_names, topmost_empty_folders,
    sealed_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


AWKWARD_SQL = """
paths AS (
  SELECT doc_id, CASE doc_id % 11
    WHEN 0 THEN source || '/.mirror/' || doc_id WHEN 1 THEN source || '/.DS_Store'
    WHEN 2 THEN '../' || source || '/' || doc_id WHEN 3 THEN '/' || source || '/' || doc_id
    WHEN 4 THEN source || '/../' || doc_id WHEN 5 THEN './' || source || '/' || doc_id
    WHEN 6 THEN source || '/Thumbs.db.txt/' || doc_id WHEN 7 THEN lang || '/desktop.ini/' || doc_id
    WHEN 8 THEN lang || '/cafe\u0301/' || doc_id WHEN 9 THEN lang || '//' || doc_id || '/.hidden'
    ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path
  FROM documents
)"""

#: A fold of each path's entries, one a step.
DEVICE_LOG_SQL = """
entries AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type || '/' || (user_id % 1000) END AS path, event_id // 3 AS lamport,
         'd' || (event_id % 4) AS device, nullif(sha256(CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR)), sha256('0')) AS hash,
         nullif(sha256(CAST(event_id * 7 // 3 % 4 AS VARCHAR)), sha256('0')) AS base_hash, epoch(date_trunc('second', ts))::BIGINT AS written
  FROM events
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY lamport, device) AS i FROM entries
), judged AS (
  SELECT path, lamport, device, hash, base_hash, i, 'forward' AS outcome, NULL::BIGINT AS loser_lamport, NULL::VARCHAR AS loser_device,
         NULL::VARCHAR AS loser_hash, lamport AS state_lamport, device AS state_device, hash AS state_hash FROM numbered WHERE i = 1
  UNION ALL
  SELECT path, lamport, device, hash, base_hash, i, outcome,
         CASE outcome WHEN 'conflict' THEN l END, CASE outcome WHEN 'conflict' THEN d END, CASE outcome WHEN 'conflict' THEN h END,
         CASE WHEN takes THEN lamport ELSE l END, CASE WHEN takes THEN device ELSE d END, CASE WHEN takes THEN hash ELSE h END
  FROM (
    SELECT *, outcome IN ('forward', 'conflict') OR outcome = 'kept' AND hash IS NOT NULL AS takes FROM (
      SELECT n.*, j.state_lamport AS l, j.state_device AS d, j.state_hash AS h,
             CASE WHEN n.base_hash IS NOT DISTINCT FROM j.state_hash THEN 'forward' WHEN n.hash IS NOT DISTINCT FROM j.state_hash THEN 'converged'
                  WHEN n.hash IS NOT NULL AND j.state_hash IS NOT NULL THEN 'conflict' ELSE 'kept' END AS outcome
      FROM judged j JOIN numbered n ON n.path = j.path AND n.i = j.i + 1))
), last_states AS (
  SELECT path, arg_max(struct_pack(h := state_hash), i).h AS hash, arg_max(state_lamport, i) AS lamport, arg_max(state_device, i) AS device,
         count(*) FILTER (outcome IN ('conflict', 'kept')) AS conflicts
  FROM judged GROUP BY path
)"""

_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_UPSERT = """
SELECT coalesce(s.path, b.path) AS path,
       CASE WHEN s.path IS NULL THEN b.size ELSE s.size END AS size,
       CASE WHEN s.path IS NULL THEN b.mtime_ns ELSE s.mtime_ns END AS mtime_ns,
       CASE WHEN s.path IS NULL THEN b.content_hash ELSE s.hash END AS content_hash,
       {synced} AS last_synced_hash,
       CASE WHEN s.path IS NULL THEN b.updated_at ELSE {now} END AS updated_at
FROM {baseline} b FULL JOIN {seen} s ON b.path = s.path"""
_CONFIRM = "CASE WHEN s.path IS NULL THEN b.last_synced_hash ELSE s.hash END"


def oracle_sql() -> dict[str, str]:
    with_snapshots = f"WITH {SNAPSHOTS_SQL}"
    with_paths = f"WITH {AWKWARD_SQL}"
    with_log = f"WITH RECURSIVE {DEVICE_LOG_SQL}"
    upsert = lambda synced, baseline="baseline", seen="local": _UPSERT.format(synced=synced, now=NOW, baseline=baseline, seen=seen)
    return {
        "reconcile_plan": f"{with_snapshots} SELECT path, kind FROM plan",
        "change_classes": f"{with_snapshots} SELECT path, here, there FROM changes",
        "plan_summary": f"""{with_snapshots} SELECT count(*) FILTER (kind = 'download') AS download, count(*) FILTER (kind = 'upload') AS upload,
            count(*) FILTER (kind = 'delete-local') AS delete_local, count(*) FILTER (kind = 'delete-remote') AS delete_remote,
            count(*) FILTER (kind = 'conflict') AS conflict FROM plan""",
        "plan_with_rank": f"{with_snapshots} SELECT kind_ord, kind, path FROM plan ORDER BY kind_ord, path",
        "plan_uploads": f"{with_snapshots} SELECT path FROM plan WHERE kind = 'upload'",
        "plan_bookkeeping": f"{with_snapshots} SELECT path, step, hash FROM bookkeeping",
        "all_paths": f"""{with_snapshots} SELECT path FROM local UNION SELECT path FROM baseline UNION SELECT path FROM remote""",
        "scan_hash": f"SELECT {_PATH} AS path, strlen(text) AS size, sha256(text) AS hash FROM documents",
        "hash_cache_reuse": f"""{with_snapshots} SELECT l.path, l.size, l.mtime_ns, b.content_hash AS known_hash
            FROM local l LEFT JOIN baseline b ON l.path = b.path AND l.size = b.size AND l.mtime_ns = b.mtime_ns""",
        "exclude_filter": f"""{with_paths} SELECT * FROM paths
            WHERE NOT list_has_any(string_split(path, '/'), ['.mirror', '.DS_Store', 'Thumbs.db', 'desktop.ini'])""",
        "safe_path_filter": f"""{with_paths} SELECT * FROM paths
            WHERE NOT starts_with(path, '/') AND NOT starts_with(path, './') AND NOT list_contains(string_split(path, '/'), '..')""",
        "nfc_paths": f"{with_paths} SELECT doc_id, nfc_normalize(path) AS canonical FROM paths",
        "prefix_list": f"SELECT * FROM (SELECT {_PATH} AS key, strlen(text) AS size FROM documents) WHERE starts_with(key, 'src1/')",
        "object_keys": f"SELECT path, 'vault/' || {SQL_OBJECT_KEY('path')} AS store_key FROM (SELECT {_PATH} AS path FROM documents)",
        "upsert_record_scan": f"{with_snapshots} {upsert('b.last_synced_hash')}",
        "upsert_confirm_sync": f"{with_snapshots} {upsert(_CONFIRM)}",
        "baseline_delete": f"{with_snapshots} SELECT * FROM baseline WHERE path NOT IN (SELECT path FROM remote)",
        "download_entries": f"{with_snapshots} SELECT r.* FROM remote r JOIN plan p ON p.path = r.path AND p.kind = 'download'",
        "remote_delete_keys": f"{with_snapshots} SELECT r.* FROM remote r JOIN plan p ON p.path = r.path AND p.kind = 'delete-remote'",
        "manifest_after_apply": f"""{with_snapshots} SELECT r.* FROM remote r LEFT JOIN plan p ON p.path = r.path
            WHERE p.kind IS NULL OR p.kind NOT IN ('upload', 'delete-remote')
            UNION ALL SELECT l.path, l.size, l.hash, {SQL_OBJECT_KEY('l.path')} FROM local l JOIN plan p ON p.path = l.path AND p.kind = 'upload'""",
        "baseline_after_apply": f"""{with_snapshots}, gone AS (
              SELECT path FROM plan WHERE kind IN ('delete-local', 'delete-remote') UNION ALL SELECT path FROM bookkeeping WHERE step = 'forget'
            ), kept AS (SELECT * FROM baseline WHERE path NOT IN (SELECT path FROM gone)),
            synced AS (
              SELECT l.* FROM local l WHERE path IN (SELECT path FROM plan WHERE kind = 'upload' UNION ALL SELECT path FROM bookkeeping WHERE step = 'adopt')
              UNION ALL SELECT r.path, r.size, {NOW * 1_000_000_000}, r.content_hash FROM remote r JOIN plan p ON p.path = r.path AND p.kind = 'download'
            ) {upsert(_CONFIRM, 'kept', 'synced')}""",
        "generation_guard": """
            SELECT event_id, user_id, generation, highest, generation >= highest AS accepted FROM (
              SELECT *, greatest(coalesce(max(generation) OVER (PARTITION BY user_id ORDER BY event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS highest
              FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS generation FROM events))""",
        "generation_codec": """
            SELECT doc_id, lower(lpad(to_hex(generation), 16, '0')) AS prefix, generation FROM (
              SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 9223372036854775807 - doc_id ELSE doc_id * n_chars END AS generation FROM documents)""",
        "sealed_manifest": f"{with_snapshots} SELECT *, 2::BIGINT AS generation FROM remote",
        "manifest_json": f"{with_snapshots} SELECT * FROM remote",
        "envelope_roundtrip": "SELECT doc_id, 28::INTEGER AS overhead, sha256(text) AS opened_hash, true AS refused FROM documents",
        "payload_guard": """SELECT doc_id, bytes, CASE WHEN bytes >= 8 THEN doc_id * n_chars ELSE -1 END AS generation, bytes < 8 AS refused
            FROM (SELECT doc_id, n_chars, CAST(least(doc_id % 13, 12) AS INTEGER) AS bytes FROM documents)""",
        "tampered_rows": f"""{with_snapshots} SELECT path, CAST(size % 5 AS INTEGER) AS variant, CASE WHEN size % 5 = 0 THEN true END AS opens_same,
            size % 5 <> 0 AS refused FROM remote""",
        "plan_lines": f"{with_snapshots} SELECT kind_ord, path, rpad(kind, 14, ' ') || ' ' || path AS line FROM plan",
        "hash_codec": """SELECT doc_id, CAST(CASE WHEN regexp_full_match(given, '[0-9A-Fa-f]{64}') THEN 32 ELSE 0 END AS INTEGER) AS bytes,
            CASE WHEN regexp_full_match(given, '[0-9A-Fa-f]{64}') THEN lower(given) ELSE 'refused' END AS hash FROM (
              SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 1, 63)
                                             WHEN 3 THEN 'g' || substr(sha256(text), 2, 63) ELSE sha256(text) END AS given FROM documents)""",
        "saturated_casts": """SELECT doc_id, CAST(greatest(least(CAST(doc_id % 9 - 4 AS HUGEINT) * 4611686018427387904 + n_chars,
            CAST(9223372036854775807 AS HUGEINT)), -CAST(9223372036854775807 AS HUGEINT) - 1) AS BIGINT) AS size FROM documents""",
        "merged_log": f"""{with_log} SELECT path, lamport, device, hash, base_hash, outcome, loser_lamport, loser_device, loser_hash,
            state_lamport, state_device FROM judged""",
        "merged_paths": f"{with_log} SELECT path, hash, lamport, device, conflicts FROM last_states",
        "delta_log_state": f"{with_log} SELECT path, hash, lamport, device FROM last_states",
        "stamped_operations": """
            WITH RECURSIVE operations AS (
              SELECT event_id AS op, user_id % 7 AS d, (SELECT (max(event_id) + 1) // 6 FROM events) AS span FROM events
            ), clocked AS (
              SELECT -1::BIGINT AS op, 0::BIGINT AS lamport, [0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS clocks, []::BIGINT[] AS recent
              UNION ALL
              SELECT op, lamport, list_transform(clocks, lambda c, k: CASE WHEN k = d + 1 THEN lamport ELSE c END),
                     list_append(CASE WHEN len(recent) = span THEN recent[2:] ELSE recent END, lamport)
              FROM (
                SELECT o.op, o.d, o.span, c.clocks, c.recent,
                       greatest(c.clocks[o.d + 1], CASE WHEN o.op % 5 = 0 AND o.op >= o.span THEN c.recent[1] ELSE 0 END) + 1 AS lamport
                FROM clocked c JOIN operations o ON o.op = c.op + 1)
            )
            SELECT 'd' || o.d AS device, o.op AS sequence, o.op, CASE WHEN o.op % 5 = 0 AND o.op >= o.span THEN o.op - o.span END AS sees, c.lamport
            FROM clocked c JOIN operations o ON o.op = c.op""",
        "swept_objects": f"""{with_log}, ends AS (
              SELECT max(lamport) // 3 + 1 AS step FROM entries
            ), horizons AS (
              SELECT (SELECT min(m) FROM (SELECT max(lamport) AS m FROM entries, ends WHERE lamport < 2 * step GROUP BY device)) AS older,
                     (SELECT min(m) FROM (SELECT max(lamport) AS m FROM entries GROUP BY device)) AS newer
            ), states AS (
              SELECT path, arg_max(struct_pack(h := state_hash), i).h AS hash FROM judged, horizons WHERE lamport <= older GROUP BY path
              UNION ALL SELECT path, arg_max(struct_pack(h := state_hash), i).h FROM judged, horizons WHERE lamport <= newer GROUP BY path
              UNION ALL SELECT path, hash FROM entries, horizons WHERE lamport > older
              UNION ALL SELECT path, base_hash FROM entries, horizons WHERE lamport > older
            )
            SELECT sha256(path || ':' || hash) AS hash FROM (SELECT path, hash FROM entries WHERE hash IS NOT NULL EXCEPT SELECT path, hash FROM states)""",
        "expired_tombstones": f"""{with_log}, seen AS (
              SELECT min(top - top // 10) AS horizon FROM (SELECT max(lamport) AS top FROM entries GROUP BY device))
            SELECT s.lamport, s.device, s.path, e.written AS deleted_at FROM last_states s
            JOIN entries e ON e.path = s.path AND e.lamport = s.lamport AND e.device = s.device, seen
            WHERE s.hash IS NULL AND s.lamport <= horizon AND e.written < (SELECT max(written) FROM entries) - 86400""",
        "debounced_hints": """
            WITH hints AS (
              SELECT CASE WHEN event_id % 50 <> 0 THEN event_type || '/' || (user_id % 4) END AS path, ts,
                     CASE WHEN event_id % 7 = 0 THEN 'remove' ELSE 'write' END AS kind FROM events
            ), cut AS (
              SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM hints
            ), bursts AS (
              SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM cut
            )
            SELECT path, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS hints,
                   CASE WHEN path IS NULL THEN 'full-rescan' WHEN arg_max(kind, (ts, kind)) = 'remove' THEN 'confirm-delete' ELSE 'rescan' END AS intent
            FROM bursts GROUP BY path, burst""",
        "upload_parts": f"""SELECT path, size, step, parts, part, part * step AS first, least(step, size - part * step) AS bytes FROM (
              SELECT *, unnest(generate_series(0, parts - 1)) AS part FROM (
                SELECT *, greatest(1, (size + step - 1) // step) AS parts FROM (
                  SELECT {_PATH} AS path, strlen(text) AS size, greatest(1000, (strlen(text) + 1999) // 2000 * 100) AS step FROM documents)))""",
        "case_folded_collisions": """
            WITH paths AS (
              SELECT DISTINCT source || '/' || CASE WHEN doc_id % 5 = 0
                       THEN ['Straße', 'STRASSE', 'σας', 'ΣΑΣ', 'CAF' || chr(201), 'cafe' || chr(769), 'plain', 'Notes', 'notes'][doc_id % 9 + 1] || '/' ELSE '' END
                     || CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END || '/' || doc_id // 2 || CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.txt' END AS path
              FROM documents
            ), prefixes AS (
              SELECT path, array_to_string(string_split(path, '/')[1 : n], '/') AS prefix
              FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM paths)
            ), folded AS (
              SELECT *, replace(replace(lower(nfc_normalize(prefix)), 'ß', 'ss'), 'ς', 'σ') AS f FROM prefixes
            ), clashes AS (SELECT f FROM folded GROUP BY f HAVING count(DISTINCT prefix) > 1)
            SELECT path, arg_min(f, length(prefix)) AS at FROM folded WHERE f IN (SELECT f FROM clashes) GROUP BY path""",
        "conflict_names": r"""
            WITH docs AS (
              SELECT doc_id, source || '/' || lang || doc_id % 5 AS stem, 'd' || doc_id % 3 AS device, CASE WHEN doc_id % 2 = 0 THEN '.tar' ELSE '' END AS inner_ext,
                     CASE WHEN doc_id % 2 = 0 THEN '.gz' ELSE '' END AS ext FROM documents
            ), tagged AS (
              SELECT *, ' (conflicted copy 2026-08-14T12-30-00Z from ' || device || ')' AS tag FROM docs
            ), losers AS (
              SELECT stem || CASE WHEN doc_id % 7 = 0 THEN tag ELSE '' END || inner_ext || ext AS path, doc_id AS lamport, device, '2026-08-14T12-30-00Z' AS at, ext,
                     stem || CASE WHEN doc_id % 7 = 0 AND inner_ext = '' THEN '' WHEN doc_id % 7 = 0 THEN tag || inner_ext ELSE inner_ext END || tag AS base
              FROM tagged WHERE doc_id % 3 <> 1
            ), taken AS (
              SELECT stem || inner_ext || tag AS base, ext, list(DISTINCT doc_id // 30 * 2) AS used FROM tagged WHERE doc_id % 3 = 1 GROUP BY ALL
            ), ranked AS (
              SELECT l.*, row_number() OVER (PARTITION BY l.base, l.ext ORDER BY lamport, device, path) AS k, coalesce(used, []) AS used,
                     count(*) OVER (PARTITION BY l.base, l.ext) AS n
              FROM losers l LEFT JOIN taken t ON t.base = l.base AND t.ext = l.ext
            ), free AS (
              SELECT *, list_filter(generate_series(0, n + len(used)), lambda x: NOT list_contains(used, x))[k] AS number FROM ranked
            )
            SELECT path, lamport, device, "at", base || CASE WHEN number = 0 THEN '' ELSE ' ' || number END || ext AS copy FROM free""",
        "topmost_empty_folders": """
            WITH docs AS (
              SELECT doc_id, source || '/' || lang || '/' || doc_id % 40 || '/' || doc_id % 3 AS folder,
                     doc_id % 40 < 15 AND (doc_id % 3 = 0 OR doc_id % 40 > 10) AS filled FROM documents
            ), levels AS (
              SELECT array_to_string(string_split(folder, '/')[1 : n], '/') AS path, filled
              FROM (SELECT folder, filled, unnest([1, 2, 3, 4]) AS n FROM docs)
            ), empties AS (SELECT path FROM levels GROUP BY path HAVING NOT bool_or(filled))
            SELECT path FROM empties e WHERE NOT EXISTS (SELECT 1 FROM empties o WHERE starts_with(e.path, o.path || '/'))""",
        "store_listing": f"""SELECT key, size FROM (
              SELECT 'vault/' || {SQL_OBJECT_KEY('path')} || CASE WHEN doc_id % 13 = 0 THEN '.part' ELSE '' END AS key, size
              FROM (SELECT doc_id, {_PATH} AS path, strlen(text) AS size FROM documents))
            WHERE starts_with(key, 'vault/A') AND NOT ends_with(key, '.part')""",
    }
