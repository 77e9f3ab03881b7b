"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.llm import conversations, pii, secrets
from arbolith.llm.common import read_table, saved, text_or_empty, word_count, words_of
from arbolith.llm.decontaminate import benchmark_hits, contaminated
from arbolith.llm.licenses import CUE, LICENCE_FILE, MARKER, license_names, license_scan, name_words, notice_words, templates
from arbolith.llm.line_dedup import dedup_lines
from arbolith.llm.mixing import mix
from arbolith.llm.neighbours import nearest
from arbolith.llm.periodic import longest_run, periodic_runs
from arbolith.llm.quality import quality_rules
from arbolith.llm.sharding import shard_documents
from arbolith.llm.simhash import near_duplicates
from arbolith.llm.spans import span_count, span_digest, span_text
from arbolith.llm.token_counts import count_tokens


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, distance=4, blocks=8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_repeat_bytes", "word_bytes", "longest_repeat",
    )  # fmt: skip


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the documents, in directories by length, source and language: the shortest at the root, the longest three deep.

    Their names are their ids; every twentieth id is a licence file.
    """
    tier = F.when(F.col("n_chars") < 300, F.array().cast("array<string>")).when(F.col("n_chars") < 800, F.array("source"))
    tier = tier.when(F.col("n_chars") < 3000, F.array("source", "lang")).otherwise(F.array("source", "lang", F.lit("long")))
    own = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE."), own)).otherwise(F.concat(own, F.lit(".txt")))
    files = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", tier, name).alias("path"))
    return license_scan(files)


def _op3_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"  # noqa: E731
    known = templates()
    texts = ", ".join(f"({k}, '{name}', {quoted(text)})" for k, (name, text) in enumerate(known))
    words = ", ".join(f"'{w}'" for w in notice_words(known))
    names = license_names()
    of_names = ", ".join(f"({k}, '{license}', '{name}')" for k, (license, name) in enumerate(names))
    name_terms = ", ".join(f"'{w}'" for w in name_words(names))
    most = max(len(name.split()) for _, name in names)
    return rf"""
WITH templates(t, license, text) AS (VALUES {texts}),
template_tf AS (
  SELECT t, license, term, count(*) AS n
  FROM (SELECT t, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY t, license, term
), notice_words(word) AS (SELECT unnest([{words}])),
files AS (
  SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text,
         concat_ws('/', CASE WHEN n_chars < 300 THEN NULL ELSE source END, CASE WHEN n_chars < 800 THEN NULL ELSE lang END,
                   CASE WHEN n_chars < 3000 THEN NULL ELSE 'long' END,
                   CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents
), placed AS (
  SELECT r, doc_id, text, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
         regexp_matches(lower(string_split(path, '/')[-1]), '{LICENCE_FILE}') AS whole
  FROM files
), df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS term FROM files) GROUP BY term
), total AS (SELECT count(*) AS n FROM files WHERE regexp_matches(text, '[a-z0-9]')),
cut AS (
  SELECT r, unnest(u) AS unit, generate_subscripts(u, 1) AS p FROM (
    SELECT r, list_filter(string_split(regexp_replace(text, '([.!?;])[ 	]+', '' || chr(10), 'g'), chr(10)),
                          lambda x: regexp_matches(x, '[a-z0-9]')) AS u
    FROM files WHERE regexp_matches(text, '{CUE}'))
), unit_words AS (
  SELECT r, p, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS word FROM cut
), known_share AS (
  SELECT u.r, u.p, count(n.word) AS known, count(*) AS words FROM unit_words u LEFT JOIN notice_words n ON n.word = u.word GROUP BY u.r, u.p
), marked AS (
  SELECT c.r, c.p, c.unit, regexp_matches(c.unit, '{CUE}') AS cue,
         regexp_matches(c.unit, '{CUE}') OR k.known >= k.words * 0.5 AS header
  FROM cut c JOIN known_share k ON k.r = c.r AND k.p = c.p
), lists AS (
  SELECT r, list(unit ORDER BY p) AS u, list(p ORDER BY p) FILTER (WHERE cue) AS places,
         string_agg(CASE WHEN header THEN unit ELSE chr(1) END, chr(10) ORDER BY p) AS text
  FROM marked GROUP BY r
), segs AS (
  SELECT r, unnest(list_distinct(list_concat(
    list_filter(string_split(text, chr(1)), lambda x: regexp_matches(x, '{CUE}')),
    flatten(list_transform(places, lambda p: [
      array_to_string(u[p : p], chr(10)), array_to_string(u[p : p + 1], chr(10)),
      array_to_string(u[greatest(p - 1, 1) : greatest(p - 1, 1) + 1], chr(10)),
      array_to_string(u[greatest(p - 1, 1) : greatest(p - 1, 1) + 2], chr(10))]))))) AS seg
  FROM lists WHERE len(places) > 0
  UNION ALL SELECT r, text FROM placed WHERE whole
), numbered AS (
  SELECT row_number() OVER () AS s, r, seg FROM segs
), tf AS (
  SELECT s, term, count(*) AS tf FROM (SELECT s, unnest(regexp_extract_all(seg, '[a-z0-9]+')) AS term FROM numbered) GROUP BY s, term
), vectors AS (
  SELECT tf.s, tf.term, tf.tf * (ln((total.n + 1.0::DOUBLE) / (df.df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM tf JOIN df ON df.term = tf.term, total
), norms AS (SELECT s, sum(w * w) AS norm FROM vectors GROUP BY s),
weights AS (
  SELECT t.t, t.license, t.term, t.n * (ln((total.n + 1.0::DOUBLE) / (coalesce(df.df, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM template_tf t LEFT JOIN df ON df.term = t.term, total
), t_norms AS (SELECT t, sum(w * w) AS t_norm FROM weights GROUP BY t),
dots AS (
  SELECT v.s, w.t, w.license, sum(v.w * w.w) AS dot FROM vectors v JOIN weights w ON w.term = v.term GROUP BY v.s, w.t, w.license
), scores AS (
  SELECT n.r, d.license, round(d.dot / sqrt(t.t_norm * m.norm), 4) AS cosine
  FROM dots d JOIN t_norms t ON t.t = d.t JOIN norms m ON m.s = d.s JOIN numbered n ON n.s = d.s
), pieces AS (
  SELECT row_number() OVER () AS q, r, regexp_extract_all(piece, '[a-z0-9]+')[1:{most}] AS w
  FROM (SELECT r, unnest(string_split_regex(text, {quoted(MARKER)})[2:]) AS piece FROM files WHERE regexp_matches(text, '{CUE}'))
), begun AS (
  SELECT q, r, n, w[1:n] AS w FROM (SELECT q, r, w, unnest(generate_series(1, len(w))) AS n FROM pieces)
  WHERE len(list_filter(w[1:n], lambda x: x NOT IN ({name_terms}))) = 0
), run_tf AS (
  SELECT q, r, n, numbers, term, count(*) AS tf FROM (
    SELECT q, r, n, array_to_string(list_sort(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))), ' ') AS numbers, unnest(w) AS term FROM begun)
  GROUP BY ALL
), run_vectors AS (
  SELECT v.*, v.tf * (ln((total.n + 1.0::DOUBLE) / (df.df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS weight FROM run_tf v JOIN df ON df.term = v.term, total
), run_norms AS (SELECT q, n, sum(weight * weight) AS norm FROM run_vectors GROUP BY q, n),
names(name, license, words) AS (VALUES {of_names}),
name_tf AS (
  SELECT name, license, numbers, term, count(*) AS tf FROM (
    SELECT name, license, array_to_string(list_sort(list_filter(string_split(words, ' '), lambda x: regexp_matches(x, '[0-9]'))), ' ') AS numbers,
           unnest(string_split(words, ' ')) AS term FROM names)
  GROUP BY ALL
), name_vectors AS (
  SELECT t.*, t.tf * (ln((total.n + 1.0::DOUBLE) / (coalesce(df.df, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE) AS weight
  FROM name_tf t LEFT JOIN df ON df.term = t.term, total
), name_norms AS (SELECT name, sum(weight * weight) AS norm FROM name_vectors GROUP BY name),
run_dots AS (
  SELECT v.q, v.r, v.n, t.name, t.license, sum(v.weight * t.weight) AS dot
  FROM run_vectors v JOIN name_vectors t ON t.term = v.term AND t.numbers = v.numbers GROUP BY ALL
), named AS (
  SELECT d.q, d.r, d.n, d.license, round(d.dot / sqrt(a.norm * b.norm), 4) AS cosine
  FROM run_dots d JOIN run_norms a ON a.q = d.q AND a.n = d.n JOIN name_norms b ON b.name = d.name
), best_named AS (
  SELECT r, license, cosine FROM named
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, n DESC, license) = 1
), own AS (
  SELECT r, license, cosine FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY named, cosine DESC, license) AS k FROM (
      SELECT r, license, cosine, 0 AS named FROM scores WHERE cosine >= 0.7
      UNION ALL SELECT r, license, cosine, 1 FROM best_named WHERE cosine >= 0.9 AND license <> '')) WHERE k = 1
), known AS (
  SELECT p.*, o.license AS own_license, o.cosine FROM placed p LEFT JOIN own o ON o.r = p.r
), of_dir AS (
  SELECT dir AS license_dir, own_license AS dir_license FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY doc_id NULLS LAST, path, own_license) AS k
    FROM known WHERE whole AND own_license IS NOT NULL) WHERE k = 1
), inherited AS (
  SELECT d.dir, arg_max(o.license_dir, length(o.license_dir)) AS license_dir, arg_max(o.dir_license, length(o.license_dir)) AS dir_license
  FROM (SELECT DISTINCT dir FROM known) d
  JOIN of_dir o ON o.license_dir = '' OR d.dir = o.license_dir OR starts_with(d.dir, o.license_dir || '/') GROUP BY d.dir
)
SELECT k.doc_id, k.path, k.own_license, k.cosine, coalesce(k.own_license, i.dir_license) AS license,
       CASE WHEN k.own_license IS NULL THEN i.license_dir END AS license_dir
FROM known k LEFT JOIN inherited i ON i.dir = k.dir
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(read_table(spark, sf_dir, "documents"), shards=16)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = docs.select(
        "doc_id", "source", word_count(text_or_empty("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("tie")
    )
    return mix(saved(sizes), tie=F.col("tie"), weights=(5, 2, 1), budget=1.5, max_epochs=2).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM per_source
), levelled AS (
  SELECT *, source_size * 2 AS cap,
         (CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE)
           - CAST(coalesce(sum(source_size) OVER before, 0) AS BIGINT) * 2)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS level,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST) AS k
  FROM weighed
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT arg_min(level, k) AS final_level FROM levelled WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size,
         CASE WHEN final_level IS NULL THEN CAST(cap AS DOUBLE)
              ELSE least(CAST(cap AS DOUBLE), final_level * weight) END AS target
  FROM levelled, final
), dealt AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), share AS (
  SELECT *, CAST(floor((ratio - floor(ratio)) * source_size) AS BIGINT)
           - CAST(sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS BIGINT)
           + CAST(sum(size) OVER (PARTITION BY source, h) AS BIGINT) AS left_over, count(*) OVER (PARTITION BY source, h) AS alike
  FROM dealt
)
SELECT doc_id, size, source_size, target,
       CAST(floor(ratio) AS BIGINT) * size + greatest(0, least(left_over // alike, size)) AS taken
FROM share
"""


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(span_count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        span_digest(F.col("base"), secrets.KINDS).alias("base_sha256"),
        span_text(F.concat("base", "learned"), secrets.KINDS).alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_places AS (
  SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM item_places
), doc_places AS (
  SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS k, w FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT p.r, p.k, p.n, v.item FROM doc_places p JOIN windows v ON v.n = p.n AND v.phrase = array_to_string(p.w[p.k : p.k + p.n - 1], ' ')
), hits AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS place FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.r = d.r LEFT JOIN named m ON m.r = d.r
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(span_count(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE),
        span_digest(F.col("base"), pii.KINDS).alias("base_sha256"),
        span_text(F.concat("base", "discovered"), pii.KINDS).alias("spans"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 20 == 0, k=20)


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space, a quarter of them damaged by a hash of conversation and turn."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))  # noqa: E731
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).filter("h <> 0")
    copies = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair(damaged_conversations(rows)))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


#: CRC-32 of a string of ASCII characters; a step back from the end a row carries the cheapest cost and audit of each state, as text.
OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, generate_series(1, 8)),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INTEGER) + 1], c >> 8))) % 20 AS h
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, E' 	

') AS bare, left(role, 1) AS c
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         i > 1 AND lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), lengths AS (
  SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id
), best(conv_id, i, v) AS (
  SELECT conv_id, n + 1, ['000000000|', '000000004|II', '000000002|I', '000000000|'] FROM lengths
  UNION ALL
  SELECT conv_id, i, [
    least(w[1], add('I', 2, w[3])), least(w[2], add('I', 2, w[3])), w[3], w[4]]
  FROM (
    SELECT conv_id, i, [r[1], r[2], least(r[3], add('I', 2, r[4])), least(r[4], add('I', 2, r[3]))] AS w
    FROM (
      SELECT b.conv_id, f.i, [
        least(add('D', 3, b.v[1]), stay('R', 2, f.fault, b.v[3]),
              CASE f.c WHEN 's' THEN stay('K', 0, f.fault, b.v[2]) WHEN 'u' THEN stay('K', 0, f.fault, b.v[3]) ELSE '~' END),
        least(add('D', 3, b.v[2]), stay('R', 2, f.fault, b.v[3]), CASE f.c WHEN 'u' THEN stay('K', 0, f.fault, b.v[3]) ELSE '~' END),
        least(add('D', 3, b.v[3]), stay('R', 2, f.fault, b.v[4]), CASE f.c WHEN 'a' THEN stay('K', 0, f.fault, b.v[4]) ELSE '~' END),
        least(add('D', 3, b.v[4]), stay('R', 2, f.fault, b.v[3]), CASE f.c WHEN 'u' THEN stay('K', 0, f.fault, b.v[3]) ELSE '~' END)] AS r
      FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))
, audits AS (
  SELECT conv_id, CAST(left(v[1], 9) AS BIGINT) AS cost, substr(v[1], 11) AS audit FROM best WHERE i = 1
), letters AS (
  SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS k, unnest(string_split(audit, '')) AS letter FROM audits WHERE audit <> ''
), steps AS (
  SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS m
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
  SELECT s.conv_id, s.k, s.m, s.letter, f.role, f.text,
         max(CASE WHEN s.letter = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS systems
  FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = greatest(s.i, 1) WHERE s.letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (m - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                             || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said
  FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(l.gaps, 0) AS gaps, coalesce(l.blank, 0) AS blank, coalesce(l.duplicate, 0) AS duplicate,
       coalesce(l.truncated, 0) AS truncated, coalesce(l.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit,
       sha256(coalesce(r.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _op12_sql() -> str:
    """OP12_SQL with add(letter, cost, rest) and stay(letter, cost, fault, rest) written out: an edit before the `rest` of an audit."""

    def add(letter: str, cost: str, rest: str) -> str:
        return f"(lpad(CAST(CAST(left({rest}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '|{letter}' || substr({rest}, 11))"

    sql = re.sub(r"add\('(.)', (\d), (\w\.?\w?\[\d\])\)", lambda m: add(*m.groups()), OP12_SQL)
    stay = r"stay\('(.)', (\d), f\.fault, (b\.v\[\d\])\)"
    return re.sub(stay, lambda m: f"CASE f.fault WHEN 0 THEN {add(*m.groups())} WHEN 3 THEN {add(m[1], f'{m[2]} + 1', m[3])} ELSE '~' END", sql)


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`, a tenth of them with their last words overwritten by repeats of a few before them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", text_or_empty("text").alias("text"), (h % 10 == 0).alias("hit"), (h / 10).cast("long").alias("g"))
    words = F.when(F.coalesce("hit", F.lit(False)), words_of(F.col("text")))
    n = F.size("w").cast("long")
    docs = docs.select("doc_id", "text", "g", words.alias("w")).select("*", n.alias("n"), (F.col("g") % n).alias("a"))
    docs = docs.withColumn("p", F.lit(1) + F.expr("(n - a) div (3 + g % 8)"))
    unit = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.expr("(n - a) div p + 1").cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(read_table(spark, sf_dir, "documents")), least_words=12)
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))  # noqa: E731
    return found.withColumn("most", longest_run(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality_rules": op2_quality_rules,
        "op3_license_scans": op3_license_scans,
        "op4_sharding": op4_sharding,
        "op5_mixing": op5_mixing,
        "op6_secret_scans": op6_secret_scans,
        "op7_decontamination": op7_decontamination,
        "op8_token_counts": op8_token_counts,
        "op9_pii": op9_pii,
        "op10_line_dedup": op10_line_dedup,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scans": _op3_sql(),
        "op5_mixing": OP5_SQL,
        "op7_decontamination": OP7_SQL,
        "op10_line_dedup": OP10_SQL,
        "op12_conversation_repair": _op12_sql(),
    }
