import os
import random

from pyspark.sql import functions as F

from arbolith.functions.blake3 import CHUNK, chunk_values, digest, file_digests, joined, joined_digests, merged, part_bytes_of, part_value, text_parts
from arbolith.plans import catalog

#: Published vectors: digests of the first n bytes of 0, 1, ..., 250, 0, 1, ...
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
}


def pattern(n):
    return bytes(i % 251 for i in range(n))


def test_published_vectors():
    assert {n: digest(pattern(n)) for n in VECTORS} == VECTORS


def test_any_split_gives_the_same_digest():
    rng = random.Random(1)
    for n in [*range(0, 200, 63), *(rng.randrange(40_000) for _ in range(20)), 4096, 8192, 8193]:
        content = rng.randbytes(n)
        whole = digest(content)
        for most in (1024, 2048, 5000, 8192, 1 << 20):
            step = part_bytes_of(most)
            parts = [content[i : i + step] for i in range(0, max(n, 1), step)]
            assert joined([part_value(p, k * step // CHUNK, len(parts) == 1) for k, p in enumerate(parts)]) == whole
    values = chunk_values(pattern(5 * CHUNK))
    assert merged(values, root=True)[:, 0].astype("<u4").tobytes().hex() == digest(pattern(5 * CHUNK))


def test_one_file_is_hashed_by_several_tasks(spark, tmp_path):
    contents = {"big": random.Random(2).randbytes(300_001), "empty": b"", "one": b"x", "even": pattern(4 * 8192)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(n, n, os.path.getsize(tmp_path / n)) for n in contents], "path string, raw_path string, size long")
    for part in (8192, 1 << 20):
        assert {r.path: r.hash for r in file_digests(files, str(tmp_path), part).collect()} == {n: digest(c) for n, c in contents.items()}


def test_query_equals_whole_texts(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.hash for r in catalog.content_digests(spark, small).collect()}
    assert got == {i: digest(t.encode()) for i, t in texts.items()}
    rows = spark.createDataFrame([(1, ""), (2, "é" * 3000)], "doc_id long, text string")
    parts = rows.select("doc_id", F.explode(text_parts(F.col("text"), 1024)).alias("p")).select("doc_id", "p.*")
    assert {r.doc_id: r.hash for r in joined_digests(parts, ["doc_id"]).collect()} == {1: digest(b""), 2: digest(("é" * 3000).encode())}
