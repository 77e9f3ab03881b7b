import pathlib
from collections import Counter

import corpus_pipeline
from arbolith.llm.common import shared_folder
from test_decontaminate import brute as brute_hits
from test_quality import brute as brute_quality
from test_similar import brute as brute_similar


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    (_, quality), (_, dedup), (_, clean), (_, mix), (_, shard) = corpus_pipeline.STAGES

    kept = quality(spark, docs, small).cache()
    rows = docs.collect()
    passed = {r.doc_id for r in kept.collect()}
    failed = {r.doc_id for r in rows if brute_quality(r.text)[0][-1]}
    assert kept.columns == docs.columns and not passed & failed and len(passed) >= 0.95 * (len(rows) - len(failed))

    one = dedup(spark, kept, small).cache()
    want = brute_similar([(r.doc_id, r.text) for r in kept.collect()])
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == want

    pure = clean(spark, one, small).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, n, hit, _ in brute_hits([(r.doc_id, r.text) for r in one.collect()], items) if hit and 20 * hit >= n}
    assert pure.columns == docs.columns
    assert {str(r.doc_id) for r in pure.collect()} == {str(r.doc_id) for r in one.collect()} - bad

    mixed = mix(spark, pure, small).cache()
    assert mixed.columns == docs.columns
    size = {r.doc_id: len(r.text.encode().split()) for r in pure.collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.encode().split())
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 20

    sharded = shard(spark, mixed, small)
    assert sharded.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    assert sorted((r.doc_id, r.text) for r in sharded.collect()) == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_run_applies_all_stages(spark, small):
    got = corpus_pipeline.run(spark, small).groupBy("shard").count().collect()
    assert len(got) == 16


def test_run_deletes_stages_or_goes_on_after_them(spark, small, tmp_path):
    before = {p.name for p in shared(spark).iterdir()}
    corpus_pipeline.run(spark, small)
    (new,) = [p for p in shared(spark).iterdir() if p.name.startswith("pipeline-") and p.name not in before]
    assert [p.name for p in new.iterdir()] == ["mixing"]
    whole = corpus_pipeline.run(spark, small, f"file://{tmp_path}/run").count()
    stages = sorted((p.name, (p / "_SUCCESS").stat().st_mtime_ns) for p in (tmp_path / "run").iterdir())
    assert [n for n, _ in stages] == ["decontaminate", "mixing", "near_dedup", "quality"]
    (tmp_path / "run" / "mixing" / "_SUCCESS").unlink()
    assert corpus_pipeline.run(spark, small, f"file://{tmp_path}/run").count() == whole
    again = sorted((p.name, (p / "_SUCCESS").stat().st_mtime_ns) for p in (tmp_path / "run").iterdir())
    assert [a == b for a, b in zip(stages, again)] == [True, False, True, True]


def shared(spark):
    return pathlib.Path(shared_folder(spark).removeprefix("file:"))


def test_odd_rows(spark, odd, empty, small):
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        assert docs.count() <= 2 * rows.count()
