from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolith.llm import queries
from arbolith.llm.mixing import mix, mix_documents, seeded_hash, source_targets


def filled(sizes, weights, budget):
    """Water-filling by rounds: clamp what is above its cap, deal the excess by weight, again."""
    left, open_, target = Fraction(budget) * sum(sizes), set(range(len(sizes))), {}
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > 2 * sizes[i]]
        if not over:
            target |= {i: left * weights[i] / total for i in open_}
            break
        for i in over:
            target[i] = Fraction(2 * sizes[i])
            left -= target[i]
            open_.discard(i)
            total -= weights[i]
            if not open_:
                break
    return [float(target[i]) for i in range(len(sizes))]


@pytest.mark.parametrize(
    "sizes, budget", [([10, 20, 30, 40], 1.5), ([1, 1000, 1, 0, 7], 1.5), ([5, 5, 5], 1.9), ([100, 1, 1, 1, 1, 1, 1], 1.5), ([3], 2.5)]
)
def test_targets_equal_rounds(spark, sizes, budget):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    table = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = {r.source: r.target for r in source_targets(table, budget=budget).collect()}
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], Fraction(str(budget)))
    assert [got[n] for n in names] == pytest.approx(want)


def test_query_meets_targets(spark, small, sample):
    rows = queries.op5_mixing(spark, small).collect()
    source = {i: s for i, _, s in sample}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(0 <= t - taken[s] < 1.001 for s, t in target.items())
    assert sorted(rows) == sorted(queries.op5_mixing(spark, small).collect())


def by_order(rows, weights, budget):
    """Words that each (source, size, hash) gives: sorted by hash, whole rows until the fraction of the source is reached."""
    names = sorted({s for s, _, _ in rows if s is not None}) + [None] * any(s is None for s, _, _ in rows)
    sizes = [sum(n for t, n, _ in rows if t == s) for s in names]
    out = Counter()
    for s, size, target in zip(names, sizes, filled(sizes, [weights[i % len(weights)] for i in range(len(names))], budget)):
        ratio = target / size if size else 0.0
        left = int((ratio - int(ratio)) * size)
        for n, h in sorted(((n, h) for t, n, h in rows if t == s), key=lambda x: x[1]):
            out[s, n, h] = int(ratio) * n + min(left, n)
            left -= min(left, n)
    return out


def test_taken_equals_a_sort_of_each_source(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "nullif(source, 'src3') as source", "cast(length(text) as long) as size")
    hashed = docs.withColumn("h", seeded_hash("doc_id", F.lit(""), 17)).collect()
    want = by_order([(r.source, r.size, r.h) for r in hashed], (5, 2, 1), Fraction(3, 2))
    own = {r.doc_id: want[r.source, r.size, r.h] for r in hashed}
    for levels in ((1,), (2, 4)):
        assert {r.doc_id: r.mix_taken for r in mix(docs, levels=levels).collect()} == own


def test_documents_are_repeated(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = mix_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == {r.doc_id: r.taken for r in queries.op5_mixing(spark, small).collect() if r.taken}
    assert mix_documents(empty).collect() == [] and mix_documents(odd).columns == odd.columns
    assert sum(len((r.text or "").encode().split()) for r in mix_documents(odd).collect()) > 60000


def test_null_ids_of_one_source_are_spread(spark):
    """A third of all rows have a null id and one source, a third one id: the tie orders them; equal rows are taken alike."""
    rows = [(None, "a", 5 + i % 7, f"t{i}") for i in range(400)] + [(1, "a", 3 + i % 5, f"u{i}") for i in range(400)] + [(i, "b", 4, f"v{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, tie string")
    got = mix(table, tie=F.col("tie"), levels=(1,)).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.mix_taken <= 2 * r.size
        taken[r.source] += r.mix_taken
        target[r.source] = r.mix_target
    assert all(0 <= t - taken[s] < 1.001 for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mix(table.repartition(5), tie=F.col("tie")).collect()))
    alike = spark.createDataFrame([(None, "a", 10)] * 100 + [(i, "b", 10) for i in range(200)], "doc_id long, source string, size long")
    parts = {r.mix_taken for r in mix(alike, weights=(1,), budget=0.9).collect() if r.source == "a"}
    assert len(parts) == 1 and parts <= set(range(21))


def test_many_sources_are_ranked_by_ranges(spark):
    rng = np.random.default_rng(3)
    sizes = [(f"s{i:04d}", int(x)) for i, x in enumerate(rng.integers(0, 1000, 1500))] + [(None, 70)]
    table = spark.createDataFrame(sizes, "source string, size long").repartition(6)
    want = filled([n for _, n in sizes], [(5, 2, 1)[i % 3] for i in range(len(sizes))], Fraction(3, 2))
    got = {r.source: r for r in source_targets(table).collect()}
    assert [got[s].target for s, _ in sizes] == pytest.approx(want)
    assert [got[s].weight for s, _ in sizes] == [(5, 2, 1)[i % 3] for i in range(len(sizes))]


def test_other_columns_stay_as_they_are(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree {i}", "s", 7, 2) for i in range(9)], "doc_id long, text string, source string, n_chars int, size int")
    out = mix_documents(docs, weights=(1,), budget=1.3)
    assert out.schema == docs.schema
    whole = {f"one two\nthree {i}" for i in range(9)}
    for r in out.collect():
        assert r.size == 2 and (r.n_chars == 7 if r.text in whole else r.n_chars == len(r.text) and "\n" not in r.text)
