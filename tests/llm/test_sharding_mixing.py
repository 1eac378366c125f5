"""Sharding and mixing: laws, exactness, awkward rows."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancyledger.llm import mixing, queries, sharding

from .conftest import AWKWARD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_matrix_has_exact_sums():
    rows = [0, 5, 17, 2048, 1]
    matrix = sharding.communication_matrix(rows, 8, seed=3)
    assert matrix.sum(axis=1).tolist() == rows
    total = sum(rows)
    assert matrix.sum(axis=0).tolist() == [total // 8 + (j < total % 8) for j in range(8)]


def test_matrix_is_hypergeometric():
    """Mean and variance of one cell against the closed form."""
    cells = np.array([sharding.communication_matrix([40, 60], 4, seed=s)[0, 0] for s in range(3000)])
    mean, var = 40 * 0.25, 40 * 0.25 * 0.75 * 60 / 99
    assert abs(cells.mean() - mean) < 4 * (var / 3000) ** 0.5
    assert abs(cells.var() - var) < 0.25 * var


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3_000_000_000, 9_000_000_000, 100_000
    got = np.array([sharding._draw(rng, good, bad, n) for _ in range(300)])
    assert abs(got.mean() - n / 4) < 5 * (n * 3 / 16 / 300) ** 0.5
    assert 0.7 < got.var() / (n * 3 / 16) < 1.4


def test_shards_are_gapless_and_near_equal(spark, sample):
    rows = sharding.shard_rows(sample("documents").select("doc_id", "source"), 8, seed=1, partition_rows=16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == list(range(len(rows)))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_rows(sample("documents").repartition(5).select("doc_id", "source"), 8, seed=1, partition_rows=16)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_places_are_uniform(spark):
    """Over seeds, a row is as often in each shard and each half of it."""
    df = spark.range(40).select(F.col("id").alias("doc_id"))
    seen = Counter()
    for seed in range(12):
        for r in sharding.shard_rows(df, 4, seed=seed, partition_rows=10).collect():
            seen[r.shard, r.slot // 5, r.doc_id % 2] += 1
    counts = np.array([seen[s, h, p] for s in range(4) for h in range(2) for p in range(2)])
    assert counts.sum() == 480 and ((counts - 30) ** 2 / 30).sum() < 45


def test_shards_of_awkward_rows(awkward, nothing, tmp_path, spark):
    got = sharding.shard_rows(awkward, 3).collect()
    assert len(got) == len(AWKWARD) and {r.shard for r in got} == {0, 1, 2}
    assert "shard_input" in got[0].asDict() and sum(r.doc_id == 4 for r in got) == 2
    assert sharding.shard_rows(nothing, 3).count() == 0
    copies = sharding.shard_rows(spark.range(1).crossJoin(spark.range(100)).select(F.lit(1).alias("doc_id")), 4)
    assert [r["count"] for r in copies.groupBy("shard").count().collect()] == [25] * 4
    out = f"{tmp_path}/shards"
    sharding.write_shards(copies, out, slots_per_file=10)
    assert spark.read.parquet(out).count() == 100


def filled(sizes, weights, epochs):
    """Targets by clamping round after round, in exact fractions."""
    total, free, out = Fraction(sum(sizes)), list(range(len(sizes))), {}
    while True:
        left = total - sum(out.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] >= epochs * sizes[i]]
        if not over:
            return [out.get(i, share.get(i)) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(epochs * sizes[i])
            free.remove(i)
        if not free:
            return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 1000, 1, 1], [0, 0, 7], [100, 1, 2, 3, 1, 1, 90], [0, 0]])
def test_targets_equal_round_after_round(spark, sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    df = spark.createDataFrame([(i + 1, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "ord int, source_size long, weight int")
    got = [r.target for r in mixing.water_filling(df, 3).orderBy("ord").collect()]
    assert got == pytest.approx([float(x) for x in filled(sizes, weights, 3)])


def test_mix_meets_targets(documents):
    docs = documents([(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 5 else None) for i in range(200)] + [(999, "x " * 3, "tiny")])
    rows = mixing.mixture(docs, seed=5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert own[0].target <= 3 * own[0].source_size
    assert all(r.taken <= 3 * r.size for r in rows)
    again = mixing.mixture(docs.repartition(7), seed=5).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mixing.mixture(awkward).collect()
    sizes = Counter((r.doc_id, r.size) for r in rows)
    assert sizes == Counter((i, len(WORDS.findall(t or ""))) for i, t, _ in AWKWARD)
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), abs=3)
    assert mixing.mixture(nothing).count() == 0


def test_mixed_documents_hold_the_words_taken(awkward, nothing, documents):
    for docs in (awkward, documents([(i, " a  b c" * (i + 1), f"s{i % 4}") for i in range(30)])):
        mixed = mixing.mixed_documents(docs)
        assert mixed.dtypes == docs.dtypes
        taken = {}
        for r in mixing.mixture(docs).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        words = Counter()
        for r in mixed.collect():
            words[r.doc_id] += len(WORDS.findall(r.text))
            assert r.n_chars == len(r.text)
        assert words == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_documents(nothing).count() == 0


def test_query_shape(spark):
    df = queries.op2_hypergeometric_shards(spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
