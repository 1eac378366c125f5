"""Centroid clustering: search against all distances, rounds against exact integers, SQL, awkward rows."""

import hashlib

import numpy as np
import pytest

from tests.llm.sql import differences
from vacancyledger.llm import centroids
from vacancyledger.llm.queries import QUERIES

KINDS = "vec_id long, embedding array<float>"


def test_search_equals_all_distances():
    rng = np.random.default_rng(3)
    for trial in range(200):
        count, dims, spread = (int(rng.integers(1, 20)) for _ in range(3))
        places = rng.integers(-spread, spread + 1, (count, dims))
        if trial % 4 == 0:
            places[:] = places[0]
        rows = rng.integers(-spread, spread + 1, (40, dims))
        number, distance = centroids.Lists(places).nearest(rows)
        every = ((rows[:, None] - places[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_search_stops_early(monkeypatch):
    """Far centroids never come up: their distances are not computed."""
    places = np.array([[0] * 4, *[[10_000 + 50 * i] * 4 for i in range(9)]])
    asked = []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: asked.append(len(a)) or plain(how, a, b))
    number, _ = centroids.Lists(places).nearest(np.array([[1, 2, 3, 4]]))
    assert number.tolist() == [0] and len(asked) <= 4


def plain_clusters(rows, rounds=3, count=16):
    """Exact integers, vector by vector."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    places = [v for _, v in named[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        places = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(places)]
    return sorted(((i if i is not None else -1), *nearest(v)[::-1], tuple(places[nearest(v)[1]])) for i, v in kept)


def test_rounds_equal_plain_integers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).astype("float32").tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(None, rows[3][1])]
    got = centroids.clustered(spark.createDataFrame(rows, KINDS)).collect()
    mine = sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance, tuple(r.centroid)) for r in got)
    assert mine == plain_clusters(rows)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for r in got:
        assert r.cluster_inertia == sum(o.distance for o in got if o.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()


def test_a_centroid_without_vectors_stays(spark):
    """Equal first centroids: only the first of them gets vectors."""
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    got = centroids.clustered(spark.createDataFrame(rows, KINDS)).collect()
    assert len({r.cluster for r in got}) == 2 and {r.distance for r in got} == {0}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    plan, sql = QUERIES["op12_threshold_centroids"]
    assert differences(plan(spark, f"/root/testdata/{folder}"), sql, f"/root/testdata/{folder}") is None


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [nan] + [1.0] * 63), (7, [inf] * 64),
        (8, [0.0] * 64), (8, [0.0] * 64), (8, [1.0] * 64), (9, [3e38] * 64), (9, [-3e38] * 64), (None, [0.5] * 64), (None, None),
    ]
    df = spark.createDataFrame(rows, KINDS).selectExpr("*", "'x' AS cluster", "'y' AS vec", "'z' AS distance", "0 AS inertia")
    got = centroids.clustered(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect())
    assert [f[0] for f in found] == [-1, 8, 8, 8, 9, 9]
    assert found == sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in centroids.clustered(df.repartition(5)).collect())
    assert centroids.clustered(df.limit(0)).count() == 0
    assert centroids.clustered(df.filter("vec_id is null")).count() == 0
