"""Centroid clustering of embeddings: nearest centroids by the threshold algorithm, exact integer means."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Larger integer components are held at this bound, below which every distance fits in a long.
LARGEST = 2**27


class Lists:
    """For every dimension, the centroids in the order of their value there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) per row; the smaller number on a tie.

        All lists are walked outward from the row's own value, the nearer neighbour first. A centroid
        that comes up gets its exact distance. No centroid that has not come up is nearer than the sum
        of the squared gaps at the frontiers; when that is strictly above the best distance, the row
        is done, for even a tie would have come up. A row that has met all centroids is done as well.
        """
        count, dims = self.centroids.shape
        best = np.full(len(rows), -1, dtype=np.int64)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        at = np.arange(len(rows))
        # Frontiers: the next value above and below, per row and dimension.
        up = np.stack([np.searchsorted(self.values[d], rows[:, d]) for d in range(dims)], axis=1)
        down = up - 1
        seen = np.zeros((len(rows), count), dtype=bool)
        dim = np.arange(dims)
        far = np.int64(4 * LARGEST)
        for _ in range(count):
            if not len(at):
                break
            own = rows[at]
            above = np.where(up < count, self.values[dim, np.minimum(up, count - 1)] - own, far)
            below = np.where(down >= 0, own - self.values[dim, np.maximum(down, 0)], far)
            rising = above <= below
            taken = self.order[dim, np.where(rising, np.minimum(up, count - 1), down)]
            frontier = np.minimum(above, below)
            up, down = up + rising, down - ~rising
            fresh = np.zeros_like(seen)
            fresh[np.arange(len(at))[:, None], taken] = True
            fresh &= ~seen
            seen |= fresh
            for c in np.flatnonzero(fresh.any(axis=0)):
                who = np.flatnonzero(fresh[:, c])
                gap = own[who] - self.centroids[c]
                distance = np.einsum("ij,ij->i", gap, gap)
                spot = at[who]
                better = (distance < least[spot]) | ((distance == least[spot]) & (c < best[spot]))
                least[spot[better]], best[spot[better]] = distance[better], c
            open_ = np.flatnonzero((np.einsum("ij,ij->i", frontier, frontier) <= least[at]) & ~seen.all(axis=1))
            at, up, down, seen = at[open_], up[open_], down[open_], seen[open_]
        return best, least


def integer_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the vectors with exactly ``components`` finite components: floor(scale * x), 4 bytes each."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter((F.size("v") == components) & finite)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * flat), -LARGEST, LARGEST)
            whole = whole.astype("<i4").reshape(b.num_rows, components)
            packed = pa.array([row.tobytes() for row in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary")


def seeds(vectors: DataFrame, components: int = COMPONENTS, count: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, in ascending hash order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    # A top-k of ``count`` rows; equal ids by content, so that reruns agree.
    chosen = vectors.filter("vec_id is not null").orderBy(digest, F.hex("vec")).select("vec").limit(count).collect()
    return np.array([np.frombuffer(r["vec"], "<i4") for r in chosen], dtype=np.int64).reshape(-1, components)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance; nothing is shuffled."""
    # count x components integers, whatever the input.
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        lists = Lists(shared.value)
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, -1).astype(np.int64)
            cluster, distance = lists.nearest(rows) if b.num_rows else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each centroid's vectors; a centroid without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    count, components = centroids.shape

    def run(batches):
        import pyarrow as pa

        lists, sums, rows_of = Lists(shared.value), np.zeros((count, components), np.int64), np.zeros(count, np.int64)

        def out():
            some = np.flatnonzero(rows_of)
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(rows_of[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
                ["cluster", "n", "sums"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, -1).astype(np.int64)
            cluster, _ = lists.nearest(rows)
            for c in np.unique(cluster):
                sums[c] += rows[cluster == c].sum(axis=0)
                rows_of[c] += (cluster == c).sum()
            if rows_of.max() > 2**30:  # sums stay far inside a long
                yield out()
                sums[:], rows_of[:] = 0, 0
        yield out()

    # A task sends one row per centroid, so neither a hot cluster nor a large table meets in one place.
    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value"))
    sums = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    new = centroids.copy()
    for row in sums.collect():  # count x components numbers
        new[row["cluster"], row["at"]] = int(row["value"] if isinstance(row["value"], Decimal) else 0) // row["n"]
    return new


def clustered(
    embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 1
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors with exactly ``components`` components, none null or non-finite, are kept, as integers
    floor(scale * x); others, null ones too, take no part. Integers beyond 2^27 are held there, so
    that distances fit in a long. The first centroids are the kept vectors with the smallest seeded
    hashes of their id (equal ids in the order of their content; rows without id are clustered but
    are no first centroid); with fewer rows there are fewer centroids. Each of ``rounds`` rounds
    assigns every vector to the nearest centroid (the smaller number on a tie) and moves each
    centroid that has vectors to their floored mean. Repeated rows count as often as they stand.
    Other columns are not read, so none can clash. An empty table, or one where no row has an id,
    gives no rows.
    """
    vectors = written(integer_vectors(embeddings, components, scale), "vectors")
    centroids = seeds(vectors, components, count, seed)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], kinds)
    for _ in range(rounds):
        centroids = _means(vectors, centroids)
    rows = written(_assigned(vectors, centroids), "assigned")
    # One row per centroid.
    inertia = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    total = sum(inertia.values())
    known = [
        (c, inertia[c], total, hashlib.sha256(",".join(map(str, values)).encode()).hexdigest(), values)
        for c, values in enumerate(centroids.tolist()) if c in inertia
    ]
    about = vectors.sparkSession.createDataFrame(
        known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    )
    return rows.join(F.broadcast(about), "cluster").select(*[k.split()[0] for k in kinds.split(", ")])
