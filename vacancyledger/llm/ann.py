"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import directions, matrix, packed

#: The index is fitted on at most so many vectors (the smallest of a seeded hash).
FIT_VECTORS = 2048
#: Tables, hashes of a table, cells of a hash (the outer ones open), and a cell's width in deviations.
TABLES, HASHES, CELLS, WIDTH = 2, 8, 3, 1.2
#: Estimated chance with which a neighbour lies in a probed bucket.
SUCCESS = 0.96
#: Rows of one comparison block, on either side.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Index:
    """Projections, cell borders and spread per table; which block a bucket's rows are in."""

    axes: np.ndarray  # table, hash, component
    borders: np.ndarray  # table, hash, cells + 1
    mean: np.ndarray  # table, hash
    spread: np.ndarray  # table, hash
    cosine: float  # of a k-th neighbour, for the estimate

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket number per row and table."""
        place = CELLS ** np.arange(HASHES)
        out = []
        for axes, borders in zip(self.axes, self.borders, strict=True):
            at = unit @ axes.T
            cells = (at[:, :, None] >= borders[None, :, 1:-1]).sum(axis=2)
            out.append(cells @ place)
        return np.stack(out, axis=1)

    def chances(self, unit: np.ndarray) -> np.ndarray:
        """Per table and bucket, the estimated chance that a neighbour of this vector lies there.

        A neighbour at cosine c projects to c times the vector's projection, with what is left of the
        spread around it; the hashes of a table are independent.
        """
        c, rest = self.cosine, math.sqrt(max(1e-6, 1 - self.cosine**2))
        centre = c * (self.axes @ unit) + (1 - c) * self.mean
        below = _normal((self.borders - centre[:, :, None]) / (self.spread * rest)[:, :, None])
        cells = np.diff(below, axis=2)
        out = np.ones((len(cells), 1))
        for h in range(HASHES):  # the first hash is the lowest digit of a bucket number
            out = (cells[:, h, :, None] * out[:, None, :]).reshape(len(cells), -1)
        return out

    def probes(self, unit: np.ndarray) -> np.ndarray:
        """Buckets to visit (table times buckets + bucket), most promising first.

        Over all tables, until the chance that one of them shows a neighbour is ``SUCCESS``.
        """
        chance = self.chances(unit)
        order = np.argsort(-chance, axis=None, kind="stable")
        missed = np.ones(len(order))
        for t in range(len(chance)):
            missed *= 1 - np.minimum(1.0, np.cumsum(np.where(order // chance.shape[1] == t, chance.ravel()[order], 0.0)))
        return order[: int(np.searchsorted(-missed, -(1 - SUCCESS))) + 1]


def _normal(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, infinite borders included (error below 1e-7)."""
    z = np.clip(np.nan_to_num(x, posinf=40, neginf=-40), -40, 40) / math.sqrt(2)
    t = 1 / (1 + 0.5 * np.abs(z))
    # Fixed coefficients of the rational approximation of erfc in common use.
    poly = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    tail = 0.5 * t * np.exp(-z * z + poly)
    return np.where(z >= 0, 1 - tail, tail)


def fit_index(sample: np.ndarray, total: int, k: int, seed: int) -> Index:
    """Gaussian (2-stable) directions, borders a random offset apart from the mean, and the cosine that
    a k-th neighbour among ``total`` vectors has, read off the pairs of the sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    axes = rng.normal(size=(TABLES, HASHES, dim))
    axes /= np.linalg.norm(axes, axis=2, keepdims=True)
    at = np.einsum("nd,thd->nth", sample, axes)
    mean, spread = at.mean(axis=0), np.maximum(at.std(axis=0), 1e-9)
    offset = (rng.random((TABLES, HASHES)) - 0.5) * 0.5
    inner = (np.arange(1, CELLS) - CELLS / 2)[None, None, :] - offset[:, :, None]
    borders = np.concatenate(
        [
            np.full((TABLES, HASHES, 1), -np.inf),
            mean[:, :, None] + WIDTH * spread[:, :, None] * inner,
            np.full((TABLES, HASHES, 1), np.inf),
        ],
        axis=2,
    )
    return Index(axes, borders, mean, spread, neighbour_cosine(sample, total, k))


def neighbour_cosine(sample: np.ndarray, total: int, k: int) -> float:
    """Cosine of the k-th neighbour among ``total`` vectors, for three of four vectors of the sample.

    Each vector's own cosines give its value at the 8th largest or, in a smaller table, at k of all;
    beyond the sample it is carried on as the tail of a normal distribution. So dense groups, whose
    members have far nearer neighbours, do not stand for the rest.
    """
    if len(sample) < 16:
        return 0.3
    cosines = sample @ sample.T
    np.fill_diagonal(cosines, -2)
    cosines = np.sort(cosines, axis=1)[:, 1:]
    middle = float(np.median(cosines))
    wanted = min(0.5, max(1e-15, k / max(total, 1)))
    seen = max(wanted, 8 / len(sample))
    at = np.quantile(cosines, 1 - seen, axis=1)
    usual = float(np.quantile(at, 0.25)) - middle
    far, near = (statistics.NormalDist().inv_cdf(1 - x) for x in (wanted, seen))
    return min(max(middle + usual * (far / near if near > 0.1 else 1.0), 0.0), 0.9)


def nearest(
    embeddings: DataFrame, is_query, k: int = 5, seed: int = 0, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine, in doubles on the original vectors).

    Queries are the rows for which ``is_query`` (a condition on the id column) holds; candidates are
    all vectors but those with the query's own id. Ties go to the smaller id. Vectors that cannot be
    measured take no part (see :func:`vectors.packed`). Repeated rows of an id count once. With fewer
    candidates than ``k``, a query gets them all; a query that its probes leave short is compared
    with every vector. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    cond = is_query(F.col("id"))
    rows, kind, dim = packed(embeddings, id_column, vector_column)
    rows = written(rows.dropDuplicates(["id"]), "vectors")
    total, n_queries = rows.count(), rows.filter(cond).count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total or not n_queries:
        return spark.createDataFrame([], schema)
    some = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(FIT_VECTORS).collect()
    index = fit_index(directions(matrix([r["vec"] for r in some], kind, dim)), total, k, seed)

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                found = index.buckets(directions(matrix(b.column(1).to_pylist(), kind, dim)))
                found = found + np.arange(TABLES) * CELLS**HASHES
                buckets = pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, buckets], ["id", "vec", "buckets"])

    index_rows = written(rows.mapInArrow(hashed, "id long, vec binary, buckets array<int>"), "index")
    # At most TABLES * CELLS^HASHES numbers.
    counts = dict(index_rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect())
    first, parts = _blocks(counts)
    bounds = spark.sparkContext.broadcast((index, first, parts))
    n_salts = max(1, -(-n_queries // BLOCK_ROWS))

    def dealt(batches):
        import pyarrow as pa

        _, first, parts = bounds.value
        for b in batches:
            buckets = b.column(2).flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(b.num_rows), TABLES)
            part = b.column(3).to_numpy(zero_copy_only=False)[at] % parts[buckets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(buckets, pa.int32()),
                 pa.array((first[buckets] + part).astype(np.int32))],
                ["id", "vec", "bucket", "block"],
            )

    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "id"), 1)
    placed = index_rows.select("id", "vec", "buckets", draw.alias("draw")).mapInArrow(
        dealt, "id long, vec binary, bucket int, block int"
    )

    def probing(everything: bool):
        def run(batches):
            import pyarrow as pa

            index, first, parts = bounds.value
            for b in batches:
                out = []
                for id_, vec, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), directions(matrix(b.column(1).to_pylist(), kind, dim)) if b.num_rows else [], strict=True):
                    probes = np.arange(CELLS**HASHES) if everything else index.probes(unit)
                    probes = probes[parts[probes] > 0]
                    by_block: dict[int, list[int]] = {}
                    for p in probes.tolist():
                        for j in range(int(parts[p])):
                            by_block.setdefault(int(first[p]) + j, []).append(p)
                    out += [(id_, vec, n, found) for n, found in by_block.items()]
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["id", "vec", "block", "probes"])

        return run

    def compare(queries, members):
        import pandas as pd

        if not len(queries) or not len(members):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v = matrix(queries["vec"], kind, dim), matrix(members["vec"], kind, dim)
        qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        ids, bucket = members["id"].to_numpy(), members["bucket"].to_numpy()
        near = (q / qn[:, None]) @ (v / vn[:, None]).T
        out = []
        for i, (id_, probes) in enumerate(zip(queries["id"], queries["probes"], strict=True)):
            at = np.flatnonzero(np.isin(bucket, probes) & (ids != id_))
            if len(at) > k:  # what may be among the first k, ties included
                least = np.partition(near[i, at], len(at) - k)[len(at) - k]
                at = at[near[i, at] >= least - 1e-9]
            score = (q[i] * v[at]).sum(axis=1) / (qn[i] * vn[at])
            best = np.lexsort((ids[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": id_, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out)

    def search(queries: DataFrame, everything: bool) -> DataFrame:
        probes = queries.select("id", "vec").mapInArrow(probing(everything), "id long, vec binary, block int, probes array<int>")
        probes = probes.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(n_salts)).cast("int"))
        members = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
        found = (
            probes.groupBy("block", "salt")
            .cogroup(members.select("id", "vec", "bucket", "block", "salt").groupBy("block", "salt"))
            .applyInPandas(compare, "query_id long, vec_id long, score double")
        )
        # The tables may both show a candidate.
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    queries = rows.filter(cond)
    found = written(search(queries, False).select(*[c.split()[0] for c in schema.split(", ")]), "found")
    enough = min(k, total - 1)
    complete = found.groupBy("query_id").count().filter(F.col("count") >= enough)
    short = written(queries.join(complete, F.col("id") == F.col("query_id"), "left_anti"), "short")
    if enough and not short.isEmpty():
        again = search(short, True).select(found.columns)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _blocks(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each bucket (0: empty).

    Neighbouring buckets share a block up to ``BLOCK_ROWS``; a larger bucket is dealt to several.
    """
    first = np.zeros(TABLES * CELLS**HASHES, dtype=np.int64)
    parts = np.zeros(TABLES * CELLS**HASHES, dtype=np.int64)
    now, rows = 0, 0
    for bucket in sorted(counts):
        n = counts[bucket]
        if rows and rows + n > BLOCK_ROWS:
            now, rows = now + 1, 0
        first[bucket], parts[bucket] = now, max(1, -(-n // BLOCK_ROWS))
        if parts[bucket] > 1:
            now, rows = now + int(parts[bucket]), 0
        else:
            rows += n
    return first, parts
