"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, uniform_key, with_positions, written

#: A partition has at least so many rows, and there are at most so many partitions, so the matrix
#: has at most MOST_PARTITIONS times n_shards numbers, whatever the size of the table.
PARTITION_ROWS, MOST_PARTITIONS = 2048, 4096


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard, drawn as a uniform shuffle would send them.

    Row sums are ``rows``; column sums are the shard sizes, which differ by at most one (the first
    shards are the larger ones). Row after row is multivariate hypergeometric on what is left.
    """
    rng = np.random.default_rng(seed)
    total = sum(rows)
    left = np.array([total // n_shards + (j < total % n_shards) for j in range(n_shards)], dtype=np.int64)
    out = np.zeros((len(rows), n_shards), dtype=np.int64)
    for i, n in enumerate(rows):
        # Drawn shard by shard: numpy's joint form refuses populations of a billion or more.
        rest, need = int(left.sum()), int(n)
        for j in range(n_shards):
            rest -= int(left[j])
            out[i, j] = _draw(rng, int(left[j]), rest, need)
            need -= int(out[i, j])
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good.

    From a billion on, where numpy stops, by inversion over 40 standard deviations around the mean.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 1_000_000_000 and good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    pop = good + bad
    mean = n * good / pop
    reach = 40 * math.sqrt(max(1.0, mean * (bad / pop) * (pop - n) / (pop - 1))) + 1
    ks = np.arange(max(0, n - bad, int(mean - reach)), min(n, good, int(mean + reach) + 1) + 1)
    # Ratios of neighbouring probabilities keep the precision that factorials of 10^10 would lose.
    k = ks[:-1].astype(float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1)))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(ks[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(max=len(ks) - 1)])


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 0, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    The order is a uniform shuffle that depends on the seed and the rows alone, not on the layout of
    the table, so a lost executor's work is redone alike. Shard sizes differ by at most one row. Rows
    that are equal in every column (nulls included) are counted, not gathered, and each copy is
    placed on its own. An empty table gives no rows. Columns must be comparable (no maps); one called
    like an added one is returned with ``_input`` after its name.
    """
    rows = apart(rows, "shard", "slot")
    given = rows.columns
    inner = rows.toDF(*[f"c{i}" for i in range(len(given))])
    names = inner.columns
    copies = (
        inner.groupBy(*names)
        .agg(F.count("*").alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .drop("_n")
    )
    copies = written(copies, "rows")
    total = copies.count()
    parts = max(1, min(MOST_PARTITIONS, -(-total // partition_rows)))
    placed = copies.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *names, "_copy"), F.lit(parts)).cast("int"))
    sizes = dict(placed.groupBy("_part").count().collect())  # at most MOST_PARTITIONS rows
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], n_shards, seed)
    sends = rows.sparkSession.createDataFrame(
        [(p, [int(x) for x in np.cumsum(a)]) for p, a in zip(order, matrix, strict=True)],
        "_part int, _ends array<long>",
    )
    # First permutation: a random order inside the partition decides who goes where.
    local = Window.partitionBy("_part").orderBy(
        F.xxhash64(F.lit(seed + 1), *names, "_copy"), *names, "_copy"
    )
    sent = (
        placed.withColumn("_at", F.row_number().over(local))
        .join(F.broadcast(sends), "_part")  # bounded, see MOST_PARTITIONS
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))).cast("int"))
    )
    shard_rows_ = F.lit(total // n_shards) + (F.col("shard") < total % n_shards).cast("long")
    # Second permutation: the exchange lands each row at a random place of its shard.
    out = with_positions(
        sent.withColumn("_rows", shard_rows_).withColumn("_key", uniform_key(*names, "_copy", seed=seed + 2)),
        "shard", "_key", [*names, "_copy"], "_rows",
    )
    return out.select(*[F.col(n).alias(g) for n, g in zip(names, given, strict=True)], "shard", F.col("position").alias("slot"))


def write_shards(sharded: DataFrame, path: str, slots_per_file: int = 1_000_000) -> None:
    """One folder per shard; files hold runs of slots, in order."""
    (
        sharded.withColumn("run", F.floor(F.col("slot") / slots_per_file).cast("long"))
        .repartition("shard", "run")
        .sortWithinPartitions("shard", "run", "slot")
        .write.partitionBy("shard", "run")
        .parquet(path)
    )
