"""Ordered computations that stay balanced when one key holds a large share of the rows.

A plain window sends all rows of a key to one task. Here the key is cut into chunks of its
order (say, months): the window runs inside a chunk, one summary row per chunk is carried
across chunks, and the two are joined on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, all columns kept. Copies of a key are
    reduced before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[c if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def dedupe_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str
) -> DataFrame:
    """Last row per key, with the place of the first one and the number of copies."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"),
        F.min(position).alias("first_position"),
        F.count(F.lit(1)).alias("copies"),
    )
    kept = [c if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns]
    return picked.select(*kept, "first_position", "copies")


def _carry_join(
    local: DataFrame, summary: DataFrame, keys: Sequence[str], chunk: str
) -> DataFrame:
    renamed = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(chunk).alias("_k_chunk"),
        *[c for c in summary.columns if c not in {*keys, chunk}],
    )
    condition = F.col(chunk).eqNullSafe(F.col("_k_chunk"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(renamed, condition, "left")
    return joined.drop("_k_chunk", *[f"_k_{k}" for k in keys])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
) -> DataFrame:
    """Add ``prev_<value>`` of the preceding row of the key and ``is_first``."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    local = (
        df.withColumn("_chunk", chunk)
        .withColumn("_here", F.lag(F.struct(F.lit(True).alias("hit"), *values)).over(inside))
        .withColumn("_last", F.lead(F.lit(False), 1, True).over(inside))
    )
    ends = local.where("_last").select(
        *keys, "_chunk", F.struct(F.lit(True).alias("hit"), *values).alias("_end")
    )
    summary = ends.withColumn("_before", F.lag("_end").over(across)).drop("_end")
    joined = _carry_join(local, summary, keys, "_chunk")
    source = F.coalesce(F.col("_here"), F.col("_before"))
    out = joined.withColumn("_prev", source)
    return out.select(
        *df.columns,
        *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values],
        F.col("_prev").isNull().alias("is_first"),
    )


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
) -> DataFrame:
    """Add ``next_<value>`` of the following row of the key."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    local = (
        df.withColumn("_chunk", chunk)
        .withColumn("_here", F.lead(F.struct(F.lit(True).alias("hit"), *values)).over(inside))
        .withColumn("_first", F.lag(F.lit(False), 1, True).over(inside))
    )
    starts = local.where("_first").select(
        *keys, "_chunk", F.struct(F.lit(True).alias("hit"), *values).alias("_start")
    )
    summary = starts.withColumn("_after", F.lead("_start").over(across)).drop("_start")
    joined = _carry_join(local, summary, keys, "_chunk")
    out = joined.withColumn("_next", F.coalesce(F.col("_here"), F.col("_after")))
    return out.select(*df.columns, *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])


def with_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add, per name, the sum of an expression over this and all earlier rows of the key."""
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumn("_chunk", chunk)
    for name, value in sums.items():
        local = local.withColumn(f"_v_{name}", value)
    totals = local.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    summary = totals.select(
        *keys, "_chunk", *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums]
    )
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(inside))
    joined = _carry_join(local, summary, keys, "_chunk")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_b_{n}", zero)).alias(n)
            for n in sums
        ],
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Each task keeps at most ``k`` rows of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str
) -> DataFrame:
    """Add the place of each row within its key, from 1. ``chunk`` never falls along ``order``; a task
    orders one chunk and carries the sizes of the chunks before it."""
    placed = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = _carry_join(placed.withColumn("_here", F.row_number().over(inside)), before, keys, "_chunk")
    return joined.withColumn(name, (F.col("_here") + F.col("_before")).cast("bigint")).select(*df.columns, name)


class Sort(NamedTuple):
    """A sort column and its direction; the last of an order names every row."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()

    def beyond(self, value: Column) -> Column:
        return F.col(self.column) < value if self.descending else F.col(self.column) > value


def page_starts(df: DataFrame, order: Sequence[Sort], size: int, chunk: Column) -> DataFrame:
    """Page index of a sorted listing: page number from 1, and the sort columns of its first row.

    ``chunk`` never falls along the order (say, the day of a time), so no task orders the listing.
    """
    rows = numbered(df.select(*[s.column for s in order], chunk.alias("_part")).withColumn("_all", F.lit(0)), ["_all"],
                    [s.order() for s in order], F.col("_part"), "_place")
    first = rows.where((F.col("_place") - 1) % size == 0)
    return first.select(((F.col("_place") - 1) / size + 1).cast("bigint").alias("page"), *[s.column for s in order])


def page_from(df: DataFrame, order: Sequence[Sort], start: Sequence, size: int, after: bool = False) -> DataFrame:
    """``size`` rows of a sorted listing from the row with these sort values on (or after it).

    A seek: rows before the start are filtered by the scan, and each task keeps at most ``size`` rows,
    so a deep page costs what the first one does. Sort columns hold no nulls.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")
    wanted, equal = F.lit(False), F.lit(True)
    for sort, value in zip(order, start, strict=True):
        value = value if isinstance(value, Column) else F.lit(value)
        wanted = wanted | (equal & sort.beyond(value))
        equal = equal & (F.col(sort.column) == value)
    chosen = df.where(wanted if after else wanted | equal)
    return chosen.orderBy(*[s.order() for s in order]).limit(size)


def page(
    df: DataFrame, order: Sequence[Column], number: int, size: int
) -> DataFrame:
    """One page of a sorted listing; pages count from 1 and hold 1 to 100 rows. All rows before a deep
    page pass one task; ``page_from`` seeks instead."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be >= 1 and page size between 1 and 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
