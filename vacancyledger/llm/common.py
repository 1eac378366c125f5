"""Helpers that several operators share: words, written intermediate tables, ordered positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters outside these six; ``bytes.split()`` splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors all see.

    It lies in the folder that ``spark.checkpoint.dir`` names; only where that is unset (tests) it
    lies in the session's warehouse, which Spark shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to a shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{temporary_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str) -> DataFrame:
    """Like :func:`written`, in buckets of ``key``: a later join on that column alone moves just the
    other side. ``df`` should come out of a join on ``key``, so that a task holds whole buckets."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{temporary_folder(spark)}/buckets"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def temporary_folder(spark: SparkSession) -> str:
    """A shared folder that the file system deletes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return str(path.toString())


class Scratch:
    """Written tables of one computation, deleted as soon as they are no longer needed.

    A table written under a name takes the place of the earlier one, whose files are deleted then;
    all others go when the block ends. Inside the block Spark deletes a query's shuffle files as the
    query ends: what later queries need lies in tables, so nothing is computed again.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.buckets = spark, temporary_folder(spark), {}, {}
        self.count, self.before = 0, spark.conf.get(self._CLEAN, "false")

    def __enter__(self) -> Scratch:
        self.spark.conf.set(self._CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self._CLEAN, self.before)
        self.drop(*self.buckets, *self.paths)
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _place(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{name}-{self.count}"

    def written(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Like :func:`written`; deletes the table that had the name before."""
        path = self._place(name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` in buckets of ``key``: a later join on that column moves just the other side. It should
        come out of a join or grouping by ``key``, so that a task holds whole buckets."""
        table, path = f"llm_{uuid.uuid4().hex}", self._place(name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd")
        dealt.option("path", path).saveAsTable(table)
        self.drop(name)
        self.paths[name], self.buckets[name] = path, table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self.buckets.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path := self.paths.pop(name, None):
                self._delete(path)


def apart(df: DataFrame, *added: str) -> DataFrame:
    """``df`` with ``_input`` after the names of columns that an operator is about to add."""
    taken = {c.lower() for c in df.columns}
    names = []
    for c in df.columns:
        if c.lower() in added:
            while c.lower() in taken:
                c += "_input"
            taken.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def columns_of(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the named columns, cast, so that nothing else in the table can clash with ours."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def map_rows(df: DataFrame, rows: Callable[[dict], Iterator[tuple]], schema: str, block: int = 20_000) -> DataFrame:
    """``mapInArrow`` over column lists; ``rows`` yields tuples that are sent on in blocks."""
    spark_schema = _schema(schema)
    names = spark_schema.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def batch(part: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*part, strict=True)) if part else [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
        )

    def run(batches):
        part: list[tuple] = []
        for b in batches:
            for row in rows({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}):
                part.append(row)
                if len(part) >= block:
                    yield batch(part)
                    part = []
        yield batch(part)

    return df.mapInArrow(run, spark_schema)


def _schema(text: str):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    parsed = _parse_datatype_string(text)
    return parsed if isinstance(parsed, StructType) else StructType([StructField("value", parsed)])


def uniform_key(*columns, seed: int) -> F.Column:
    """A seeded hash of the columns, uniform in [0, 2^62)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)


def with_positions(
    df: DataFrame,
    group: str,
    key: str,
    ties: list[str],
    group_rows: str,
    amount: str | None = None,
    rows_per_range: int = 256,
) -> DataFrame:
    """Add ``position`` (from 0, gapless) of each row in its group, ordered by ``key`` then ``ties``.

    ``group`` and ``key`` are never null; ``key`` is uniform in [0, 2^62) (see :func:`uniform_key`);
    the column ``group_rows`` says how many rows the row's group has. A group is cut into key ranges
    of about ``rows_per_range`` rows, each ordered on its own, and a range starts where the ranges
    before it end, so no task holds a group. With ``amount``, ``before`` is the sum of that column
    over the rows before.
    """
    ranges = F.greatest(F.lit(1), F.ceil(F.col(group_rows) / rows_per_range).cast("long"))
    cut = F.least(ranges - 1, F.floor(F.col(key).cast("double") / F.lit(float(2**62)) * ranges))
    placed = df.withColumn("_range", cut.cast("long"))
    total = F.sum(F.col(amount)).alias("_amount") if amount else F.lit(0).alias("_amount")
    starts = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "_range")
        .agg(F.count("*").alias("_rows"), total)
        .select(
            group,
            "_range",
            F.coalesce(F.sum("_rows").over(starts), F.lit(0)).alias("_first"),
            F.coalesce(F.sum("_amount").over(starts), F.lit(0)).alias("_before"),
        )
    )
    inside = Window.partitionBy(group, "_range").orderBy(key, *ties)
    placed = placed.withColumn("_at", F.row_number().over(inside) - 1)
    if amount:
        upto = inside.rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_sum", F.coalesce(F.sum(amount).over(upto), F.lit(0)))
    out = placed.join(offsets, [group, "_range"]).withColumn(
        "position", (F.col("_first") + F.col("_at")).cast("long")
    )
    if amount:
        out = out.withColumn("before", F.col("_before") + F.col("_sum"))
    return out.drop("_first", "_before", "_at", "_sum", "_range")
