"""Writes. Observations and matches are append-only; the job snapshot is versioned.

A snapshot version is named by a pointer file that is written last, so a reader never sees half a
version and a failed write leaves the old one in force. It is a complete folder, or, for tables that
batches change in part, a manifest that names the folder of each bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.matching import MEMO_KEY
from .tables import SCHEMAS


def write_observations(observations: DataFrame, path: str, batch: str) -> None:
    """Append the observations of a batch of scans. The batch has a folder of its own, so writing
    it again, whatever the dates, replaces its own rows and nothing else."""
    rows = observations.withColumn("observed_date", F.to_date("observed_at"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "observed_date"
    ).parquet(f"{path}/batch={batch}")


#: Folders of match results: what a lookup is about, then a bucket of jobs.
MATCH_FOLDERS = ("matcher_version", "profile_version", "bucket")


def write_matches(spark: SparkSession, matches: DataFrame, path: str) -> None:
    """Append match results whose memo key is not stored yet. Nothing stored is replaced, so a
    batch that arrives again, under whatever number, adds only what it lacks."""
    stored = stored_matches(spark, path, matches).select(*MEMO_KEY)
    append_matches(matches.join(stored, list(MEMO_KEY), "left_anti"), path)


def append_matches(fresh: DataFrame, path: str) -> None:
    """Append match results in folders of versions and buckets."""
    rows = fresh.withColumn("bucket", bucket_of("job_id")).hint("rebalance", *MATCH_FOLDERS)
    rows.write.mode("append").partitionBy(*MATCH_FOLDERS).parquet(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Stored match results (none, if nothing was stored) and their ``bucket``."""
    # Declared: a version is text, whatever it looks like in the name of a folder.
    schema = spark.createDataFrame([], f"{SCHEMAS['matches']}, bucket int").schema
    found = _or_none(lambda: spark.read.schema(schema).parquet(path))
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


def stored_matches(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The stored results that may hold a key of ``wanted`` (job_id, profile_version, matcher_version): other
    versions of profile or matcher and other buckets are not read, so a small batch reads little of a long
    history."""
    # At most BUCKETS rows per version that occurs.
    folders = wanted.select("matcher_version", "profile_version", bucket_of("job_id").alias("bucket")).distinct().collect()
    stored = read_matches(spark, path)
    for name in MATCH_FOLDERS:
        stored = stored.where(F.col(name).isin([*{r[name] for r in folders}]))
    return stored


def _or_none(read):
    """The table, or None if its path does not exist; any other error is one."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return _or_none(lambda: spark.read.parquet(path))


#: Buckets of a table that batches change in part.
BUCKETS = 64


def bucket_of(key: str = "source_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_snapshot(df: DataFrame, root: str, version: int, name: str = "jobs") -> None:
    """Write one version of a table below ``root`` and then point to it."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/v={version:08d}")
    _point(df.sparkSession, root, version, name)


def _point(spark: SparkSession, root: str, version: int, name: str) -> None:
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode(
        "append"
    ).json(f"{root}/{name}_pointer")


def write_buckets(
    df: DataFrame, root: str, base: int | None, touched: list[int], name: str = "jobs", key: str = "source_id"
) -> None:
    """The version after ``base`` (None: the first) in which only the ``touched`` buckets of ``key`` are new.

    ``df`` holds all rows of those buckets. They are written, then a manifest that names the version
    of every bucket (the others keep theirs), then the pointer; so a reader sees a whole version, and
    a batch that fails and comes again replaces its own files. A base that is one whole folder is
    brought into buckets.
    """
    spark, version = df.sparkSession, (base or 0) + 1
    held = {} if base is None else _manifest(spark, root, name, base)
    if held is None:
        whole = read_snapshot(spark, root, name, base)
        df, held = df.unionByName(whole.where(~bucket_of(key).isin(touched))), {}
    path = f"{root}/{name}/v={version:08d}"
    # Rebalanced, not hashed, so that the bucket of a hot key is written by many tasks.
    rows = df.withColumn("bucket", bucket_of(key)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
    written = spark.read.schema("bucket int").parquet(path).distinct().collect()  # at most BUCKETS rows
    held = {b: v for b, v in held.items() if b not in touched} | {r["bucket"]: version for r in written}
    manifest = spark.createDataFrame(sorted(held.items()), "bucket int, version int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/{name}_manifest/v={version:08d}")
    schema = spark.createDataFrame([(df.schema.json(),)], "schema string")
    schema.coalesce(1).write.mode("overwrite").json(f"{root}/{name}_schema/v={version:08d}")
    _point(spark, root, version, name)


def _manifest(spark: SparkSession, root: str, name: str, version: int) -> dict[int, int] | None:
    """Version of each bucket that has rows; None for a version that is one whole folder."""
    reader = spark.read.schema("bucket int, version int")
    rows = _or_none(lambda: reader.json(f"{root}/{name}_manifest/v={version:08d}"))
    return None if rows is None else dict(rows.collect())


def snapshot_version(spark: SparkSession, root: str, name: str = "jobs") -> int | None:
    reader = spark.read.schema("version int")
    pointer = _or_none(lambda: reader.json(f"{root}/{name}_pointer"))
    return None if pointer is None else pointer.agg(F.max("version")).first()[0]


def read_snapshot(
    spark: SparkSession, root: str, name: str = "jobs", version: int | None = None, buckets: list[int] | None = None
) -> DataFrame | None:
    """A version of a table, the one in force by default. Of a table in buckets just the files of the
    given ``buckets`` are listed and read (all, if none are given)."""
    chosen = snapshot_version(spark, root, name) if version is None else version
    if chosen is None:
        return None
    held = _manifest(spark, root, name, chosen)
    if held is None:
        whole = spark.read.parquet(f"{root}/{name}/v={chosen:08d}")
        return whole if buckets is None else whole.where(bucket_of().isin(buckets))
    text = spark.read.schema("schema string").json(f"{root}/{name}_schema/v={chosen:08d}").first()[0]
    schema = StructType.fromJson(json.loads(text))
    paths = [f"{root}/{name}/v={v:08d}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def expire(spark: SparkSession, root: str, name: str = "jobs", keep: int = 2) -> list[str]:
    """Delete the bucket folders that none of the last ``keep`` versions names; their paths."""
    newest = snapshot_version(spark, root, name)
    if newest is None:
        return []
    kept = set()
    for version in range(max(0, newest - keep + 1), newest + 1):
        kept |= {(v, b) for b, v in (_manifest(spark, root, name, version) or {}).items()}
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, "v=*/bucket=*")) or []:
        path = folder.getPath()
        version, bucket = int(path.getParent().getName()[2:]), int(path.getName()[7:])
        # A version above the newest is being written.
        if version <= newest and (version, bucket) not in kept and fs.delete(path, True):
            gone.append(path.toString())
    return gone
