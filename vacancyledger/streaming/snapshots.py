"""Folds kept as versioned tables, updated per micro-batch.

Each function returns a ``foreachBatch`` handler. Versions count on from the one in force, and what a
batch adds is decided by its rows (scans applied before, later patches, results stored before), never by
its number, which starts anew with a new checkpoint. So a batch that arrives again after a lost
executor, driver or checkpoint changes nothing, and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.health import scan_intervals
from ..operators.lifecycle import initial_import, reconcile
from ..operators.matching import local_scores, match_cache_misses, match_keys, matchable_jobs
from ..operators.profiles import user_state_latest
from ..session import ensure_checkpoint_dir
from ..sources import sinks, tables

Handler = Callable[[DataFrame, int], None]


def _previous(
    spark: SparkSession, root: str, name: str, empty: DataFrame, version: int | None, buckets: list[int] | None = None
) -> DataFrame:
    return empty if version is None else sinks.read_snapshot(spark, root, name, version, buckets)


def apply_scans(root: str, observations: Callable[[SparkSession], DataFrame]) -> Handler:
    """Reconcile arriving scan completion records (``scans`` columns) into ``root/jobs``.

    ``observations`` gives the stored observation table; a scan's rows are there before its
    completion record. Scans of one source are applied in order: round n applies the n-th open
    scan of every source at once, so rounds count the backlog of a source, not the sources. A scan
    that arrives after a later one of its source was applied makes that source's jobs anew, from all
    its scans in order; other sources are not touched. Jobs and the log of applied scans lie in buckets
    of sources: a batch reads and writes the buckets of its sources only.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        # The log that belongs to the job version in force; a log written by a batch that then
        # failed is not looked at.
        version = sinks.snapshot_version(spark, root, "jobs")
        columns = tables.empty(spark, "scans").columns
        usable = batch.select(*columns).where(
            F.col("status").isin("success", "success_with_warnings", "partial")
        )
        # At most as many rows as there are buckets.
        touched = [r[0] for r in usable.select(sinks.bucket_of()).distinct().collect()]
        if not touched and version is not None:
            return
        applied = _previous(spark, root, "applied_scans", tables.empty(spark, "scans"), version, touched)
        fresh = usable.dropDuplicates(["scan_run_id"]).join(
            applied.select("scan_run_id"), "scan_run_id", "left_anti"
        ).select(*columns)
        fresh = fresh.checkpoint()
        history = applied.unionByName(fresh)
        newest = applied.groupBy("source_id").agg(F.max("scan_seq").alias("_newest"))
        late = fresh.join(newest, "source_id").where(F.col("scan_seq") < F.col("_newest"))
        late = late.select("source_id").distinct().checkpoint()
        todo = fresh.select("scan_run_id")
        if not late.isEmpty():
            again = history.join(late, "source_id", "left_semi").select("scan_run_id")
            todo = todo.union(again).distinct()
        flagged = initial_import(history).join(todo, "scan_run_id", "left_semi")
        order = Window.partitionBy("source_id").orderBy("scan_seq", "scan_run_id")
        rounds = flagged.select(
            "source_id", "scan_run_id", "scan_seq", "complete",
            F.col("finished_at").alias("observed_at"),
            (~F.col("initial_import")).alias("prior_success"),
            F.row_number().over(order).alias("_round"),
        ).checkpoint()
        jobs = _previous(spark, root, "jobs", tables.empty(spark, "jobs"), version, touched)
        jobs = jobs.join(late, "source_id", "left_anti")
        last = rounds.agg(F.max("_round")).first()[0] or 0
        for number in range(1, last + 1):
            step = rounds.where(F.col("_round") == number)
            jobs, _ = reconcile(jobs, observations(spark), step)
            # The next round reads this one twice; cut here so that no round is recomputed.
            jobs = jobs.checkpoint()
        sinks.write_buckets(history, root, version, touched, "applied_scans")
        sinks.write_buckets(jobs, root, version, touched, "jobs")

    return handle


_STATE = """job_id string, seen boolean, seen_ts timestamp, seen_seq bigint, dismissed boolean,
    dismissed_ts timestamp, dismissed_seq bigint"""


def _as_patches(state: DataFrame) -> DataFrame:
    seen = state.where(F.col("seen").isNotNull()).select(
        "job_id", F.col("seen_ts").alias("ts"), F.col("seen_seq").alias("seq"), "seen",
        F.lit(None).cast("boolean").alias("dismissed"),
    )
    dismissed = state.where(F.col("dismissed").isNotNull()).select(
        "job_id", F.col("dismissed_ts").alias("ts"), F.col("dismissed_seq").alias("seq"),
        F.lit(None).cast("boolean").alias("seen"), "dismissed",
    )
    return seen.unionByName(dismissed)


def fold_user_states(root: str) -> Handler:
    """Keep the latest seen and dismissed patch per job in ``root/user_states``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = sinks.snapshot_version(spark, root, "user_states")
        old = _previous(spark, root, "user_states", spark.createDataFrame([], _STATE), version)
        patches = _as_patches(old).unionByName(
            batch.select("job_id", "ts", "seq", "seen", "dismissed")
        )
        at = F.struct("ts", "seq")
        picks = []
        for name in ("seen", "dismissed"):
            order = F.when(F.col(name).isNotNull(), at)
            best = F.max_by(F.struct(F.col(name).alias("v"), at.alias("at")), order)
            picks += [
                best["v"].alias(name), best["at"]["ts"].alias(f"{name}_ts"),
                best["at"]["seq"].alias(f"{name}_seq"),
            ]
        sinks.write_snapshot(
            patches.groupBy("job_id").agg(*picks), root, (version or 0) + 1, "user_states"
        )

    return handle


def read_user_states(spark: SparkSession, root: str) -> DataFrame:
    version = sinks.snapshot_version(spark, root, "user_states")
    state = _previous(spark, root, "user_states", spark.createDataFrame([], _STATE), version)
    return user_state_latest(_as_patches(state))


def match_arrivals(root: str, profiles: Callable[[SparkSession], DataFrame]) -> Handler:
    """Score jobs as they are observed: only content, profile versions and matcher versions not
    scored before. The batch holds rows of the job table. Results lie in folders of versions and
    buckets of jobs, and those that the batch can meet are read."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{root}/matches"
        jobs = matchable_jobs(batch.dropDuplicates(["job_id", "content_fingerprint"]))
        current = profiles(spark)
        stored = sinks.stored_matches(spark, path, match_keys(jobs, current))
        misses = match_cache_misses(jobs, current, stored)
        # Misses are not stored yet, so they are appended without another look.
        sinks.append_matches(local_scores(misses, current), path)

    return handle


_INTERVALS = """source_id string, interval_start timestamp, interval_end timestamp, scans bigint,
    successes bigint, late_scans bigint, newest timestamp"""
_COUNTED = "scan_run_id string, source_id string"


def fold_scan_intervals(root: str, late: str = "6 hours") -> Handler:
    """Keep ``scan_intervals`` of all scans that ever arrived in ``root/intervals``, however late.

    The batch holds finished scans: scan_run_id, source_id, status, finished_at. No row is dropped behind a
    watermark: one whose interval was final when it came (its end more than ``late`` before the newest
    scan of its source) is added all the same, and ``late_scans`` counts it. A scan counts once, under
    whatever batch it comes again. Rows without a scan_run_id or a time are in no interval. Buckets of
    sources that the batch does not hold are neither read nor written.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        version = sinks.snapshot_version(spark, root, "intervals")
        usable = batch.where("scan_run_id is not null and source_id is not null and finished_at is not null")
        touched = [r[0] for r in usable.select(sinks.bucket_of()).distinct().collect()]
        if not touched and version is not None:
            return
        # The log that belongs to the version in force, as in apply_scans.
        counted = _previous(spark, root, "counted_scans", spark.createDataFrame([], _COUNTED), version, touched)
        known = _previous(spark, root, "intervals", spark.createDataFrame([], _INTERVALS), version, touched)
        fresh = usable.dropDuplicates(["scan_run_id"]).join(counted.select("scan_run_id"), "scan_run_id", "left_anti")
        fresh = fresh.select("scan_run_id", "source_id", "status", "finished_at").checkpoint()
        clock = known.groupBy("source_id").agg(F.max("newest").alias("_clock"))
        final = F.col("interval_end") + F.expr(f"INTERVAL {late}") < F.col("_clock")
        arrived = scan_intervals(fresh, "6 hours", F.max("finished_at").alias("newest"))
        arrived = arrived.join(clock, "source_id", "left").withColumn("late_scans", F.when(final, F.col("scans")).otherwise(0))
        merged = known.unionByName(arrived.select(*known.columns)).groupBy(
            "source_id", "interval_start", "interval_end"
        ).agg(*[F.sum(n).alias(n) for n in ("scans", "successes", "late_scans")], F.max("newest").alias("newest"))
        log = counted.unionByName(fresh.select("scan_run_id", "source_id"))
        sinks.write_buckets(log, root, version, touched, "counted_scans")
        sinks.write_buckets(merged, root, version, touched, "intervals")

    return handle
