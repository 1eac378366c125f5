"""Due, stale and health questions about sources and their scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import next_boundary
from .lifecycle import SUCCESS

UNFINISHED = ("queued", "running")
SCAN_INTERVAL_SECONDS = 21_600
STALE_AFTER_SECONDS = 3_600

# Scan errors that need a person to look at the setup.
SETUP_ERRORS = (
    "access_blocked", "detail_extraction_failure", "facet_drift", "invalid_configuration",
    "robots_disallowed", "unsupported_connector", "zero_results",
)


def due_sources(sources: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """Sources to scan now, most overdue first, with the trigger of the new scan."""
    unfinished = scans.where(F.col("status").isin(*UNFINISHED)).select("source_id")
    ready = sources.where(
        (F.col("monitoring_status") == "active")
        & F.col("connector_type").isNotNull()
        & (F.col("setup_status") != "setup_required")
        & (F.col("next_scan_at") <= now)
    )
    first = F.col("last_successful_scan_at").isNull()
    return (
        ready.join(unfinished, "source_id", "left_anti")
        .withColumn("trigger", F.when(first, "initial").otherwise("scheduled"))
        .orderBy("next_scan_at", "created_at", "source_id")
    )


def scan_queue(scans: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` queued scans, oldest first."""
    waiting = scans.where(F.col("status") == "queued")
    return waiting.orderBy("created_at", "scan_run_id").limit(max(limit, 0))


def stale_runs(
    scans: DataFrame, now: Column, stale_after: int = STALE_AFTER_SECONDS
) -> DataFrame:
    """Running scans whose worker must have stopped, in their interrupted form."""
    cutoff = F.timestamp_seconds(F.unix_seconds(now) - stale_after)
    stale = (F.col("status") == "running") & (
        F.col("started_at").isNull() | (F.col("started_at") <= cutoff)
    )
    return scans.where(stale).withColumns(
        {
            "status": F.lit("interrupted"),
            "finished_at": now,
            "error_code": F.lit("process_interrupted"),
        }
    )


def recover_stale(
    scans: DataFrame, sources: DataFrame, now: Column, stale_after: int = STALE_AFTER_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """Both tables after stale scans were interrupted: their sources are due at once."""
    stale = stale_runs(scans, now, stale_after)
    ids = stale.select("scan_run_id")
    new_scans = scans.join(ids, "scan_run_id", "left_anti").unionByName(
        stale.select(*scans.columns)
    )
    hit = stale.select("source_id").distinct().withColumn("_hit", F.lit(True))
    marked = sources.join(hit, "source_id", "left")
    new_sources = marked.withColumns(
        {
            "last_scan_attempt_at": F.when(F.col("_hit"), now).otherwise(
                F.col("last_scan_attempt_at")
            ),
            "next_scan_at": F.when(F.col("_hit"), now).otherwise(F.col("next_scan_at")),
        }
    ).select(*sources.columns)
    return new_scans, new_sources


def source_clock(scans: DataFrame, seconds: int = SCAN_INTERVAL_SECONDS) -> DataFrame:
    """Latest attempt, latest success and next due time per source."""
    done = scans.where(F.col("finished_at").isNotNull())
    return done.groupBy("source_id").agg(
        F.max("finished_at").alias("last_scan_attempt_at"),
        F.max(F.when(F.col("status").isin(*SUCCESS), F.col("finished_at"))).alias(
            "last_successful_scan_at"
        ),
    ).withColumn("next_scan_at", next_boundary(F.col("last_scan_attempt_at"), seconds))


def event_effects(kind: Column, ok: Column, code: Column, retryable: Column) -> tuple[Column, Column]:
    """Setup and health status an event sets; null where it leaves them alone.

    Kinds: ``scan`` (ok = complete; code = error of a failed scan), ``validation`` (ok = valid;
    code = error when it could not run), ``config``, ``url`` (ok = recognised).
    """
    scan, check = kind == "scan", kind == "validation"
    needs_setup = code.isin(*SETUP_ERRORS)
    setup = (
        F.when(scan & code.isNotNull() & needs_setup, "setup_required")
        .when(scan & code.isNull() & ok, "ready")
        .when(check, F.when(ok, "ready").otherwise("setup_required"))
        .when(kind == "config", "unvalidated")
        .when(kind == "url", F.when(ok, "unvalidated").otherwise("setup_required"))
    )
    health = (
        F.when(scan & code.isNotNull(), F.when(needs_setup, "setup_required").otherwise("temporarily_failing"))
        .when(scan, F.when(ok, "healthy").otherwise("temporarily_failing"))
        .when(
            check,
            F.when(ok, "healthy")
            .when(code.isNotNull() & retryable, "temporarily_failing")
            .otherwise("setup_required"),
        )
    )
    return setup, health


def source_health(events: DataFrame) -> DataFrame:
    """Setup and health per source after all its events, the latest effective one winning.

    ``events``: source_id, ts, seq, kind, ok, code, retryable.
    """
    setup, health = event_effects(
        F.col("kind"), F.col("ok"), F.col("code"), F.col("retryable")
    )
    marked = events.select(
        "source_id", F.struct("ts", "seq").alias("_at"), setup.alias("_setup"),
        health.alias("_health"),
    )

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_at")))

    return marked.groupBy("source_id").agg(
        F.coalesce(last("_setup"), F.lit("unvalidated")).alias("setup_status"),
        F.coalesce(last("_health"), F.lit("unknown")).alias("health_status"),
    )


def scan_intervals(scans: DataFrame, width: str = "6 hours", *also: Column) -> DataFrame:
    """Scans per source and due interval; ``also`` are further aggregates."""
    counted = scans.groupBy("source_id", F.window("finished_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum(F.col("status").isin(*SUCCESS).cast("long")).alias("successes"),
        *also,
    )
    return counted.select(
        "source_id", F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"),
        *[c for c in counted.columns if c not in ("source_id", "w")],
    )
