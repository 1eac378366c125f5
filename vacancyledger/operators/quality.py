"""Integrity checks: the constraints of the data model as queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import with_running_sums

# Value domains of the data model.
DOMAINS = {
    "lifecycle_status": ("active", "possibly_closed", "closed"),
    "scan_status": (
        "queued", "running", "success", "success_with_warnings", "partial", "failed", "interrupted",
    ),
    "trigger": ("initial", "scheduled", "manual"),
    "setup_status": ("unvalidated", "ready", "setup_required"),
    "health_status": ("unknown", "healthy", "temporarily_failing", "setup_required"),
    "monitoring_status": ("active", "paused"),
    "classification": ("strong", "possible", "irrelevant"),
    "remote_preference": ("no_preference", "remote_only", "remote_or_hybrid", "on_site_ok"),
    "provider": ("local", "anthropic"),
    "provider_status": ("success", "fallback", "hard_constraint"),
}

# Upper limits of lengths (text) and sizes (lists).
LIMITS = {
    "company": 200, "name": 200, "notes": 4_000, "resume_text": 100_000,
    "preference_notes": 10_000, "target_roles": 30, "adjacent_roles": 30,
    "preferred_locations": 30, "employment_types": 20, "required_terms": 50,
    "excluded_terms": 50,
}


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; rows with a null key part do not count."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that point to no parent."""
    ids = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(ids, child_key, "left_anti")


def bad_enum(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*domain))


def out_of_range(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def purge(
    tables: Mapping[str, DataFrame], sources: DataFrame
) -> dict[str, DataFrame]:
    """All tables after sources were removed. Rows of a source go with it, matches and user
    states go with their job, observations of a surviving scan lose the link to a removed job."""
    out = {
        name: df.join(sources.select("source_id"), "source_id", "left_anti")
        for name, df in tables.items()
        if "source_id" in df.columns
    }
    if "jobs" not in tables:
        return out
    gone = tables["jobs"].join(sources.select("source_id"), "source_id", "left_semi").select("job_id")
    for name in ("matches", "user_states"):
        if name in tables:
            out[name] = tables[name].join(gone, "job_id", "left_anti")
    if "observations" in out:
        mark = gone.withColumn("_gone", F.lit(True))
        cols = out["observations"].columns
        out["observations"] = (
            out["observations"].join(mark, "job_id", "left")
            .withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id")))
            .select(*cols)
        )
    return out


def in_domain(column: str, domain: str | None = None) -> Column:
    """Whether a value is one its domain (by default that of the column's name) allows; null is not."""
    return F.coalesce(F.col(column).isin(*DOMAINS[domain or column]), F.lit(False))


def within_limit(column: str, limit: str | None = None) -> Column:
    """Whether a text or list is no longer than its limit; null is."""
    return F.coalesce(F.length(column) <= LIMITS[limit or column], F.lit(True))


def list_within_limit(column: str, limit: str | None = None) -> Column:
    return F.col(column).isNull() | (F.size(column) <= LIMITS[limit or column])


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """check_name and number of rows that break it, for all rules of a table in one pass."""
    counted = df.agg(
        *[F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias(name) for name, ok in rules.items()]
    )
    pairs = [
        F.struct(F.lit(name).alias("check_name"), F.coalesce(name, F.lit(0).cast("long")).alias("violations"))
        for name in rules
    ]
    return counted.select(F.inline(F.array(*pairs)))


def audit(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check with its number of violations; each check reads its table once."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )
        for name, df in checks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def zero_result_guard(scans: DataFrame, chunk: Column, min_average: float = 1.0) -> DataFrame:
    """Complete scans that found nothing although the source's earlier complete scans found
    jobs: their absences should not be applied unseen. ``scans``: source_id, scan_run_id,
    scan_seq, complete, jobs_found."""
    done = scans.where("complete")
    summed = with_running_sums(
        done, ["source_id"], ["scan_seq"], chunk,
        {"_found": F.col("jobs_found"), "_scans": F.lit(1)},
    )
    before = F.col("_scans") - 1
    average = F.when(before > 0, (F.col("_found") - F.col("jobs_found")) / before)
    return (
        summed.withColumn("trailing_average", average.cast("double"))
        .where((F.col("jobs_found") == 0) & (F.col("trailing_average") >= min_average))
        .select("source_id", "scan_run_id", "scan_seq", "trailing_average")
    )
