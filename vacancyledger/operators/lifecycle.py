"""Identity resolution, snapshot reconcile and lifecycle history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import dedupe_last, latest_by, top_k, with_running_sums

SUCCESS = ("success", "success_with_warnings")
POSTING_FIELDS = (
    "external_id", "canonical_url", "title", "locations", "employment_type", "posted_date",
    "description_html", "description_text", "content_fingerprint", "raw_metadata",
)


def status_of(absences: Column) -> Column:
    return (
        F.when(absences <= 0, "active").when(absences == 1, "possibly_closed").otherwise("closed")
    )


def new_job_id(source_id: Column, scan_run_id: Column, key: Column) -> Column:
    """Deterministic id, so that a replayed scan creates the same job. The scan is part of it
    because a job keeps its id when its identity key moves on."""
    return F.sha2(F.concat_ws("\x1f", source_id, scan_run_id, key), 256)


# --- identity ---------------------------------------------------------------------------


def resolve_identity(observations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``job_id`` and ``match_kind`` (identity, url, new) to the observations of at most
    one scan per source. An identity match beats a URL match, also across observations: a job
    claimed by identity is not available by URL."""
    by_identity = jobs.select(
        "source_id", "identity_key", F.col("job_id").alias("identity_job"),
    )
    first = observations.join(by_identity, ["source_id", "identity_key"], "left")
    claimed = first.where(F.col("identity_job").isNotNull()).select(
        F.col("identity_job").alias("job_id")
    )
    # Several jobs may have ended up at one URL; of those no observation claims, the most
    # recently seen one answers for it.
    free_urls = (
        jobs.select("source_id", "canonical_url", "job_id", "last_observed_at")
        .join(claimed, "job_id", "left_anti")
        .groupBy("source_id", "canonical_url")
        .agg(F.max_by("job_id", F.struct("last_observed_at", "job_id")).alias("url_job"))
    )
    second = first.join(free_urls, ["source_id", "canonical_url"], "left")
    kind = (
        F.when(F.col("identity_job").isNotNull(), "identity")
        .when(F.col("url_job").isNotNull(), "url")
        .otherwise("new")
    )
    fresh = new_job_id(F.col("source_id"), F.col("scan_run_id"), F.col("identity_key"))
    kept = [c for c in observations.columns if c not in {"job_id", "match_kind"}]
    return second.select(
        *kept,
        F.coalesce("identity_job", "url_job", fresh).alias("job_id"),
        kind.alias("match_kind"),
    )


def dedupe_scan(observations: DataFrame) -> DataFrame:
    """One row per identity key and per URL of a scan; the later one wins. ``copies`` counts
    what an identity stood for, ``url_copies`` what a URL stood for."""
    by_key = dedupe_last(
        observations, ["source_id", "scan_run_id", "identity_key"], ["seq"], "seq"
    )
    rest = [c for c in observations.columns]
    keys = ["source_id", "scan_run_id", "canonical_url"]
    fields = [c for c in rest if c not in keys]
    winners = by_key.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), "seq").alias("_best"),
        F.min("first_position").alias("position"),
        # Copies add up over the identities that meet at one URL.
        F.sum("copies").alias("found"),
        F.count(F.lit(1)).alias("url_copies"),
    )
    kept = [c if c in keys else F.col(f"_best.{c}").alias(c) for c in rest]
    return winners.select(*kept, "position", "found", "url_copies")


# --- reconcile --------------------------------------------------------------------------


def reconcile(
    jobs: DataFrame,
    observations: DataFrame,
    scans: DataFrame,
    zero_guard: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply at most one scan per source to the job snapshot; returns (jobs, metrics).

    ``scans``: source_id, scan_run_id, complete, observed_at, prior_success. ``zero_guard``
    (optional): scan_run_id of complete scans whose absences must not be applied. An
    observation's ``seq`` is its unique place in its scan: copies are removed and jobs found on
    keys alone, so the texts are shuffled only to meet their result and then their job.
    """
    # Two scans of a source would both claim its jobs; fail rather than duplicate them in silence.
    scans = scans.withColumn("_scans", F.count(F.lit(1)).over(Window.partitionBy("source_id")))
    several = F.raise_error(F.concat(F.lit("more than one scan of source "), F.col("source_id")))
    scans = scans.withColumn(
        "scan_run_id", F.when(F.col("_scans") == 1, F.col("scan_run_id")).otherwise(several.cast("string"))
    ).drop("_scans")
    # Jobs of other sources are not touched: they are neither shuffled nor compared.
    sources = scans.select("source_id")
    idle = jobs.join(sources, "source_id", "left_anti")
    jobs = jobs.join(sources, "source_id", "left_semi")
    place = ["source_id", "scan_run_id", "seq"]
    in_scope = observations.join(scans.select("scan_run_id"), "scan_run_id", "left_semi")
    claims = resolve_identity(
        dedupe_scan(in_scope.select(*place, "identity_key", "canonical_url")), jobs
    )
    resolved = in_scope.select(*place, "identity_key", *POSTING_FIELDS).join(
        claims.select(*place, "job_id", "match_kind"), place
    )
    scan_cols = scans.select(
        "source_id", F.col("scan_run_id").alias("_scan"), F.col("complete").alias("_complete"),
        F.col("observed_at").alias("_at"), F.col("prior_success").alias("_prior"),
    )
    if zero_guard is not None:
        held = zero_guard.select(F.col("scan_run_id").alias("_scan"), F.lit(True).alias("_held"))
        scan_cols = scan_cols.join(held, "_scan", "left").withColumn(
            "_complete", F.col("_complete") & F.col("_held").isNull()
        ).drop("_held")

    # Known and observed jobs meet once; a row has the old side, the new side, or both.
    new_side = resolved.select(
        "source_id", "job_id",
        F.struct("identity_key", *POSTING_FIELDS).alias("_new"),
        F.col("match_kind").alias("_kind"),
    )
    old_fields = [c for c in jobs.columns if c not in {"source_id", "job_id"}]
    old_side = jobs.select("source_id", "job_id", F.struct(*old_fields).alias("_old"))
    merged = old_side.join(new_side, ["source_id", "job_id"], "full_outer").join(
        scan_cols, "source_id", "left"
    )
    seen, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    missing = (
        known & ~seen & F.coalesce("_complete", F.lit(False))
        & (F.col("_old.lifecycle_status") != "closed")
    )
    absences = (
        F.when(seen, F.lit(0))
        .when(missing, F.col("_old.consecutive_successful_absences") + 1)
        .otherwise(F.col("_old.consecutive_successful_absences"))
        .cast("int")
    )
    marked = merged.withColumn("_absences", absences).withColumn("_missing", missing)
    status = F.when(seen, F.lit("active")).when(missing, status_of(F.col("_absences"))).otherwise(
        F.col("_old.lifecycle_status")
    )

    def pick(name: str) -> Column:
        return F.when(seen, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}")).alias(name)

    snapshot = marked.select(
        "source_id", "job_id", pick("identity_key"), *[pick(c) for c in POSTING_FIELDS],
        status.alias("lifecycle_status"),
        F.col("_absences").alias("consecutive_successful_absences"),
        F.when(known, F.col("_old.initial_import")).otherwise(~F.col("_prior")).alias(
            "initial_import"
        ),
        F.when(known, F.col("_old.first_discovered_at")).otherwise(F.col("_at")).alias(
            "first_discovered_at"
        ),
        F.when(seen, F.col("_at")).otherwise(F.col("_old.last_observed_at")).alias(
            "last_observed_at"
        ),
    )
    changed = (
        known & seen
        & ~F.col("_old.content_fingerprint").eqNullSafe(F.col("_new.content_fingerprint"))
    )

    def tally(flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0)).cast("long")

    per_scan = marked.where(F.col("_scan").isNotNull()).groupBy("source_id", "_scan").agg(
        tally(seen).alias("jobs_persisted"),
        tally(seen & ~known).alias("jobs_created"),
        tally(changed).alias("jobs_updated"),
        tally(seen & known & F.col("_old.lifecycle_status").isin("closed", "possibly_closed"))
        .alias("jobs_reopened"),
        tally(F.col("_missing")).alias("jobs_missing"),
    )
    found = claims.groupBy("scan_run_id").agg(
        F.sum("found").alias("jobs_found"),
        F.sum(F.col("url_copies") - 1).alias("duplicate_urls"),
    )
    # Every scan has its row, also one that found nothing at a source without jobs.
    names = [c for c in per_scan.columns if c not in {"source_id", "_scan"}]
    metrics = (
        scans.select("source_id", "scan_run_id")
        .join(per_scan.drop("source_id").withColumnRenamed("_scan", "scan_run_id"), "scan_run_id", "left")
        .join(found, "scan_run_id", "left")
        .na.fill(0, [*names, "jobs_found", "duplicate_urls"])
    )
    return snapshot.unionByName(idle.select(snapshot.columns)), metrics


def missing_jobs(jobs: DataFrame, observations: DataFrame, scans: DataFrame) -> DataFrame:
    """Known open jobs that a complete scan of their source did not observe."""
    complete = scans.where("complete").select("source_id", "scan_run_id")
    seen = observations.join(complete, ["source_id", "scan_run_id"], "left_semi")
    open_jobs = jobs.where(F.col("lifecycle_status") != "closed").join(
        complete.select("source_id"), "source_id", "left_semi"
    )
    return open_jobs.join(seen.select("source_id", "job_id"), ["source_id", "job_id"], "left_anti")


# --- history ----------------------------------------------------------------------------


def _as_of(df: DataFrame, as_of) -> DataFrame:
    return df if as_of is None else df.where(F.col("scan_seq") <= F.lit(as_of))


def lifecycle_history(
    observations: DataFrame,
    scans: DataFrame,
    as_of=None,
    keys: tuple[str, ...] = ("identity_key",),
    order: tuple[str, ...] = ("scan_seq", "seq"),
) -> DataFrame:
    """State of every job after the scans up to ``as_of`` (a ``scan_seq``), in any input order.

    A job's absences are the complete scans of its source after the last scan that saw it, never
    more than two matter, so the two latest complete scans per source decide. Observations are
    reduced before their only shuffle.
    """
    complete = _as_of(scans, as_of).where("complete").select("source_id", "scan_seq")
    ranked = top_k(complete, ["source_id"], [F.col("scan_seq").desc()], 2)
    latest = ranked.groupBy("source_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("scan_seq"))).alias("_c1"),
        F.max(F.when(F.col("rank") == 2, F.col("scan_seq"))).alias("_c2"),
    )
    spans = _as_of(observations, as_of).groupBy("source_id", *keys).agg(
        F.min("scan_seq").alias("first_seq"),
        F.max("scan_seq").alias("last_seq"),
        F.max_by("content_fingerprint", F.struct(*order)).alias("content_fingerprint"),
        F.count(F.lit(1)).alias("observations"),
    )
    after = [
        F.coalesce((F.col(c) > F.col("last_seq")).cast("int"), F.lit(0)) for c in ("_c1", "_c2")
    ]
    absences = (after[0] + after[1]).alias("absences")
    return (
        spans.join(latest, "source_id", "left")
        .select(
            "source_id", *keys, "first_seq", "last_seq", "content_fingerprint", "observations",
            absences,
        )
        .withColumn("lifecycle_status", status_of(F.col("absences")))
    )


def observed_span(observations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return observations.groupBy(*keys).agg(
        F.min("observed_at").alias("first_discovered_at"),
        F.max("observed_at").alias("last_observed_at"),
    )


def _with_last_fingerprint(observations: DataFrame) -> DataFrame:
    """Add ``prev_content_fingerprint`` and ``is_first``. A job has few observations, unlike a source,
    so a plain window holds its rows: one shuffle."""
    order = Window.partitionBy("source_id", "identity_key").orderBy("scan_seq")
    last = F.lag(F.struct("content_fingerprint")).over(order)
    return observations.withColumn("_last", last).select(
        *observations.columns, F.col("_last.content_fingerprint").alias("prev_content_fingerprint"),
        F.col("_last").isNull().alias("is_first"),
    )


def lifecycle_events(observations: DataFrame, scans: DataFrame, chunk: Column) -> DataFrame:
    """Every status change of every job: discovered, possibly_closed, closed, reopened.

    Complete scans are numbered per source; the first and second numbers after an observation
    are looked up by equality, so no interval join is needed. ``chunk`` cuts the order column
    ``scan_seq`` into ranges, see ``windows``.
    """
    numbered = with_running_sums(
        scans.select("source_id", "scan_seq", "complete"), ["source_id"], ["scan_seq"], chunk,
        {"n_complete": F.when(F.col("complete"), 1).otherwise(0)},
    )
    at_scan = numbered.select("source_id", "scan_seq", "n_complete")
    by_number = numbered.where("complete").select(
        "source_id", F.col("n_complete").alias("number"), F.col("scan_seq").alias("at_seq")
    )
    keyed = ["source_id", "identity_key"]
    following = F.lead("scan_seq").over(Window.partitionBy(*keyed).orderBy("scan_seq"))
    gaps = (
        observations.select(*keyed, "scan_seq").distinct()
        .withColumn("next_scan_seq", following)
        .join(at_scan, ["source_id", "scan_seq"])
    )
    firsts = observations.groupBy(*keyed).agg(F.min("scan_seq").alias("at_seq")).select(
        *keyed, "at_seq", F.lit("discovered").alias("change")
    )
    steps = gaps.select(
        *keyed, "next_scan_seq",
        F.explode(
            F.array(
                F.struct((F.col("n_complete") + 1).alias("number"), F.lit(1).alias("step")),
                F.struct((F.col("n_complete") + 2).alias("number"), F.lit(2).alias("step")),
            )
        ).alias("s"),
    ).select(*keyed, "next_scan_seq", "s.number", "s.step")
    hits = steps.join(by_number, ["source_id", "number"]).where(
        F.col("next_scan_seq").isNull() | (F.col("at_seq") < F.col("next_scan_seq"))
    )
    closing = hits.select(
        *keyed, "at_seq",
        F.when(F.col("step") == 1, "possibly_closed").otherwise("closed").alias("change"),
    )
    reopened = hits.where((F.col("step") == 1) & F.col("next_scan_seq").isNotNull()).select(
        *keyed, F.col("next_scan_seq").alias("at_seq"), F.lit("reopened").alias("change")
    )
    return firsts.unionByName(closing).unionByName(reopened)


def change_log(observations: DataFrame) -> DataFrame:
    """Observations whose content differs from the job's previous observation."""
    prev = _with_last_fingerprint(observations)
    differs = ~F.col("content_fingerprint").eqNullSafe(F.col("prev_content_fingerprint"))
    return prev.where(~F.col("is_first") & differs).drop("is_first")


def initial_import(scans: DataFrame) -> DataFrame:
    """Whether jobs created by a scan are initial imports: no earlier scan of the source ended
    in success. The earliest success per source answers that without a window."""
    earliest = scans.where(F.col("status").isin(*SUCCESS)).groupBy("source_id").agg(
        F.min("scan_seq").alias("_first_success")
    )
    return (
        scans.join(earliest, "source_id", "left")
        .withColumn(
            "initial_import",
            F.col("_first_success").isNull() | (F.col("scan_seq") <= F.col("_first_success")),
        )
        .drop("_first_success")
    )


def scan_metrics(observations: DataFrame, scans: DataFrame, chunk: Column) -> DataFrame:
    """Found, persisted, created, updated and missing counts of every scan of the history.

    ``observations`` is the raw listing of the scans (duplicates included, ``seq`` orders them).
    Missing jobs follow from the status changes: a complete scan misses a job exactly when it
    moves it to possibly_closed or closed.
    """
    keyed = ["source_id", "identity_key"]
    found = observations.groupBy("source_id", "scan_run_id", "scan_seq").agg(
        F.count(F.lit(1)).alias("jobs_found")
    )
    unique = latest_by(
        observations.select(*keyed, "scan_run_id", "scan_seq", "seq", "content_fingerprint"),
        [*keyed, "scan_run_id", "scan_seq"], ["seq"],
    )
    prev = _with_last_fingerprint(unique)
    differs = ~F.col("content_fingerprint").eqNullSafe(F.col("prev_content_fingerprint"))
    kept = prev.groupBy("source_id", "scan_run_id").agg(
        F.count(F.lit(1)).alias("jobs_persisted"),
        F.sum(F.col("is_first").cast("long")).alias("jobs_created"),
        F.sum((~F.col("is_first") & differs).cast("long")).alias("jobs_updated"),
    )
    gone = (
        lifecycle_events(unique, scans, chunk)
        .where(F.col("change").isin("possibly_closed", "closed"))
        .groupBy("source_id", F.col("at_seq").alias("scan_seq"))
        .agg(F.count(F.lit(1)).alias("jobs_missing"))
    )
    return (
        scans.select("source_id", "scan_run_id", "scan_seq")
        .join(found, ["source_id", "scan_run_id", "scan_seq"], "left")
        .join(kept, ["source_id", "scan_run_id"], "left")
        .join(gone, ["source_id", "scan_seq"], "left")
        .na.fill(0, ["jobs_found", "jobs_persisted", "jobs_created", "jobs_updated", "jobs_missing"])
    )


# --- scan outcome -----------------------------------------------------------------------


def completeness(details: DataFrame, warnings: DataFrame, scans: DataFrame) -> DataFrame:
    """Per scan: complete unless a detail failed, a page limit or loop was met or a page was not captured; an error
    code when a non-empty listing gave nothing usable."""
    d = details.groupBy("scan_run_id").agg(
        F.count(F.lit(1)).alias("listed"),
        F.sum(F.when(F.col("error_code").isNull(), 1).otherwise(0)).alias("usable"),
    )
    w = warnings.groupBy("scan_run_id").agg(
        F.max(F.col("code").isin("page_limit_reached", "pagination_loop", "page_not_captured")).alias("cut")
    )
    joined = scans.select("scan_run_id").join(d, "scan_run_id", "left").join(w, "scan_run_id", "left")
    listed, usable = F.coalesce("listed", F.lit(0)), F.coalesce("usable", F.lit(0))
    return joined.select(
        "scan_run_id", listed.cast("long").alias("listed"), usable.cast("long").alias("usable"),
        ((listed == usable) & ~F.coalesce("cut", F.lit(False))).alias("complete"),
        F.when((listed > 0) & (usable == 0), "detail_extraction_failure").alias("error_code"),
    )


def scan_status(scans: DataFrame, warnings: DataFrame) -> DataFrame:
    """Final status of finished scans and their number of warnings. An incomplete scan gets an
    ``incomplete_scan`` warning unless it has one."""
    w = warnings.groupBy("scan_run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col("code") == "incomplete_scan").alias("_marked"),
    )
    n = F.coalesce("_n", F.lit(0))
    add = (~F.col("complete") & ~F.coalesce("_marked", F.lit(False))).cast("int")
    failed = F.col("error_code").isNotNull()
    return scans.join(w, "scan_run_id", "left").select(
        "source_id", "scan_run_id",
        F.when(failed, n).otherwise(n + add).cast("long").alias("warnings"),
        F.when(failed, "failed")
        .when(~F.col("complete"), "partial")
        .when(n > 0, "success_with_warnings")
        .otherwise("success")
        .alias("status"),
    )
