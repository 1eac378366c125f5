"""Queries over the scan history: identity, reconcile, lifecycle, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import next_boundary
from ..operators import health, lifecycle, quality
from ..operators.windows import latest_by
from . import derived
from .derived import sql, table


def week(col: str = "scan_seq"):
    """Chunk of the scan order: seven scans."""
    return F.floor(F.col(col) / 7)


def observations(spark, sf_dir):
    return latest_by(
        derived.scan_listing(spark, sf_dir), ["source_id", "scan_run_id", "identity_key"], ["seq"]
    )


def lifecycle_history(spark, sf_dir):
    out = lifecycle.lifecycle_history(
        derived.scan_listing(spark, sf_dir), derived.scan_history(spark, sf_dir)
    )
    return out.select(
        "source_id", "identity_key", "first_seq", "last_seq", "content_fingerprint", "absences",
        "lifecycle_status",
    )


_STATUS = "CASE least(2, after_last) WHEN 0 THEN 'active' WHEN 1 THEN 'possibly_closed' ELSE 'closed' END"
LIFECYCLE_SQL = sql(
    f"""SELECT source_id, identity_key, first_seq, last_seq, fp AS content_fingerprint,
    CAST(least(2, after_last) AS INTEGER) AS absences, {_STATUS} AS lifecycle_status FROM lifecycle""",
    "lifecycle",
)


def lifecycle_lineitem(spark, sf_dir):
    """Lifecycle over the largest table: parts as jobs, months as complete scans."""
    li = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    obs = li.select(
        (F.col("l_partkey") % 100).alias("source_id"), F.col("l_partkey").alias("identity_key"),
        month.alias("scan_seq"), F.col("l_returnflag").alias("content_fingerprint"),
    )
    scans = obs.select("source_id", "scan_seq").distinct().withColumn("complete", F.lit(True))
    out = lifecycle.lifecycle_history(
        obs, scans, order=("scan_seq", "content_fingerprint")
    )
    return out.groupBy("source_id", "lifecycle_status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("observations").alias("observations"),
        F.sum((F.col("content_fingerprint") == "N").cast("long")).alias("flag_n"),
    )


LINEITEM_SQL = """WITH o AS (SELECT l_partkey % 100 AS source_id, l_partkey AS job,
      year(l_shipdate) * 12 + month(l_shipdate) AS m, l_returnflag AS fp FROM lineitem),
    s AS (SELECT source_id, m, row_number() OVER (PARTITION BY source_id ORDER BY m DESC) AS rn
      FROM (SELECT DISTINCT source_id, m FROM o)),
    j AS (SELECT source_id, job, max(m) AS last_m, count(*) AS n, arg_max(fp, {'m': m, 'f': fp}) AS fp FROM o GROUP BY ALL),
    r AS (SELECT j.*, (SELECT count(*) FROM s WHERE s.source_id = j.source_id AND rn <= 2 AND s.m > j.last_m) AS absences FROM j)
    SELECT source_id, CASE absences WHEN 0 THEN 'active' WHEN 1 THEN 'possibly_closed' ELSE 'closed' END AS lifecycle_status,
    count(*) AS jobs, CAST(sum(n) AS BIGINT) AS observations, count(*) FILTER (WHERE fp = 'N') AS flag_n FROM r GROUP BY ALL"""


def lifecycle_events(spark, sf_dir):
    return lifecycle.lifecycle_events(
        derived.scan_listing(spark, sf_dir), derived.scan_history(spark, sf_dir), week()
    )


EVENTS_SQL = sql(
    """, g AS (SELECT source_id, identity_key, scan_seq,
      lead(scan_seq) OVER (PARTITION BY source_id, identity_key ORDER BY scan_seq) AS nxt FROM obs),
    c AS (SELECT g.*, s.scan_seq AS at_seq, row_number() OVER (PARTITION BY g.source_id, g.identity_key, g.scan_seq ORDER BY s.scan_seq) AS step
      FROM g JOIN scans s ON s.source_id = g.source_id AND s.complete AND s.scan_seq > g.scan_seq AND (nxt IS NULL OR s.scan_seq < nxt))
    SELECT source_id, identity_key, min(scan_seq) AS at_seq, 'discovered' AS change FROM obs GROUP BY ALL
    UNION ALL SELECT source_id, identity_key, at_seq, CASE step WHEN 1 THEN 'possibly_closed' ELSE 'closed' END FROM c WHERE step <= 2
    UNION ALL SELECT source_id, identity_key, nxt, 'reopened' FROM c WHERE step = 1 AND nxt IS NOT NULL""",
    "obs", "scans",
)


def change_log(spark, sf_dir):
    out = lifecycle.change_log(observations(spark, sf_dir))
    return out.select(
        "source_id", "identity_key", "scan_seq", "prev_content_fingerprint", "content_fingerprint"
    )


CHANGE_SQL = sql(
    """SELECT source_id, identity_key, scan_seq, prev AS prev_content_fingerprint, fp AS content_fingerprint
    FROM (SELECT *, lag(fp) OVER (PARTITION BY source_id, identity_key ORDER BY scan_seq) AS prev FROM obs)
    WHERE prev IS NOT NULL AND prev <> fp""",
    "obs",
)


def initial_import(spark, sf_dir):
    out = lifecycle.initial_import(derived.scan_history(spark, sf_dir))
    return out.select("source_id", "scan_run_id", "initial_import")


INITIAL_SQL = sql(
    """SELECT source_id, scan_run_id, count(*) FILTER (WHERE status IN ('success', 'success_with_warnings'))
    OVER (PARTITION BY source_id ORDER BY scan_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS initial_import FROM scans""",
    "scans",
)


def scan_metrics(spark, sf_dir):
    out = lifecycle.scan_metrics(
        derived.scan_listing(spark, sf_dir), derived.scan_history(spark, sf_dir), week()
    )
    return out.drop("scan_seq")


METRICS_SQL = sql(
    """, f AS (SELECT scan_run_id, count(*) AS n FROM listing GROUP BY 1),
    p AS (SELECT scan_run_id, count(*) AS persisted, count(*) FILTER (WHERE prev IS NULL) AS created,
        count(*) FILTER (WHERE prev <> fp) AS updated
      FROM (SELECT *, lag(fp) OVER (PARTITION BY source_id, identity_key ORDER BY scan_seq) AS prev FROM obs) GROUP BY 1),
    g AS (SELECT source_id, identity_key, scan_seq, lead(scan_seq) OVER (PARTITION BY source_id, identity_key ORDER BY scan_seq) AS nxt FROM obs),
    c AS (SELECT s.scan_run_id, row_number() OVER (PARTITION BY g.source_id, g.identity_key, g.scan_seq ORDER BY s.scan_seq) AS step
      FROM g JOIN scans s ON s.source_id = g.source_id AND s.complete AND s.scan_seq > g.scan_seq AND (nxt IS NULL OR s.scan_seq < nxt)),
    m AS (SELECT scan_run_id, count(*) AS missing FROM c WHERE step <= 2 GROUP BY 1)
    SELECT s.source_id, s.scan_run_id, coalesce(n, 0) AS jobs_found, coalesce(persisted, 0) AS jobs_persisted,
    coalesce(created, 0) AS jobs_created, coalesce(updated, 0) AS jobs_updated, coalesce(missing, 0) AS jobs_missing
    FROM scans s LEFT JOIN f USING (scan_run_id) LEFT JOIN p USING (scan_run_id) LEFT JOIN m USING (scan_run_id)""",
    "listing", "obs", "scans",
)


def _scan_warnings(spark, sf_dir):
    """Warnings and detail outcomes of scans, from errors and values of the day's events."""
    e = derived._scan_columns(table(spark, sf_dir, "events"))
    code = (
        F.when(F.col("value") > 60, "off_host_links_ignored")
        .when(F.col("value") > 45, "pagination_loop")
        .when(F.col("value") > 40, "page_limit_reached")
    )
    warnings = e.where(F.col("event_type") == "error").select(
        "source_id", "scan_run_id", code.alias("code")
    ).where(F.col("code").isNotNull())
    details = e.where(F.col("event_type") == "view").select(
        "source_id", "scan_run_id",
        F.when(F.col("value") > 55, "missing_jsonld").alias("error_code"),
    )
    return warnings, details


def scan_status(spark, sf_dir):
    warnings, details = _scan_warnings(spark, sf_dir)
    scans = derived.scan_history(spark, sf_dir).select("source_id", "scan_run_id")
    done = lifecycle.completeness(details, warnings, scans)
    outcome = lifecycle.scan_status(scans.join(done, "scan_run_id"), warnings)
    return outcome.join(done.select("scan_run_id", "listed", "usable", "complete"), "scan_run_id")


STATUS_SQL = sql(
    """, w AS (SELECT scan_run_id, count(*) AS n, max(CASE WHEN code IN ('pagination_loop', 'page_limit_reached') THEN 1 ELSE 0 END) AS cut
      FROM (SELECT scan_run_id, CASE WHEN value > 60 THEN 'off_host_links_ignored' WHEN value > 45 THEN 'pagination_loop'
        WHEN value > 40 THEN 'page_limit_reached' END AS code FROM scan_events WHERE event_type = 'error') WHERE code IS NOT NULL GROUP BY 1),
    d AS (SELECT scan_run_id, count(*) AS listed, count(*) FILTER (WHERE value <= 55) AS usable FROM scan_events WHERE event_type = 'view' GROUP BY 1),
    j AS (SELECT s.source_id, s.scan_run_id, coalesce(listed, 0) AS listed, coalesce(usable, 0) AS usable,
      coalesce(listed, 0) = coalesce(usable, 0) AND coalesce(cut, 0) = 0 AS complete,
      coalesce(listed, 0) > 0 AND coalesce(usable, 0) = 0 AS broken, coalesce(n, 0) AS n
      FROM scans s LEFT JOIN w USING (scan_run_id) LEFT JOIN d USING (scan_run_id))
    SELECT source_id, scan_run_id, CASE WHEN broken OR complete THEN n ELSE n + 1 END AS warnings,
    CASE WHEN broken THEN 'failed' WHEN NOT complete THEN 'partial' WHEN n > 0 THEN 'success_with_warnings' ELSE 'success' END AS status,
    listed, usable, complete FROM j""",
    "scan_events", "scans",
)


def missing_jobs(spark, sf_dir):
    """Open jobs that the last complete scan of their source did not list."""
    listing = derived.scan_listing(spark, sf_dir)
    scans = derived.scan_history(spark, sf_dir)
    last = scans.where("complete").groupBy("source_id").agg(F.max("scan_seq").alias("_last"))
    earlier = F.col("scan_seq") < F.col("_last")
    jobs = lifecycle.lifecycle_history(
        listing.join(last, "source_id").where(earlier), scans.join(last, "source_id").where(earlier)
    ).withColumn("job_id", F.col("identity_key"))
    step = scans.join(last, "source_id").where(F.col("scan_seq") == F.col("_last"))
    out = lifecycle.missing_jobs(jobs, listing.withColumn("job_id", F.col("identity_key")), step)
    return out.select("source_id", "job_id", "absences")


MISSING_SQL = sql(
    """, l AS (SELECT source_id, max(scan_seq) AS last_scan FROM scans WHERE complete GROUP BY 1),
    j AS (SELECT o.source_id, o.identity_key, l.last_scan, max(o.scan_seq) AS last_seq FROM obs o JOIN l ON l.source_id = o.source_id AND o.scan_seq < l.last_scan GROUP BY ALL),
    a AS (SELECT j.*, (SELECT count(*) FROM scans s WHERE s.source_id = j.source_id AND s.complete AND s.scan_seq > j.last_seq AND s.scan_seq < j.last_scan) AS n FROM j)
    SELECT a.source_id, a.identity_key AS job_id, CAST(n AS INTEGER) AS absences FROM a
    WHERE n < 2 AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.source_id = a.source_id AND o.scan_seq = a.last_scan AND o.identity_key = a.identity_key)""",
    "obs", "scans",
)


def observed_span(spark, sf_dir):
    return lifecycle.observed_span(
        derived.scan_listing(spark, sf_dir), ("source_id", "identity_key")
    )


SPAN_SQL = sql(
    """SELECT source_id, identity_key, min(observed_at) AS first_discovered_at, max(observed_at) AS last_observed_at
    FROM listing GROUP BY ALL""",
    "listing",
)


# --- identity and reconcile -------------------------------------------------------------


def identity_resolution(spark, sf_dir):
    """The last scan of every source against the jobs of all earlier ones, a third of which are
    known without an id."""
    last = derived.scan_listing(spark, sf_dir).groupBy("source_id").agg(
        F.max("scan_seq").alias("_last")
    )
    seen = observations(spark, sf_dir).join(last, "source_id")
    number = F.col("external_id").cast("long")
    known = seen.where(F.col("scan_seq") < F.col("_last")).groupBy("source_id", "external_id", "canonical_url").agg(
        F.max("observed_at").alias("last_observed_at")
    ).select(
        "source_id", "canonical_url", "last_observed_at",
        F.when(number % 3 == 0, F.concat(F.lit("url:"), "canonical_url"))
        .otherwise(F.concat(F.lit("external:"), "external_id"))
        .alias("identity_key"),
        F.concat(F.lit("job-"), "external_id").alias("job_id"),
    )
    later = seen.where(F.col("scan_seq") == F.col("_last"))
    out = lifecycle.resolve_identity(later, known)
    new = F.col("match_kind") == "new"
    return out.select(
        "source_id", "identity_key", "match_kind",
        F.when(new, F.lit("-")).otherwise(F.col("job_id")).alias("job_id"),
    )


IDENTITY_SQL = sql(
    """, pick AS (SELECT source_id, max(scan_seq) AS scan_seq FROM listing GROUP BY 1),
    known AS (SELECT DISTINCT l.source_id, external_id FROM listing l JOIN pick p ON l.source_id = p.source_id AND l.scan_seq < p.scan_seq),
    later AS (SELECT DISTINCT l.source_id, l.external_id, l.identity_key FROM listing l JOIN pick p ON l.source_id = p.source_id AND l.scan_seq = p.scan_seq)
    SELECT l.source_id, l.identity_key,
    CASE WHEN k.external_id IS NULL THEN 'new' WHEN CAST(k.external_id AS BIGINT) % 3 = 0 THEN 'url' ELSE 'identity' END AS match_kind,
    CASE WHEN k.external_id IS NULL THEN '-' ELSE 'job-' || k.external_id END AS job_id
    FROM later l LEFT JOIN known k ON k.source_id = l.source_id AND k.external_id = l.external_id""",
    "listing",
)


def _as_postings(df):
    """Add the posting columns that scan listings of the test tables do not have."""
    return df.withColumns(
        {
            "locations": F.array().cast("array<string>"),
            "employment_type": F.lit(None).cast("string"),
            "posted_date": F.lit(None).cast("date"),
            "description_html": F.lit(None).cast("string"),
            "description_text": F.lit(None).cast("string"),
            "raw_metadata": F.lit(None).cast("map<string,string>"),
        }
    )


def _reconciled(spark, sf_dir):
    """Snapshot before each source's last usable scan, then that scan applied to it."""
    listing = derived.scan_listing(spark, sf_dir)
    scans = lifecycle.initial_import(derived.scan_history(spark, sf_dir))
    usable = scans.where(F.col("status") != "failed")
    last = usable.groupBy("source_id").agg(F.max("scan_seq").alias("_last"))
    step = usable.join(last, "source_id").where(F.col("scan_seq") == F.col("_last"))
    earlier = listing.join(last, "source_id").where(F.col("scan_seq") < F.col("_last")).drop("_last")
    earlier_scans = usable.join(last, "source_id").where(F.col("scan_seq") < F.col("_last"))
    state = lifecycle.lifecycle_history(
        earlier, earlier_scans, keys=("identity_key", "canonical_url", "title", "external_id")
    )
    born = scans.select("source_id", F.col("scan_seq").alias("first_seq"), "initial_import")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs = _as_postings(
        state.join(born, ["source_id", "first_seq"]).select(
            "source_id", F.sha2(F.concat("source_id", "identity_key"), 256).alias("job_id"),
            "identity_key", "external_id", "canonical_url", "title", "content_fingerprint",
            "lifecycle_status", F.col("absences").alias("consecutive_successful_absences"),
            "initial_import", stamp.alias("first_discovered_at"), stamp.alias("last_observed_at"),
        )
    )
    applied = step.select(
        "source_id", "scan_run_id", "complete", F.col("finished_at").alias("observed_at"),
        (~F.col("initial_import")).alias("prior_success"),
    )
    return lifecycle.reconcile(jobs, _as_postings(listing), applied)


def reconcile(spark, sf_dir):
    jobs, _ = _reconciled(spark, sf_dir)
    return jobs.select(
        "source_id", "identity_key", "content_fingerprint", "lifecycle_status",
        F.col("consecutive_successful_absences").alias("absences"), "initial_import",
    )


RECONCILE_SQL = sql(
    f""", ok AS (SELECT source_id, min(scan_seq) AS first_ok FROM scans WHERE status IN ('success', 'success_with_warnings') GROUP BY 1)
    SELECT l.source_id, identity_key, fp AS content_fingerprint, {_STATUS} AS lifecycle_status,
    CAST(least(2, after_last) AS INTEGER) AS absences, first_ok IS NULL OR first_seq <= first_ok AS initial_import
    FROM lifecycle l LEFT JOIN ok ON ok.source_id = l.source_id""",
    "lifecycle",
)


def reconcile_metrics(spark, sf_dir):
    _, metrics = _reconciled(spark, sf_dir)
    return metrics


RECONCILE_METRICS_SQL = sql(
    """, last AS (SELECT source_id, max(scan_seq) AS last_scan FROM scans WHERE status <> 'failed' GROUP BY 1),
    step AS (SELECT s.* FROM scans s JOIN last l ON l.source_id = s.source_id AND l.last_scan = s.scan_seq),
    f AS (SELECT scan_run_id, count(*) AS n FROM listing GROUP BY 1),
    o AS (SELECT *, lag(fp) OVER w AS prev, lag(scan_seq) OVER w AS prev_seq FROM obs WINDOW w AS (PARTITION BY source_id, identity_key ORDER BY scan_seq)),
    p AS (SELECT o.scan_run_id, count(*) AS persisted, count(*) FILTER (WHERE prev IS NULL) AS created, count(*) FILTER (WHERE prev <> fp) AS updated,
      count(*) FILTER (WHERE prev_seq IS NOT NULL AND EXISTS (SELECT 1 FROM scans s WHERE s.source_id = o.source_id AND s.complete AND s.scan_seq > o.prev_seq AND s.scan_seq < o.scan_seq)) AS reopened
      FROM o GROUP BY 1),
    m AS (SELECT step.scan_run_id, count(*) AS missing FROM step JOIN lifecycle l ON l.source_id = step.source_id AND step.complete
      AND l.last_seq < step.scan_seq AND l.after_last <= 2 GROUP BY 1)
    SELECT source_id, scan_run_id, coalesce(persisted, 0) AS jobs_persisted, coalesce(created, 0) AS jobs_created, coalesce(updated, 0) AS jobs_updated,
    coalesce(reopened, 0) AS jobs_reopened, coalesce(missing, 0) AS jobs_missing, coalesce(n, 0) AS jobs_found, 0::BIGINT AS duplicate_urls
    FROM step LEFT JOIN p USING (scan_run_id) LEFT JOIN f USING (scan_run_id) LEFT JOIN m USING (scan_run_id)""",
    "lifecycle", "listing",
)


# --- health -----------------------------------------------------------------------------

NOW = "2024-01-29 20:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def due_sources(spark, sf_dir):
    srcs, scans = derived.scan_state(spark, sf_dir)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    # Only a source's last scan can still be open.
    last = scans.groupBy("source_id").agg(F.max("scan_seq").alias("scan_seq"))
    due = health.due_sources(srcs, scans.join(last, ["source_id", "scan_seq"], "left_semi"), at)
    return due.select("source_id", "trigger", "next_scan_at", "created_at")


DUE_SQL = sql(
    """SELECT source_id, CASE WHEN last_successful_scan_at IS NULL THEN 'initial' ELSE 'scheduled' END AS trigger, next_scan_at, created_at
    FROM state_sources s WHERE monitoring_status = 'active' AND connector_type IS NOT NULL AND setup_status <> 'setup_required'
    AND next_scan_at <= TIMESTAMP '2024-02-01 00:00:00'
    AND NOT EXISTS (SELECT 1 FROM state_scans q WHERE q.source_id = s.source_id AND q.status IN ('queued', 'running')
      AND q.scan_seq = (SELECT max(x.scan_seq) FROM state_scans x WHERE x.source_id = s.source_id))""",
    "state_sources", "state_scans",
)


def scan_queue(spark, sf_dir):
    _, scans = derived.scan_state(spark, sf_dir)
    return health.scan_queue(scans, 10).select("scan_run_id", "created_at")


QUEUE_SQL = sql(
    "SELECT scan_run_id, created_at FROM state_scans WHERE status = 'queued' ORDER BY created_at, scan_run_id LIMIT 10",
    "state_scans",
)


def stale_runs(spark, sf_dir):
    srcs, scans = derived.scan_state(spark, sf_dir)
    new_scans, new_sources = health.recover_stale(scans, srcs, _now())
    left = new_scans.groupBy("source_id").agg(
        F.sum((F.col("status") == "interrupted").cast("long")).alias("interrupted"),
        F.sum((F.col("status") == "running").cast("long")).alias("running"),
    )
    return new_sources.join(left, "source_id").select(
        "source_id", "interrupted", "running", "next_scan_at"
    )


STALE_SQL = sql(
    f""", m AS (SELECT source_id, status = 'running' AS run,
      status = 'running' AND (started_at IS NULL OR started_at <= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS stale FROM state_scans),
    c AS (SELECT source_id, count(*) FILTER (WHERE stale) AS interrupted, count(*) FILTER (WHERE run AND NOT stale) AS running FROM m GROUP BY 1)
    SELECT s.source_id, interrupted, running, CASE WHEN interrupted > 0 THEN TIMESTAMP '{NOW}' ELSE next_scan_at END AS next_scan_at
    FROM state_sources s JOIN c ON c.source_id = s.source_id""",
    "state_sources", "state_scans",
)


def source_health(spark, sf_dir):
    state = health.source_health(derived.source_events(spark, sf_dir))
    clock = health.source_clock(derived.scan_history(spark, sf_dir))
    return state.join(clock, "source_id", "left")


HEALTH_SQL = sql(
    """, ev AS (SELECT source_id, finished_at AS ts, 0 AS seq, 'scan' AS kind, complete AS ok, error_code AS code, false AS retryable FROM scans
    UNION ALL SELECT 'src' || (user_id % 10), ts, event_id, CASE event_id % 11 WHEN 0 THEN 'config' WHEN 1 THEN 'url' ELSE 'validation' END,
      event_id % 2 = 0, CASE WHEN event_id % 11 = 4 AND event_id % 2 = 1 THEN 'network_failure' END, event_id % 11 = 4
      FROM events WHERE event_type = 'purchase' AND event_id % 11 < 5),
    ef AS (SELECT *, code IN ('access_blocked', 'detail_extraction_failure', 'facet_drift', 'invalid_configuration', 'robots_disallowed', 'unsupported_connector', 'zero_results') AS needs FROM ev),
    st AS (SELECT *, CASE WHEN kind = 'scan' AND needs THEN 'setup_required' WHEN kind = 'scan' AND code IS NULL AND ok THEN 'ready'
        WHEN kind = 'validation' AND ok THEN 'ready' WHEN kind = 'validation' THEN 'setup_required' WHEN kind = 'config' THEN 'unvalidated'
        WHEN kind = 'url' AND ok THEN 'unvalidated' WHEN kind = 'url' THEN 'setup_required' END AS setup,
      CASE WHEN kind = 'scan' AND needs THEN 'setup_required' WHEN kind = 'scan' AND code IS NOT NULL THEN 'temporarily_failing'
        WHEN kind = 'scan' AND ok THEN 'healthy' WHEN kind = 'scan' THEN 'temporarily_failing'
        WHEN kind = 'validation' AND ok THEN 'healthy' WHEN kind = 'validation' AND code IS NOT NULL AND retryable THEN 'temporarily_failing'
        WHEN kind = 'validation' THEN 'setup_required' END AS health FROM ef)
    SELECT s.source_id, coalesce(arg_max(setup, {'t': ts, 's': seq}) FILTER (WHERE setup IS NOT NULL), 'unvalidated') AS setup_status,
    coalesce(arg_max(health, {'t': ts, 's': seq}) FILTER (WHERE health IS NOT NULL), 'unknown') AS health_status,
    any_value(c.last_scan_attempt_at) AS last_scan_attempt_at, any_value(c.last_successful_scan_at) AS last_successful_scan_at, any_value(c.next_scan_at) AS next_scan_at
    FROM st s LEFT JOIN clock c ON c.source_id = s.source_id GROUP BY s.source_id""",
    "clock",
)


def next_scan_boundary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", next_boundary(F.col("ts")).alias("next_scan_at"))


BOUNDARY_SQL = """SELECT event_id, make_timestamp(((epoch_us(ts) // 1000000) // 21600 + 1) * 21600 * 1000000) AS next_scan_at FROM events"""


def scan_intervals(spark, sf_dir):
    return health.scan_intervals(derived.scan_history(spark, sf_dir)).drop("interval_end")


INTERVALS_SQL = sql(
    """SELECT source_id, make_timestamp((epoch_us(finished_at) // 21600000000) * 21600000000) AS interval_start, count(*) AS scans,
    count(*) FILTER (WHERE status IN ('success', 'success_with_warnings')) AS successes FROM scans GROUP BY ALL""",
    "scans",
)


def zero_result_guard(spark, sf_dir):
    """Complete scans without a listed job although earlier ones listed some; every scan whose
    day has few clicks counts as empty."""
    e = derived._scan_columns(table(spark, sf_dir, "events"))
    found = e.groupBy("source_id", "scan_run_id", "scan_seq", "kind").agg(
        F.sum((F.col("event_type") == "click").cast("long")).alias("clicks")
    )
    scans = found.select(
        "source_id", "scan_run_id", "scan_seq", (~F.col("kind").isin(0, 3)).alias("complete"),
        F.when(F.col("clicks") % 4 == 0, 0).otherwise(F.col("clicks")).alias("jobs_found"),
    )
    out = quality.zero_result_guard(scans, week())
    return out.withColumn("trailing_average", F.round("trailing_average", 6))


ZERO_SQL = sql(
    """, f AS (SELECT source_id, scan_run_id, scan_seq, CASE WHEN count(*) FILTER (WHERE event_type = 'click') % 4 = 0 THEN 0
        ELSE count(*) FILTER (WHERE event_type = 'click') END AS n FROM scan_events WHERE kind NOT IN (0, 3) GROUP BY ALL),
    a AS (SELECT *, avg(n) OVER (PARTITION BY source_id ORDER BY scan_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM f)
    SELECT source_id, scan_run_id, scan_seq, round(t, 6) AS trailing_average FROM a WHERE n = 0 AND t >= 1""",
    "scan_events",
)

QUERIES = {
    "lifecycle_history": (lifecycle_history, LIFECYCLE_SQL),
    "lifecycle_lineitem": (lifecycle_lineitem, LINEITEM_SQL),
    "lifecycle_events": (lifecycle_events, EVENTS_SQL),
    "change_log": (change_log, CHANGE_SQL),
    "initial_import": (initial_import, INITIAL_SQL),
    "scan_metrics": (scan_metrics, METRICS_SQL),
    "scan_status": (scan_status, STATUS_SQL),
    "missing_jobs": (missing_jobs, MISSING_SQL),
    "observed_span": (observed_span, SPAN_SQL),
    "identity_resolution": (identity_resolution, IDENTITY_SQL),
    "reconcile": (reconcile, RECONCILE_SQL),
    "reconcile_metrics": (reconcile_metrics, RECONCILE_METRICS_SQL),
    "due_sources": (due_sources, DUE_SQL),
    "scan_queue": (scan_queue, QUEUE_SQL),
    "stale_runs": (stale_runs, STALE_SQL),
    "source_health": (source_health, HEALTH_SQL),
    "next_scan_boundary": (next_scan_boundary, BOUNDARY_SQL),
    "scan_intervals": (scan_intervals, INTERVALS_SQL),
    "zero_result_guard": (zero_result_guard, ZERO_SQL),
}
