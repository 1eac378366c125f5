"""Domain tables derived from the test tables, each as a Spark plan and as a SQL fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.locations import identity_key
from ..functions.text import STOPWORDS
from ..operators import health
from ..operators.normalize import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(col: str) -> Column:
    return F.col(col).cast("string")


def at_hours(hours: Column) -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(start) + hours * 3600)


# --- documents as postings --------------------------------------------------------------


def _work_phrase(doc_id: str = "doc_id") -> Column:
    k = F.col(doc_id) % 5
    return (
        F.when(k == 0, " On-site only")
        .when(k == 1, " remote friendly")
        .when(k == 2, " Hybrid, onsite twice a week")
        .otherwise("")
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = text_id("doc_id")
    return d.select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("scan-"), "source").alias("scan_run_id"),
        F.col("doc_id").alias("seq"),
        doc.alias("external_id"),
        F.concat(
            F.lit("HTTPS://Careers.Example.com:443/"), "source", F.lit("/./jobs/x/../"), doc,
            F.lit("?utm_source=feed&lang="), "lang", F.lit("&b=&a=1#top"),
        ).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.array("source", F.concat(F.lit("  "), "lang", F.lit(" ")), "lang").alias("locations"),
        F.when(F.col("doc_id") % 3 == 0, " Full  time ").when(F.col("doc_id") % 3 == 1, "Part time").alias(
            "employment_type"
        ),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias(
            "posted_date"
        ),
        F.concat("text", _work_phrase()).alias("description_html"),
        F.create_map(
            F.lit("source"), F.col("lang"), F.lit("identifier"), doc, F.lit("secret"), F.lit("x")
        ).alias("metadata"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a job snapshot; every tenth job closed, every tenth possibly closed."""
    n = normalize(raw_postings(spark, sf_dir))
    k = F.col("seq") % 10
    hours = F.col("seq") % 1000
    return n.select(
        "*",
        F.col("external_id").alias("job_id"),
        F.when(k == 0, "closed").when(k == 1, "possibly_closed").otherwise("active").alias(
            "lifecycle_status"
        ),
        F.when(k == 0, 2).when(k == 1, 1).otherwise(0).alias("consecutive_successful_absences"),
        (F.col("seq") % 4 == 0).alias("initial_import"),
        at_hours(hours).alias("first_discovered_at"),
        at_hours(hours + 24).alias("last_observed_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)

    def word(i: int) -> Column:
        return F.try_element_at(words, F.lit(i))

    return b.select(
        F.concat(F.lit("p"), text_id("item_id")).alias("profile_id"),
        at_hours(F.col("item_id")).alias("created_at"),
        F.lit(3).alias("version"),
        F.regexp_replace("text", r"\. ", "\n").alias("resume_text"),
        F.array(F.concat_ws(" ", word(1), word(2)), word(3)).alias("target_roles"),
        F.array(word(5)).alias("adjacent_roles"),
        F.array(F.lit("FR"), F.lit("Src3")).alias("preferred_locations"),
        F.when(F.col("item_id") % 2 == 0, "remote_or_hybrid").otherwise("remote_only").alias(
            "remote_preference"
        ),
        F.array(F.lit("Full time")).alias("employment_types"),
        F.array(word(4), word(6), word(8), F.lit(" Remote ")).alias("required_terms"),
        F.array(word(9), F.lit("Zebra")).alias("excluded_terms"),
        F.lit("").alias("preference_notes"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as stored match results of the current profile; a fifth has outdated content, a
    seventh an old profile version."""
    labels = table(spark, sf_dir, "labels")
    content = jobs(spark, sf_dir).select(
        F.col("seq").alias("doc_id"), "job_id", F.col("content_fingerprint").alias("_fp")
    )
    best = F.col("quality") * 60 + F.col("doc_id") % 40
    score = F.when(F.col("toxic") == 1, F.lit(0)).otherwise(best).cast("int")
    return labels.join(content, "doc_id").select(
        "job_id",
        F.lit("p0").alias("profile_id"),
        F.when(F.col("doc_id") % 7 == 0, 2).otherwise(3).alias("profile_version"),
        F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("_fp")).alias("content_fingerprint"),
        F.lit("hybrid-v1").alias("matcher_version"),
        score.alias("score"),
        F.when(score >= 75, "strong").when(score >= 45, "possible").otherwise("irrelevant").alias(
            "classification"
        ),
        F.lit("local").alias("provider"),
        F.lit("fallback").alias("provider_status"),
    )


def user_state_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as seen/dismissed patches on jobs."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.where(kind != "purchase").select(
        text_id("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", True).when(kind == "signup", False).alias("seen"),
        F.when(kind == "error", True).when(kind == "view", False).alias("dismissed"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources as careers sources, named after a nation."""
    d = table(spark, sf_dir, "documents").select("source").distinct()
    number = F.substring("source", 4, 10).cast("int")
    nation = table(spark, sf_dir, "nation")
    return d.withColumn("_n", number % 25).join(nation, F.col("_n") == F.col("n_nationkey")).select(
        F.col("source").alias("source_id"),
        F.col("n_name").alias("company"),
        at_hours(number % 7).alias("created_at"),
    )


# --- events as scan history -------------------------------------------------------------


def _scan_columns(e: DataFrame) -> DataFrame:
    source = F.col("user_id") % 10
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    kind = (source + day) % 7
    return e.select(
        F.concat(F.lit("src"), source.cast("string")).alias("source_id"),
        F.concat(F.lit("src"), source.cast("string"), F.lit(":"), day.cast("string")).alias(
            "scan_run_id"
        ),
        day.alias("scan_seq"),
        kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id", "event_id", "event_type", "value",
    )


ERROR_CODES = (
    "access_blocked", "network_failure", "zero_results", "transient_http_failure", "facet_drift",
)


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per source and day: a seventh failed, a seventh partial, some with warnings."""
    e = _scan_columns(table(spark, sf_dir, "events"))
    grouped = e.groupBy("source_id", "scan_run_id", "scan_seq", "kind").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")
    )
    failed, partial = F.col("kind") == 0, F.col("kind") == 3
    codes = F.array(*[F.lit(c) for c in ERROR_CODES])
    return grouped.select(
        "source_id", "scan_run_id", "scan_seq", "started_at", "finished_at",
        (~failed & ~partial).alias("complete"),
        F.when(failed, "failed")
        .when(partial, "partial")
        .when(F.col("kind") == 5, "success_with_warnings")
        .otherwise("success")
        .alias("status"),
        F.when(
            failed, F.element_at(codes, (F.col("scan_seq") % len(ERROR_CODES) + 1).cast("int"))
        ).alias("error_code"),
    )


def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scans listed, repeats included: users viewed or clicked that day."""
    e = _scan_columns(table(spark, sf_dir, "events"))
    user = text_id("user_id")
    return e.where(F.col("event_type").isin("view", "click") & (F.col("kind") != 0)).select(
        "source_id", "scan_run_id", "scan_seq",
        F.col("event_id").alias("seq"),
        F.col("ts").alias("observed_at"),
        user.alias("external_id"),
        F.concat(F.lit("https://careers.example.com/jobs/"), user).alias("canonical_url"),
        F.concat(F.lit("Job "), user).alias("title"),
        F.col("event_type").alias("content_fingerprint"),
    ).withColumn("identity_key", identity_key(F.col("external_id"), F.col("canonical_url")))


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan results, validations and edits of sources in one event table."""
    scans = scan_history(spark, sf_dir).select(
        "source_id", F.col("finished_at").alias("ts"), F.lit(0).cast("long").alias("seq"),
        F.lit("scan").alias("kind"), F.col("complete").alias("ok"), F.col("error_code").alias("code"),
        F.lit(False).alias("retryable"),
    )
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    k = F.col("event_id") % 11
    edits = e.where(k < 5).select(
        F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string")).alias("source_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(k == 0, "config").when(k == 1, "url").otherwise("validation").alias("kind"),
        (F.col("event_id") % 2 == 0).alias("ok"),
        F.when((k == 4) & (F.col("event_id") % 2 == 1), "network_failure").alias("code"),
        (k == 4).alias("retryable"),
    )
    return scans.unionByName(edits)


def scan_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources with their clocks, and the history with its last scans still unfinished."""
    history = scan_history(spark, sf_dir)
    clock = health.source_clock(history)
    number = F.substring("source_id", 4, 10).cast("int")
    srcs = clock.select(
        "source_id", "last_scan_attempt_at", "last_successful_scan_at", "next_scan_at",
        F.when(number == 9, "paused").otherwise("active").alias("monitoring_status"),
        F.when(number != 8, "paginated_html_jsonld").alias("connector_type"),
        F.when(number == 7, "setup_required").otherwise("ready").alias("setup_status"),
        at_hours(number % 3).alias("created_at"),
    )
    k = (number + F.col("scan_seq")) % 17
    open_scans = history.select(
        "source_id", "scan_run_id", "scan_seq",
        F.when(k == 0, "running").when(k == 1, "queued").otherwise(F.col("status")).alias("status"),
        F.when((k == 0) & (F.col("scan_seq") % 2 == 0), F.lit(None)).when(k != 1, F.col("started_at")).alias(
            "started_at"
        ),
        F.when(k > 1, F.col("finished_at")).alias("finished_at"),
        F.when(k > 1, F.col("error_code")).alias("error_code"),
        F.col("started_at").alias("created_at"),
    )
    return srcs, open_scans


# --- the same tables in SQL -------------------------------------------------------------

WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def clean_sql(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{WS}', ' ', 'g')), '')"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(x: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all({fold_sql(x)}, '[a-z0-9+#.]{{2,}}')), "
        f"lambda t: t NOT IN ({_STOP}))"
    )


def words_sql(i: int) -> str:
    return f"regexp_extract_all(text, '[A-Za-z]+')[{i}]"


_PHRASE = """CASE doc_id % 5 WHEN 0 THEN ' On-site only' WHEN 1 THEN ' remote friendly'
    WHEN 2 THEN ' Hybrid, onsite twice a week' ELSE '' END"""
_HOUR = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * ({})"
_SCAN_KIND = "((user_id % 10) + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) % 7"

CTES = {
    "postings": (
        (),
        f"""SELECT doc_id, source AS source_id, CAST(doc_id AS VARCHAR) AS job_id, lang,
        'https://careers.example.com/' || source || '/jobs/' || doc_id || '?a=1&lang=' || lang AS canonical_url,
        coalesce({clean_sql("split_part(text, chr(10), 1)")}, 'Untitled role') AS title,
        list_sort([source, lang]) AS locations,
        CASE doc_id % 3 WHEN 0 THEN 'Full time' WHEN 1 THEN 'Part time' END AS employment_type,
        DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS posted_date,
        {clean_sql("text || " + _PHRASE)} AS description_text
        FROM documents""",
    ),
    "jobs": (
        ("postings",),
        f"""SELECT *, sha256(title || chr(31) || array_to_string(locations, chr(29)) || chr(31)
            || coalesce(employment_type, chr(30)) || chr(31) || strftime(posted_date, '%Y-%m-%d')
            || chr(31) || coalesce(description_text, chr(30))) AS fp,
        CASE doc_id % 10 WHEN 0 THEN 'closed' WHEN 1 THEN 'possibly_closed' ELSE 'active' END AS lifecycle_status,
        {_HOUR.format("doc_id % 1000")} AS first_discovered_at
        FROM postings""",
    ),
    "prof": (
        (),
        f"""SELECT 'p' || item_id AS profile_id, 3 AS version,
        regexp_replace(text, '\\. ', chr(10), 'g') AS resume_text,
        [{words_sql(1)} || ' ' || {words_sql(2)}, {words_sql(3)}] AS target_roles,
        [{words_sql(5)}] AS adjacent_roles,
        ['FR', 'Src3'] AS preferred_locations,
        CASE item_id % 2 WHEN 0 THEN 'remote_or_hybrid' ELSE 'remote_only' END AS remote_preference,
        [{words_sql(4)}, {words_sql(6)}, {words_sql(8)}, ' Remote '] AS required_terms,
        [{words_sql(9)}, 'Zebra'] AS excluded_terms
        FROM benchmark ORDER BY item_id LIMIT 1""",
    ),
    "matches": (
        ("jobs",),
        """SELECT j.job_id, 'p0' AS profile_id, CASE WHEN l.doc_id % 7 = 0 THEN 2 ELSE 3 END AS profile_version,
        CASE WHEN l.doc_id % 5 = 0 THEN 'old' ELSE j.fp END AS fp, score,
        CASE WHEN score >= 75 THEN 'strong' WHEN score >= 45 THEN 'possible' ELSE 'irrelevant' END AS classification
        FROM (SELECT *, CASE WHEN toxic = 1 THEN 0 ELSE quality * 60 + doc_id % 40 END AS score FROM labels) l
        JOIN jobs j ON j.doc_id = l.doc_id""",
    ),
    "state_patches": (
        (),
        """SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id AS seq,
        CASE event_type WHEN 'click' THEN true WHEN 'signup' THEN false END AS seen,
        CASE event_type WHEN 'error' THEN true WHEN 'view' THEN false END AS dismissed
        FROM events WHERE event_type <> 'purchase'""",
    ),
    "states": (
        ("state_patches",),
        """SELECT job_id,
        (arg_max({'v': CASE WHEN seen THEN ts END}, {'t': ts, 's': seq}) FILTER (WHERE seen IS NOT NULL)).v AS seen_at,
        (arg_max({'v': CASE WHEN dismissed THEN ts END}, {'t': ts, 's': seq}) FILTER (WHERE dismissed IS NOT NULL)).v AS dismissed_at
        FROM state_patches GROUP BY job_id""",
    ),
    "srcs": (
        (),
        f"""SELECT source AS source_id, n_name AS company,
        {_HOUR.format("CAST(substr(source, 4) AS INTEGER) % 7")} AS created_at
        FROM (SELECT DISTINCT source FROM documents)
        JOIN nation ON n_nationkey = CAST(substr(source, 4) AS INTEGER) % 25""",
    ),
    "feed_items": (
        ("jobs", "prof", "matches", "states"),
        """SELECT j.job_id, j.source_id, j.title, j.canonical_url, j.first_discovered_at,
        coalesce(m.classification, 'unmatched') AS item_class, m.score,
        s.dismissed_at IS NOT NULL AS dismissed,
        s.seen_at IS NULL AND s.dismissed_at IS NULL AS unseen
        FROM jobs j
        LEFT JOIN (SELECT m.* FROM matches m JOIN prof p ON m.profile_id = p.profile_id AND m.profile_version = p.version) m
          ON m.job_id = j.job_id AND m.fp = j.fp
        LEFT JOIN states s ON s.job_id = j.job_id
        WHERE j.lifecycle_status = 'active'""",
    ),
    "scan_events": (
        (),
        f"""SELECT 'src' || (user_id % 10) AS source_id,
        date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS scan_seq,
        'src' || (user_id % 10) || ':' || date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS scan_run_id,
        {_SCAN_KIND} AS kind, ts, user_id, event_id, event_type, value FROM events""",
    ),
    "scans": (
        ("scan_events",),
        """SELECT source_id, scan_run_id, scan_seq, min(ts) AS started_at, max(ts) AS finished_at,
        kind NOT IN (0, 3) AS complete,
        CASE kind WHEN 0 THEN 'failed' WHEN 3 THEN 'partial' WHEN 5 THEN 'success_with_warnings' ELSE 'success' END AS status,
        CASE WHEN kind = 0 THEN ['access_blocked', 'network_failure', 'zero_results', 'transient_http_failure', 'facet_drift'][scan_seq % 5 + 1] END AS error_code
        FROM scan_events GROUP BY source_id, scan_run_id, scan_seq, kind""",
    ),
    "listing": (
        ("scan_events",),
        """SELECT source_id, scan_run_id, scan_seq, event_id AS seq, ts AS observed_at,
        CAST(user_id AS VARCHAR) AS external_id, 'external:' || user_id AS identity_key,
        'https://careers.example.com/jobs/' || user_id AS canonical_url, event_type AS fp
        FROM scan_events WHERE event_type IN ('view', 'click') AND kind <> 0""",
    ),
    "obs": (
        ("listing",),
        """SELECT source_id, scan_run_id, scan_seq, identity_key, arg_max(fp, seq) AS fp
        FROM listing GROUP BY ALL""",
    ),
    "lifecycle": (
        ("obs", "scans"),
        """SELECT o.*, (SELECT count(*) FROM scans s WHERE s.source_id = o.source_id AND s.complete
            AND s.scan_seq > o.last_seq) AS after_last
        FROM (SELECT source_id, identity_key, min(scan_seq) AS first_seq, max(scan_seq) AS last_seq,
            arg_max(fp, scan_seq) AS fp FROM obs GROUP BY ALL) o""",
    ),
    "clock": (
        ("scans",),
        """SELECT source_id, max(finished_at) AS last_scan_attempt_at,
        max(finished_at) FILTER (WHERE status IN ('success', 'success_with_warnings')) AS last_successful_scan_at,
        make_timestamp(((epoch_us(max(finished_at)) // 1000000) // 21600 + 1) * 21600 * 1000000) AS next_scan_at
        FROM scans GROUP BY source_id""",
    ),
    "state_sources": (
        ("clock",),
        f"""SELECT *, CASE WHEN source_id = 'src9' THEN 'paused' ELSE 'active' END AS monitoring_status,
        CASE WHEN source_id <> 'src8' THEN 'paginated_html_jsonld' END AS connector_type,
        CASE WHEN source_id = 'src7' THEN 'setup_required' ELSE 'ready' END AS setup_status,
        {_HOUR.format("CAST(substr(source_id, 4) AS INTEGER) % 3")} AS created_at FROM clock""",
    ),
    "state_scans": (
        ("scans",),
        """SELECT source_id, scan_run_id, scan_seq, created_at,
        CASE k WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE status END AS status,
        CASE WHEN k = 0 AND scan_seq % 2 = 0 THEN NULL WHEN k <> 1 THEN started_at END AS started_at
        FROM (SELECT *, started_at AS created_at, (CAST(substr(source_id, 4) AS INTEGER) + scan_seq) % 17 AS k FROM scans)""",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named fragments, and what they need, in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][0]:
                need(dependency)
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    return head + parts + "\n" + body
