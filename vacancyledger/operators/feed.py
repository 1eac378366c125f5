"""The ranked feed, its counters, paged listings and sources with contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import MATCHER_VERSION, current_profile
from .windows import page, page_from, page_starts, Sort


def feed_items(
    jobs: DataFrame, matches: DataFrame, profiles: DataFrame, states: DataFrame
) -> DataFrame:
    """Every active job with its valid match (current profile, version, matcher and content)
    and the user's state. Only the columns a feed shows are read."""
    profile = current_profile(profiles)
    ident = profile.select(F.struct("p.profile_id", "p.profile_version")).scalar()
    active = jobs.where(F.col("lifecycle_status") == "active").select(
        "job_id", "source_id", "title", "canonical_url", "content_fingerprint",
        "initial_import", "first_discovered_at", "last_observed_at",
    )
    valid = (
        matches.where(F.col("matcher_version") == MATCHER_VERSION)
        .where(F.struct("profile_id", "profile_version") == ident)
        .select("job_id", "content_fingerprint", "classification", "score")
    )
    state = states.select("job_id", "seen_at", "dismissed_at")
    return (
        active.join(valid, ["job_id", "content_fingerprint"], "left")
        .join(state, "job_id", "left")
        .withColumn("item_class", F.coalesce("classification", F.lit("unmatched")))
        .withColumn("dismissed", F.col("dismissed_at").isNotNull())
        .withColumn("unseen", F.col("seen_at").isNull() & F.col("dismissed_at").isNull())
    )


def class_priority(item_class: Column) -> Column:
    return (
        F.when(item_class == "strong", 0)
        .when(item_class == "possible", 1)
        .when(item_class == "irrelevant", 2)
        .otherwise(3)
    )


def feed(
    items: DataFrame,
    sources: DataFrame,
    classification: str | None = None,
    include_dismissed: bool = False,
    show_irrelevant: bool = True,
) -> DataFrame:
    """Filtered and ranked feed: class, score, newest first; the job id breaks ties."""
    out = items if include_dismissed else items.where(~F.col("dismissed"))
    if classification is not None:
        out = out.where(F.col("item_class") == classification)
    elif not show_irrelevant:
        out = out.where(F.col("item_class") != "irrelevant")
    named = out.join(sources.select("source_id", "company"), "source_id", "inner")
    return rank_feed(named)


def rank_feed(items: DataFrame) -> DataFrame:
    return items.orderBy(
        class_priority(F.col("item_class")),
        F.coalesce("score", F.lit(-1)).desc(),
        F.col("first_discovered_at").desc(),
        "job_id",
    )


def feed_counters(items: DataFrame) -> DataFrame:
    """Totals over all active jobs, independent of the feed's filters."""

    def tally(flag: Column) -> Column:
        return F.coalesce(F.sum(flag.cast("long")), F.lit(0))

    return items.agg(
        tally(F.col("unseen") & (F.col("item_class") == "strong")).alias("unseen_strong"),
        tally(F.col("unseen") & (F.col("item_class") == "possible")).alias("unseen_possible"),
        tally(F.col("dismissed")).alias("dismissed_total"),
    )


def class_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("item_class").agg(F.count(F.lit(1)).alias("items"))


def jobs_page(
    jobs: DataFrame,
    number: int,
    size: int,
    source_id: str | None = None,
    lifecycle_status: str | None = None,
) -> DataFrame:
    """One page of the job list, newest first, with the total over all pages."""
    chosen = jobs
    if source_id is not None:
        chosen = chosen.where(F.col("source_id") == source_id)
    if lifecycle_status is not None:
        chosen = chosen.where(F.col("lifecycle_status") == lifecycle_status)
    total = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = page(chosen, [F.col("first_discovered_at").desc(), F.col("job_id")], number, size)
    return rows.withColumn("total", total)


#: Newest first; the id names a row.
JOB_ORDER = (Sort("first_discovered_at", descending=True), Sort("job_id"))


def jobs_page_index(jobs: DataFrame, size: int) -> DataFrame:
    """Where each page of the job list starts: page, first_discovered_at, job_id."""
    day = F.datediff(F.lit("9999-12-31").cast("date"), F.col("first_discovered_at").cast("date"))
    return page_starts(jobs, JOB_ORDER, size, day)


def jobs_page_from(jobs: DataFrame, index: DataFrame, number: int, size: int) -> DataFrame:
    """The page of the job list that the index names, without passing over the pages before it."""
    at = index.where(F.col("page") == number).select(*[s.column for s in JOB_ORDER]).first()
    if at is None:
        return jobs.limit(0)
    return page_from(jobs, JOB_ORDER, list(at), size)


def jobs_page_after(jobs: DataFrame, last: tuple, size: int) -> DataFrame:
    """The rows that follow the row with this (first_discovered_at, job_id)."""
    return page_from(jobs, JOB_ORDER, last, size, after=True)


def scan_jobs_page(observations: DataFrame, scan_run_id: str, number: int, size: int) -> DataFrame:
    """One page of the observations of a scan, by title."""
    chosen = observations.where(F.col("scan_run_id") == scan_run_id)
    total = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = page(chosen, [F.col("title"), F.col("observation_id")], number, size)
    return rows.withColumn("total", total)


def sources_with_contacts(sources: DataFrame, contacts: DataFrame) -> DataFrame:
    """Sources by creation time, each followed by its contacts by name; a source without
    contacts has one row with nulls. One row per contact, so no source has to fit in a task."""
    listed = sources.join(
        contacts.select("source_id", "contact_id", "name", "contact_url"), "source_id", "left"
    )
    return listed.orderBy("created_at", "source_id", "name", "contact_id")


def contact_counts(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("contacts"), F.min("name").alias("first_contact")
    )
