"""What the captures of a scan hold, as rows of one kind, and what follows from them.

Every reader turns a capture into rows that differ only in their ``tag``: a ``listed`` posting, a
``detail`` page's posting or error, the counts of a result ``page``, a ``next`` page, a ``facet`` value,
a ``warning``, and the ``capture`` itself. So all platforms are parsed into one table, which is written
once, and postings, outcomes and paging are worked out for all of them together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date
from ..functions.urls import canonicalize_url, in_scope
from ..operators import coverage
from ..operators.windows import latest_by, top_k

#: Columns that a tag fills; the others are null.
ENTRY = {
    "tag": "string", "key": "string", "code": "string", "n": "bigint", "position": "int", "part": "int",
    "items": "int", "total": "int", "signature": "string", "external_id": "string", "url": "string", "title": "string",
    "place": "string", "locations": "array<string>", "more_locations": "array<string>", "employment_type": "string",
    "posted": "string", "description_html": "string", "metadata": "map<string,string>",
}
BASE = {
    "source_id": "string", "scan_run_id": "string", "seq": "bigint", "platform": "string", "source_url": "string",
    "prefixes": "array<string>",
}
SITES, ATS_I, ATS_O = "paginated_html_jsonld", "icims_jibe_api", "oracle_ce_rest"
FIELD_READERS = ("avature_html", "hirebridge_html")


def entry(tag: str, **values: Column) -> Column:
    """One row's columns as a struct; all have the same shape."""
    values = {"tag": F.lit(tag), **values}
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ENTRY.items()])


def same(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def unfolded(df: DataFrame, entries: Column) -> DataFrame:
    """A row per entry of each row of ``df``."""
    more = {c: F.lit(None).cast(kind) for c, kind in BASE.items() if c not in df.columns}
    return df.withColumns(more).select(*BASE, F.inline(entries)) if more else df.select(*BASE, F.inline(entries))


def postings(rows: DataFrame, from_details: DataFrame | None = None) -> DataFrame:
    """Raw postings: usable details completed from their listing entry. Where rows are not written, they may be
    given in two: ``rows`` with all entries, ``from_details`` with all details.

    Per scan and key the entry of the later page wins, on a page the later one, and entries from
    scripts come after links. Sites need the entry and keep to their scope: a detail URL outside it
    falls back to the listing URL. The other platforms go without an entry if need be.
    """
    known = ["external_id", "url", "title", "place", "employment_type", "posted", "seq"]
    order = [F.coalesce("seq", F.lit(0)).alias("_seq"), F.coalesce("part", F.lit(0)).alias("_part"), F.coalesce("position", F.lit(0)).alias("_position")]
    listed = rows.where(F.col("tag") == "listed").select("scan_run_id", "key", *order, *[F.col(c).alias(f"l_{c}") for c in known])
    listed = latest_by(listed, ["scan_run_id", "key"], ["_seq", "_part", "_position"]).drop("_seq", "_part", "_position")
    details = (rows if from_details is None else from_details).where((F.col("tag") == "detail") & F.col("code").isNull())
    joined = details.join(listed.withColumn("_known", F.lit(True)), ["scan_run_id", "key"], "left")
    site, ats_o, fields = F.col("reader") == SITES, F.col("reader") == ATS_O, F.col("reader").isin(*FIELD_READERS)
    joined = joined.where(~site | F.coalesce("_known", F.lit(False)))
    candidate = canonicalize_url(F.coalesce("url", "key"), F.col("key"))
    scoped = F.when(in_scope(candidate, F.col("source_url"), F.col("prefixes")), candidate).otherwise(canonicalize_url(F.col("key")))
    url = F.when(site, scoped).when(ats_o, F.col("l_url")).when(fields, F.col("key")).otherwise(F.coalesce("url", "key"))
    place = F.array_compact(F.array("l_place"))
    locations = (
        F.when(ats_o, F.array_compact(F.concat("locations", F.array("l_place"), "more_locations")))
        .when(fields & (F.size("locations") <= 0), place)
        .otherwise(F.col("locations"))
    )
    external = F.coalesce("external_id", "l_external_id")
    own_metadata = F.create_map(F.lit("source"), F.col("platform"), F.lit("identifier"), external)
    return joined.select(
        "source_id", "scan_run_id", F.when(site, F.col("l_seq")).otherwise(F.col("seq")).alias("seq"),
        external.alias("external_id"),
        url.alias("url"),
        F.coalesce("title", "l_title", F.lit("Untitled role")).alias("title"),
        locations.alias("locations"),
        F.coalesce("employment_type", "l_employment_type").alias("employment_type"),
        parse_iso_date(F.coalesce("posted", "l_posted")).alias("posted_date"),
        "description_html",
        F.when(fields, own_metadata).otherwise(F.col("metadata")).alias("metadata"),
    )


def outcomes(rows: DataFrame) -> DataFrame:
    """scan_run_id, key, error_code of every listed posting: null when a detail page was usable, else why
    none was. A page that was read more than once counts as usable if one reading was."""
    read = F.when(F.col("tag") == "detail", F.struct(F.col("code").isNotNull().alias("bad"), F.col("code")))
    keyed = rows.where(F.col("tag").isin("listed", "detail")).groupBy("scan_run_id", "key").agg(
        F.max(F.col("tag") == "listed").alias("_listed"), F.min(read).alias("_best")
    )
    code = F.when(F.col("_best").isNull(), "detail_not_captured").otherwise(F.col("_best.code"))
    return keyed.where("_listed").select("scan_run_id", "key", code.alias("error_code"))


def _found(df: DataFrame, code: str | Column, url: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    url = F.lit(None).cast("string") if url is None else url
    return df.select("scan_run_id", code.alias("code"), url.alias("url"), F.lit(1).cast("bigint").alias("n"))


def paging(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings: scan_run_id, code, url, n; errors: scan_run_id, _failed).

    A site's link to a page that was read before is a loop. A next page that was not captured makes
    the scan incomplete; where the scan had read as many pages as its source allows, that is its page
    limit, which fails a site's scan. An API that gives a page twice fails the scan; if the items
    received fall short of the advertised total after a last page that was not empty, a result page
    was not captured. A saved facet that is gone or moved fails the scan.
    """
    captured = rows.where(F.col("tag") == "capture")
    visited = captured.groupBy("scan_run_id", "key").agg(F.min("seq").alias("_first"), F.min("total").alias("_limit"))
    nexts = rows.where(F.col("tag") == "next").groupBy("scan_run_id", "key", "url").agg(
        F.min("seq").alias("seq"), F.max("reader").alias("reader")
    )
    met = nexts.join(visited.drop("_limit"), ["scan_run_id", "key"], "left")
    site = F.col("reader") == SITES
    loops = _found(met.where(site & (F.col("_first") <= F.col("seq"))), "pagination_loop", F.col("key"))
    unread = met.where(F.col("_first").isNull()).groupBy("scan_run_id", "key").agg(F.max("reader").alias("reader"))
    counts = visited.groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("_pages"), F.min("_limit").alias("_limit"))
    unread = unread.join(counts, "scan_run_id")
    over = F.col("_pages") >= F.col("_limit")
    limited = unread.where(over).groupBy("scan_run_id").agg(F.max("reader").alias("reader"))
    pages = rows.where(F.col("tag") == "page")
    received = pages.groupBy("scan_run_id").agg(
        F.sum("items").alias("_received"), F.max_by(F.struct("items", "total"), "seq").alias("_last"),
        F.min("code").alias("code"),
    )
    short = (F.col("_last.items") > 0) & (F.col("_received") < F.col("_last.total"))
    repeated = pages.where(F.col("items") > 0).groupBy("scan_run_id", "signature").agg(
        F.min("seq").alias("_first"), F.max("seq").alias("_again")
    )
    warnings = [
        rows.where(F.col("tag") == "warning").select("scan_run_id", "code", F.col("key").alias("url"), "n"),
        loops,
        _found(unread.where(~over), "page_not_captured", F.col("key")),
        _found(limited.where(~site), "page_limit_reached"),
        _found(received.where(short), "page_not_captured"),
    ]
    errors = [
        _found(received.where(F.col("code").isNotNull()), F.col("code")).withColumn("n", F.lit(0)),
        _found(facet_drift(rows), "facet_drift").withColumn("n", F.lit(1)),
        _found(repeated.where(F.col("_first") < F.col("_again")), "pagination_loop").withColumn("n", F.lit(2)),
        _found(limited.where(site), "page_limit").withColumn("n", F.lit(3)),
    ]
    failed = reduce(DataFrame.unionByName, errors).groupBy("scan_run_id").agg(F.min_by("code", "n").alias("_failed"))
    return reduce(DataFrame.unionByName, warnings), failed


def facet_drift(rows: DataFrame) -> DataFrame:
    """scan_run_id of the scans whose saved facets do not match those that their pages offer."""
    saved = rows.where((F.col("tag") == "capture") & F.col("code").isNull() & F.col("external_id").isNotNull())
    saved = saved.groupBy("scan_run_id").agg(F.max("external_id").alias("_facets"))
    kind = "array<struct<facet_parameter:string,label:string,id:string>>"
    selected = saved.select(F.col("scan_run_id").alias("source_id"), F.posexplode(F.from_json("_facets", kind)).alias("seq", "_f"))
    offered = rows.where(F.col("tag") == "facet").select(
        F.col("scan_run_id").alias("source_id"), F.col("position").alias("group_seq"), F.col("key").alias("facet_parameter"),
        F.col("part").alias("value_seq"), F.col("title").alias("label"), F.col("external_id").alias("id"),
    )
    drift = coverage.facet_drift(selected.select("source_id", "seq", "_f.*"), offered)
    return drift.select(F.col("source_id").alias("scan_run_id")).distinct()


def validation(rows: DataFrame, k: int = 5) -> DataFrame:
    """What a trial scan of a source shows, one row per scan: valid, setup_status, code (why it needs
    setup), job_count (as advertised; null where a platform states none), listed, samples (the first
    ``k`` listed postings: title, url), facets (parameter, label, id in page order) and warnings.

    A refused or malformed page, a saved facet that is gone and an empty listing need setup. Samples are
    limited per scan before they are gathered, and a facet that many pages repeat counts once.
    """
    scans = rows.where(F.col("tag").isin("capture", "seen")).groupBy("source_id", "scan_run_id").agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("seq"))).alias("_refused")
    )
    pages = rows.where(F.col("tag") == "page").groupBy("scan_run_id").agg(
        F.max_by("total", "seq").cast("bigint").alias("job_count"), F.min("code").alias("_malformed")
    )
    place = F.struct(F.coalesce("seq", F.lit(0)), F.coalesce("part", F.lit(0)), F.coalesce("position", F.lit(0)))
    listed = rows.where(F.col("tag") == "listed").groupBy("scan_run_id", "key").agg(
        F.min(F.struct(place.alias("at"), "title", F.coalesce("url", "key").alias("url"))).alias("_f")
    )
    counts = listed.groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("listed"))
    first = top_k(listed.select("scan_run_id", "_f"), ["scan_run_id"], [F.col("_f")], k)
    samples = first.groupBy("scan_run_id").agg(
        F.transform(F.array_sort(F.collect_list("_f")), lambda f: F.struct(f["title"].alias("title"), f["url"].alias("url"))).alias("samples")
    )
    offered = rows.where(F.col("tag") == "facet").groupBy("scan_run_id", "key", "title", "external_id").agg(
        F.min(F.struct("position", "part")).alias("_at")
    )
    entry_ = F.struct("_at", F.col("key").alias("parameter"), F.col("title").alias("label"), F.col("external_id").alias("id"))
    facets = offered.groupBy("scan_run_id").agg(
        F.transform(F.array_sort(F.collect_list(entry_)), lambda f: F.struct(f["parameter"].alias("parameter"), f["label"].alias("label"), f["id"].alias("id"))).alias("facets")
    )
    warned = rows.where(F.col("tag") == "warning").groupBy("scan_run_id").agg(F.sum("n").alias("warnings"))
    drift = facet_drift(rows).withColumn("_drift", F.lit("facet_drift"))
    joined = scans
    for part in (pages, counts, samples, facets, warned, drift):
        joined = joined.join(part, "scan_run_id", "left")
    empty = (F.coalesce("listed", F.lit(0)) == 0) | (F.coalesce("job_count", F.lit(1)) == 0)
    code = F.coalesce("_refused", "_malformed", "_drift", F.when(empty, F.lit("zero_results")))
    return joined.select(
        "source_id", "scan_run_id", code.isNull().alias("valid"),
        F.when(code.isNull(), "ready").otherwise("setup_required").alias("setup_status"), code.alias("code"), "job_count",
        F.coalesce("listed", F.lit(0)).alias("listed"), "samples", "facets", F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )
