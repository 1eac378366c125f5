"""Extraction of landed captures: postings, and what became of every page of a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, settle, split_list
from ..functions.urls import canonicalize_url, in_scope, query_param, url_path
from ..operators import access, coverage, lifecycle
from ..operators.normalize import normalize
from ..session import shared_table
from . import ats_json, html_fields, html_pages, jsonld, scan_rows

RAW_COLUMNS = (
    "source_id", "scan_run_id", "seq", "external_id", "url", "title", "locations",
    "employment_type", "posted_date", "description_html", "metadata",
)

#: Listing pages of a scan, on sites and on the other platforms, unless the source's ``max_pages`` says otherwise.
MAX_PAGES = (500, 100)


@dataclass(frozen=True)
class SiteRules:
    """Site settings of the HTML platforms, as data; a source's own settings override them."""

    platform: str
    allowed_paths: tuple[str, ...]
    detail_regex: str
    id_group: int = 0
    embedded_marker: str = ""
    embedded_path: tuple[str, ...] = ()
    detail_template: str = ""
    #: Links that lead to the next page besides the usual marks.
    next_links: Callable[[DataFrame], Column] | None = None


# Paths and patterns of the supported HTML sites.
_DDO = {"embedded_marker": "phApp.ddo =", "embedded_path": ("eagerLoadRefineSearch", "data", "jobs")}
SITE_RULES = {
    "phenom": SiteRules(
        "phenom", ("/global/en",), r"/global/en/job/[^/]+(?:/|$)",
        detail_template="/global/en/job/{id}/{slug}", next_links=html_pages.paging_item, **_DDO,
    ),
    "phenom_kwiktrip": SiteRules(
        "phenom_kwiktrip", ("/us/en",), r"/us/en/job/[^/]+(?:/|$)",
        detail_template="/us/en/job/{id}/{slug}", **_DDO,
    ),
    "phenom_toyota": SiteRules(
        "phenom_toyota", ("/us/en",), r"/us/en/job/[^/]+(?:/|$)",
        detail_template="/us/en/job/{id}/{slug}", **_DDO,
    ),
    "eightfold": SiteRules("eightfold", ("/careers",), r"/careers/job/(\d+)(?:/|$)", id_group=1),
    "happydance": SiteRules(
        "happydance", ("/en/jobs",), r"/en/jobs/\d+(?:/|$)", next_links=html_pages.nav_page
    ),
}


def _of_kind(captures: DataFrame, kind: str) -> DataFrame:
    return captures.where(F.col("kind") == kind)


def _by_site(value: Callable[[SiteRules], Column]) -> Column:
    return F.coalesce(*[F.when(F.col("platform") == p, value(r)) for p, r in SITE_RULES.items()])


def allowed_paths() -> Column:
    """Path prefixes of a source: its own setting, comma-separated, else those of its site."""
    own = split_list(F.try_element_at("config", F.lit("allowed_paths")))
    usual = _by_site(lambda r: F.array(*[F.lit(p) for p in r.allowed_paths]))
    return F.when(F.size(own) > 0, own).otherwise(usual)


def _setting(name: str) -> Column:
    """What a source's own settings say; null where they say nothing."""
    return blank_to_null(F.try_element_at("config", F.lit(name)))


def _of_links(links: DataFrame, *entries: Column) -> DataFrame:
    """Rows of the entries that hold for a link; the link's columns are computed once."""
    return scan_rows.unfolded(settle(links), F.array_compact(F.array(*entries)))


def _counted(code: str, hit: Column) -> Column:
    return F.when(hit, scan_rows.entry("warning", code=F.lit(code), key=F.col("page_url"), n=F.lit(1)))


def _site_links(pages: DataFrame) -> DataFrame:
    """Job links, next pages and refused links of the listing pages of all HTML sites, in one pass."""
    links = html_pages.anchors(pages, ("platform", "source_url", "prefixes", "config"))
    # A source's own pattern may name its group in the form of another dialect.
    path, pattern = url_path(F.col("url")), F.replace(_setting("detail_path_regex"), F.lit("(?P<"), F.lit("(?<"))
    job, external, also = F.lit(False), F.lit(None).cast("string"), F.lit(False)
    for platform, rules in SITE_RULES.items():
        own = F.col("platform") == platform
        job = job | (own & path.rlike(rules.detail_regex))
        if rules.id_group:
            found = blank_to_null(F.regexp_extract(path, rules.detail_regex, rules.id_group))
            external = F.when(own, found).otherwise(external)
        if rules.next_links:
            also = also | (own & F.coalesce(rules.next_links(links), F.lit(False)))
    # The group called id is the external id; its number follows from the groups opened before it.
    before = F.substring_index(pattern, "(?<id>", 1)
    number = F.regexp_count(before, F.lit(r"(?<!\\)\((?!\?)|\(\?<(?![=!])")) + 1
    named = F.when(pattern.contains("(?<id>"), F.call_function("regexp_extract", path, pattern, number.cast("int")))
    external = F.when(pattern.isNotNull(), blank_to_null(named)).otherwise(external)
    marked = links.withColumns({
        "_plain": canonicalize_url(F.col("url")),
        "_job": F.coalesce(F.when(pattern.isNotNull(), F.rlike(path, pattern)), job),
        "_next": html_pages.is_next(links) | also, "_id": external,
    }).where("_job or _next")
    job_ok = in_scope(F.col("_plain"), F.col("source_url"), F.col("prefixes"))
    next_ok = in_scope(F.col("url"), F.col("source_url"), F.col("prefixes"))
    marked = marked.withColumns({"_job_ok": job_ok, "_next_ok": next_ok})
    return _of_links(
        marked,
        F.when(F.col("_job") & F.col("_job_ok"), scan_rows.entry(
            "listed", key=F.col("_plain"), external_id=F.col("_id"), title=F.col("text"), position=F.col("position"),
        )),
        _counted("off_host_links_ignored", F.col("_job") & ~F.col("_job_ok")),
        F.when(F.col("_next") & F.col("_next_ok"), scan_rows.entry("next", key=F.col("url"), url=F.col("page_url"))),
        _counted("unsafe_pagination_ignored", F.col("_next") & ~F.col("_next_ok")),
    )


def html_sites(captures: DataFrame) -> DataFrame:
    """All sites whose job pages carry JSON-LD, read together: rules come from ``platform`` and the
    source's ``config``. ``captures`` carry ``source_url``, ``platform`` and ``config``."""
    staged = captures.withColumn("prefixes", allowed_paths())
    pages = _of_kind(staged, "listing")
    scripted = [p for p, r in SITE_RULES.items() if r.embedded_marker]
    first = SITE_RULES[scripted[0]]
    template = F.coalesce(_setting("embedded_detail_template"), _by_site(lambda r: F.lit(r.detail_template)))
    embedded = jsonld.extract_embedded_jobs(
        pages.where(F.col("platform").isin(*scripted)), first.embedded_marker, list(first.embedded_path),
        template, F.col("source_url"), F.col("prefixes"), keep=("platform", "source_url", "prefixes", "config"),
    )
    scripted_rows = _of_links(embedded, scan_rows.entry(
        "listed", key=F.col("url"), external_id=F.col("external_id"), title=F.col("title"),
        position=F.col("position"), part=F.lit(1),
    ))
    found = jsonld.posting_fields(jsonld.extract_jobposting(_of_kind(staged, "detail")), F.col("platform"), whole=True)
    details = scan_rows.unfolded(found, F.array(scan_rows.entry(
        "detail", key=F.col("capture_url"), code=F.col("error_code"), posted=F.col("posted"),
        **scan_rows.same("external_id", "url", "title", "locations", "employment_type", "description_html", "metadata"),
    )))
    return _site_links(pages).unionByName(scripted_rows).unionByName(details)


def html_jsonld(captures: DataFrame, rules: SiteRules) -> DataFrame:
    """Raw postings of one site. ``captures`` carry ``source_url``; kinds are listing and detail."""
    none = F.lit(None).cast("map<string,string>")
    return _postings(html_sites, captures.withColumns({"platform": F.lit(rules.platform), "config": none}))


def _ats_w(captures: DataFrame) -> DataFrame:
    pages = ats_json.w_page_rows(_of_kind(captures, "listing"))
    # The key is the URL that was read; a posting may state another one.
    return pages.unionByName(ats_json.w_detail_rows(_of_kind(captures, "detail")))


def _ats_i(captures: DataFrame) -> DataFrame:
    """Listing pages hold whole postings."""
    return ats_json.i_page_rows(_of_kind(captures, "listing"))


def _ats_o(captures: DataFrame) -> DataFrame:
    details = _of_kind(captures, "detail").withColumn("external_id", _o_key())
    return ats_json.o_page_rows(_of_kind(captures, "listing")).unionByName(ats_json.o_detail_rows(details))


def _o_key() -> Column:
    return F.regexp_extract("url", r"ById;Id=([^,&]+)", 1)


def _classified(links: DataFrame, refused: str, **listed: Column) -> DataFrame:
    """Rows of links whose ``kind`` is job, next or rejected."""
    return _of_links(
        links,
        F.when(F.col("kind") == "job", scan_rows.entry(
            "listed", key=F.col("url"), position=F.col("position"), **scan_rows.same("external_id"), **listed,
        )),
        F.when(F.col("kind") == "next", scan_rows.entry("next", key=F.col("url"), url=F.col("page_url"))),
        _counted(refused, F.col("kind") == "rejected"),
    )


def _field_rows(details: DataFrame) -> DataFrame:
    return scan_rows.unfolded(details, F.array(scan_rows.entry(
        "detail", key=F.col("capture_url"), code=F.col("error_code"), posted=F.col("posted"),
        **scan_rows.same("title", "locations", "employment_type", "description_html"),
    )))


def _ats_a(captures: DataFrame) -> DataFrame:
    keep = ("platform", "source_url")
    links = html_pages.anchors(_of_kind(captures, "listing"), keep)
    listing = html_pages.ats_a_listing(links, F.col("source_url"), keep)
    pages = _classified(listing, "unsafe_avature_links_ignored")
    return pages.unionByName(_field_rows(html_fields.ats_a_detail(_of_kind(captures, "detail"), keep)))


def _ats_h(captures: DataFrame) -> DataFrame:
    """The board is embedded: ``source_url`` of its captures is the embed URL with the client."""
    keep = ("platform", "source_url")
    entries = html_fields.html_entries(_of_kind(captures, "listing"), html_fields.ATS_H_FIELDS)
    placed = entries.withColumns({
        "url": canonicalize_url(F.col("href"), F.col("page_url"), keep_query=True), "platform": F.lit("hirebridge"),
    })
    client = query_param(F.col("source_url"), "cid")
    listing = html_pages.ats_h_listing(placed, client, (*keep, "location", "employment_type"))
    pages = _classified(
        listing, "unsafe_hirebridge_links_ignored", place=F.col("location"), employment_type=F.col("employment_type")
    )
    return pages.unionByName(_field_rows(html_fields.ats_h_detail(_of_kind(captures, "detail"), keep)))


def _postings(reader: Callable[[DataFrame], DataFrame], captures: DataFrame) -> DataFrame:
    for column, kind in (("platform", "string"), ("config", "map<string,string>"), ("source_url", "string")):
        if column not in captures.columns:
            captures = captures.withColumn(column, F.lit(None).cast(kind))
    # Entries and postings are joined, so each side reads just the captures that hold it: none is parsed twice.
    listed, details = (
        reader(_of_kind(captures, kind)).withColumn("reader", F.lit(READER_NAMES[reader]))
        for kind in ("listing", POSTING_KINDS.get(reader, "detail"))
    )
    return scan_rows.postings(listed, details).select(*RAW_COLUMNS)


def ats_w(captures: DataFrame) -> DataFrame:
    return _postings(_ats_w, captures)


def ats_i(captures: DataFrame) -> DataFrame:
    return _postings(_ats_i, captures)


def ats_o(captures: DataFrame) -> DataFrame:
    return _postings(_ats_o, captures)


def ats_a(captures: DataFrame) -> DataFrame:
    return _postings(_ats_a, captures)


def ats_h(captures: DataFrame) -> DataFrame:
    return _postings(_ats_h, captures)


#: Reader and platforms; the HTML sites share one, so the plan does not grow with the sites.
EXTRACTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "workday_cxs": (_ats_w, ("workday",)),
    "icims_jibe_api": (_ats_i, ("icims_jibe",)),
    "oracle_ce_rest": (_ats_o, ("oracle_ce",)),
    "avature_html": (_ats_a, ("avature",)),
    "hirebridge_html": (_ats_h, ("hirebridge",)),
    "paginated_html_jsonld": (html_sites, tuple(SITE_RULES)),
}

READER_NAMES = {reader: name for name, (reader, _) in EXTRACTORS.items()}

#: Where postings lie, if not on detail pages.
POSTING_KINDS = {_ats_i: "listing"}

_SITE = ("source_url", "connector_type", "platform", "config")


def land_captures(captures: DataFrame, sources: DataFrame, path: str, robots: DataFrame | None = None) -> None:
    """Store captures with the site they belong to and whether they may be read, by platform and kind,
    so that every reader scans just the pages it reads and nothing is judged twice."""
    judged = gate(_sited(captures, sources), robots)
    judged.write.mode("append").partitionBy("platform", "kind").parquet(path)


def _sited(captures: DataFrame, sources: DataFrame) -> DataFrame:
    """Captures with their source's site; those landed by ``land_captures`` have it already."""
    if set(_SITE) <= set(captures.columns):
        return captures
    config = F.col("config") if "config" in sources.columns else F.lit(None).cast("map<string,string>")
    own = sources.select(
        "source_id", F.col("url").alias("source_url"), "connector_type", "platform", config.alias("config")
    )
    return captures.join(own, "source_id")


def gate(captures: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Add ``refused``: why a capture must not be read (its response's error code, or the robots file
    of its origin); null when it may; and ``robots_code``. A capture without ``status`` column counts as
    answered; one that has ``refused`` already is only held against the robots files."""
    if "refused" in captures.columns:
        judged = captures
    else:
        answered = captures if "status" in captures.columns else captures.withColumn("status", F.lit(200))
        judged = access.response_outcome(answered)
        judged = judged.withColumn("refused", F.when(F.col("outcome") != "ok", F.col("outcome"))).drop("outcome", "retryable")
    if robots is not None:
        judged = access.robots_filter(judged.drop("robots_code"), robots)
        code = F.when(~F.col("allowed"), "robots_disallowed").otherwise(F.col("refused"))
        return judged.withColumn("refused", code).drop("allowed")
    if "robots_code" not in judged.columns:
        judged = judged.withColumn("robots_code", F.lit(None).cast("string"))
    return judged


class ScanResult(NamedTuple):
    """Postings, the outcome of every listed posting, warnings and one row per scan."""

    postings: DataFrame  # normalised
    details: DataFrame  # scan_run_id, key, error_code (null: usable)
    warnings: DataFrame  # scan_run_id, code, url, n
    scans: DataFrame  # source_id, scan_run_id, pages_visited, listed, usable, complete, status, ...


def parse_captures(judged: DataFrame) -> DataFrame:
    """All that the captures hold, as rows of one kind (see ``scan_rows``). Every body is read by one
    branch, the listing pages of the HTML sites by two (links, objects in scripts); only the readers of
    platforms that occur are planned."""
    good = judged.where(F.col("refused").isNull())
    parts = [_capture_rows(judged)]
    known = F.col("platform").isin(*[p for _, platforms in EXTRACTORS.values() for p in platforms])
    # At most one row per supported reader.
    occurring = {r["connector_type"] for r in judged.where(known & F.col("connector_type").isin(*EXTRACTORS)).select("connector_type").distinct().collect()}
    for connector, (extract, platforms) in EXTRACTORS.items():
        if connector not in occurring:
            continue
        own = (F.col("connector_type") == connector) & F.col("platform").isin(*platforms)
        parts.append(extract(good.where(own)).withColumn("reader", F.lit(connector)))
    return reduce(DataFrame.unionByName, parts)


def _capture_rows(judged: DataFrame) -> DataFrame:
    """A row for each capture, with the reason why it was not read."""
    key = F.when(F.col("platform") == "oracle_ce", _o_key()).otherwise(F.col("url"))
    listing, refused = F.col("kind") == "listing", F.col("refused")
    limit = F.coalesce(_setting("max_pages").try_cast("int"), F.when(F.col("connector_type") == scan_rows.SITES, MAX_PAGES[0]).otherwise(MAX_PAGES[1]))
    entries = F.array_compact(F.array(
        F.when(listing, scan_rows.entry(
            "capture", key=canonicalize_url(F.col("url"), keep_query=True), code=refused, total=limit,
            external_id=_setting("selected_facets"),
        )),
        F.when(~listing & refused.isNotNull(), scan_rows.entry("detail", key=key, code=refused)),
        F.when(F.col("robots_code") == "robots_unavailable", scan_rows.entry(
            "warning", key=F.col("url"), code=F.col("robots_code"), n=F.lit(1),
        )),
        # So that a scan of which only details were captured has a row.
        F.when(~listing, scan_rows.entry("seen")),
    ))
    return scan_rows.unfolded(judged, entries).withColumn("reader", F.lit(None).cast("string"))


def _parsed(captures: DataFrame, sources: DataFrame, robots: DataFrame | None) -> DataFrame:
    if set(_SITE) <= set(captures.columns):
        judged = gate(captures, robots)
    else:
        judged = shared_table(gate(_sited(captures, sources), robots), "captures", "platform", "kind")
    return shared_table(parse_captures(judged), "parsed", "tag")


def validate_sources(captures: DataFrame, sources: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """What trial scans show of their sources before they are monitored (see ``scan_rows.validation``)."""
    return scan_rows.validation(_parsed(captures, sources, robots))


def extract_scans(
    captures: DataFrame, sources: DataFrame, robots: DataFrame | None = None
) -> ScanResult:
    """What the landed captures of scans give.

    ``sources``: source_id, url, connector_type, platform, config (optional; not needed for captures from
    ``land_captures``). ``robots``: origin, body. Captures that the response or robots forbid are not
    read. A listed posting without a usable detail page is a failed detail with its reason; it makes
    the scan incomplete, as do a loop of next pages, a page limit and a result page or next page that
    was not captured. A scan fails when a listing page was refused or malformed, a saved facet is gone,
    an API repeats a page, a site goes on beyond its page limit, nothing is listed or nothing usable.

    Captures are judged and parsed once: what they hold is written to the shared folder by kind of
    row, and all results are read from there.
    """
    rows = _parsed(captures, sources, robots)
    details = shared_table(scan_rows.outcomes(rows), "outcomes")
    failed = details.where(F.col("error_code").isNotNull()).select(
        "scan_run_id", F.col("error_code").alias("code"), F.col("key").alias("url"), F.lit(1).cast("long").alias("n")
    )
    raised, errors = scan_rows.paging(rows)
    warnings = shared_table(coverage.warning_counts(raised.unionByName(failed)), "warnings")
    per_scan = rows.where(F.col("tag").isin("capture", "seen")).groupBy("source_id", "scan_run_id").agg(
        F.sum(((F.col("tag") == "capture") & F.col("code").isNull()).cast("long")).alias("_pages"),
        F.min_by("code", F.when((F.col("tag") == "capture") & F.col("code").isNotNull(), F.col("seq"))).alias("_refused"),
    )
    done = lifecycle.completeness(details, warnings, per_scan)
    code = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_failed").isNotNull(), F.col("_failed"))
        .when(F.col("listed") == 0, "zero_results")
        .otherwise(F.col("error_code"))
    )
    outcome = per_scan.join(done, "scan_run_id").join(errors, "scan_run_id", "left").select(
        "source_id", "scan_run_id", (F.col("_pages") + F.col("listed")).alias("pages_visited"),
        "listed", "usable", (F.col("complete") & code.isNull()).alias("complete"), code.alias("error_code"),
    )
    scans = outcome.join(lifecycle.scan_status(outcome, warnings).drop("source_id"), "scan_run_id")
    return ScanResult(normalize(scan_rows.postings(rows).select(*RAW_COLUMNS)), details, warnings, scans)


def extract_postings(
    captures: DataFrame, sources: DataFrame, robots: DataFrame | None = None
) -> DataFrame:
    """Normalised postings of all captures that may be read, each read by its source's extractor."""
    return extract_scans(captures, sources, robots).postings
