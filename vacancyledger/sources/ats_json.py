"""Postings from the three hiring platforms that answer in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date
from ..functions.locations import as_variants, paragraph_html, render_o_location, sections_html
from ..functions.text import blank_to_null
from ..functions.urls import canonicalize_url, o_detail_url, url_host
from ..operators.coverage import listing_signature
from . import scan_rows
from .scan_rows import entry

_W_LISTING = """total int, facets array<struct<facetParameter:string,id:string,descriptor:string,
    label:string,values:array<struct<id:string,descriptor:string,label:string,count:int>>>>,
    jobPostings array<struct<title:string,externalPath:string,bulletFields:array<string>>>"""
_W_DETAIL = """jobPostingInfo struct<jobReqId:string,title:string,location:string,
    additionalLocations:array<string>,timeType:string,startDate:string,postedOn:string,
    jobDescription:string,externalUrl:string>"""
_I_PAGE = """count int, totalCount int,
    filter map<string,array<struct<name:string,count:int>>>,
    jobs array<struct<data:struct<req_id:string,id:string,title:string,description:string,
        full_location:string,employment_type:string,posted_date:string,update_date:string,
        category:string,meta_data:struct<canonical_url:string>>>>"""

_KEYS = ("source_id", "scan_run_id", "seq")


def _page_counts(parsed: DataFrame, items: Column, total: Column, ids: Column) -> DataFrame:
    """Items, advertised total and signature of each captured listing page."""
    return parsed.select(
        *_KEYS, F.col("url").alias("page_url"),
        F.coalesce(F.size(items), F.lit(0)).alias("items"),
        total.alias("total"),
        listing_signature(ids).alias("signature"),
        F.when(items.isNull(), "malformed_response").alias("error_code"),
    )


def _page_entry(items: Column, total: Column, ids: Column) -> Column:
    return entry(
        "page", items=F.coalesce(F.size(items), F.lit(0)), total=total, signature=listing_signature(ids),
        code=F.when(items.isNull(), "malformed_response"),
    )


def _entries(page: Column, *more: Column) -> Column:
    """A page's row and those of its lists; missing lists and entries are left out."""
    lists = F.array_compact(F.array(*more))
    return F.concat(F.array(page), F.array_compact(F.flatten(lists)))


def _detail_rows(fields: DataFrame, key: Column) -> DataFrame:
    names = ("external_id", "url", "title", "locations", "more_locations", "employment_type", "posted", "description_html", "metadata")
    own = scan_rows.same(*[n for n in names if n in fields.columns])
    return scan_rows.unfolded(fields, F.array(entry("detail", key=key, code=F.col("error_code"), **own)))


# --- ATS-W ------------------------------------------------------------------------------


def _w_parsed(captures: DataFrame) -> DataFrame:
    return captures.withColumn("_b", F.from_json("body", _W_LISTING))


def w_pages(captures: DataFrame) -> DataFrame:
    parsed = _w_parsed(captures)
    items = F.col("_b.jobPostings")
    total = F.coalesce(F.col("_b.total"), F.size(items))
    return _page_counts(parsed, items, total, F.transform(items, lambda i: i["externalPath"]))


def w_listing(captures: DataFrame) -> DataFrame:
    """Entries of listing pages; those without a path are dropped. ``source_url`` is required."""
    listed = _w_parsed(captures).select(
        *_KEYS, "source_url", F.posexplode("_b.jobPostings").alias("position", "_j")
    )
    return listed.where(F.length("_j.externalPath") > 0).select(
        *_KEYS, "position",
        F.try_element_at("_j.bulletFields", F.lit(1)).alias("external_id"),
        canonicalize_url(F.col("_j.externalPath"), F.col("source_url")).alias("url"),
        F.col("_j.title").alias("title"),
    )


def w_facets(captures: DataFrame) -> DataFrame:
    """Facet values a listing page offers, one row each."""
    groups = _w_parsed(captures).select(
        *_KEYS, F.posexplode("_b.facets").alias("group_seq", "_g")
    )
    values = groups.select(
        *_KEYS, "group_seq",
        F.coalesce("_g.facetParameter", "_g.id").alias("facet_parameter"),
        F.posexplode("_g.values").alias("value_seq", "_v"),
    )
    return values.select(
        *_KEYS, "group_seq", "facet_parameter", "value_seq",
        F.coalesce("_v.descriptor", "_v.label").alias("label"),
        F.col("_v.id").alias("id"), F.col("_v.count").alias("count"),
    )


def w_page_rows(captures: DataFrame) -> DataFrame:
    """Counts, entries and facets of listing pages, each page parsed once."""
    items, facets = F.col("_b.jobPostings"), F.col("_b.facets")

    def listed(job: Column, at: Column) -> Column:
        return F.when(F.length(job["externalPath"]) > 0, entry(
            "listed", key=canonicalize_url(job["externalPath"], F.col("source_url")), position=at, title=job["title"],
            external_id=F.try_element_at(job["bulletFields"], F.lit(1)),
        ))

    def offered(group: Column, at: Column) -> Column:
        return F.transform(group["values"], lambda value, place: entry(
            "facet", position=at, part=place, key=F.coalesce(group["facetParameter"], group["id"]),
            title=F.coalesce(value["descriptor"], value["label"]), external_id=value["id"],
        ))

    parsed = _w_parsed(captures)
    total = F.coalesce(F.col("_b.total"), F.size(items))
    page = _page_entry(items, total, F.transform(items, lambda i: i["externalPath"]))
    values = F.flatten(F.array_compact(F.transform(facets, offered)))
    return scan_rows.unfolded(parsed, _entries(page, F.transform(items, listed), values))


def _w_fields(captures: DataFrame) -> DataFrame:
    info = F.col("_b.jobPostingInfo")
    parsed = captures.withColumn("_b", F.from_json("body", _W_DETAIL)).withColumn(
        "_valid", F.try_parse_json("body").isNotNull()
    )
    first = F.array_compact(F.array(blank_to_null(info["location"])))
    more = F.coalesce(info["additionalLocations"], F.array().cast("array<string>"))
    code = F.when(~F.col("_valid"), "malformed_response").when(
        F.coalesce(F.length(info["title"]), F.lit(0)) == 0, "missing_job_detail"
    )
    kept = [c for c in captures.columns if c not in ("url", "body")]
    return parsed.select(
        *kept, F.col("url").alias("capture_url"),
        blank_to_null(info["jobReqId"]).alias("external_id"),
        blank_to_null(info["externalUrl"]).alias("url"),
        info["title"].alias("title"),
        F.concat(first, more).alias("locations"),
        info["timeType"].alias("employment_type"),
        F.coalesce(blank_to_null(info["startDate"]), info["postedOn"]).alias("posted"),
        info["jobDescription"].alias("description_html"),
        F.create_map(
            F.lit("source"), F.lit("workday_cxs"), F.lit("identifier"), info["jobReqId"]
        ).alias("metadata"),
        code.alias("error_code"),
    )


def w_detail(captures: DataFrame, listing: DataFrame) -> DataFrame:
    """Raw postings from detail pages joined to their listing entry; ``error_code`` marks pages
    that are not JSON or lack a title."""
    known = listing.select(
        "scan_run_id", F.col("url").alias("capture_url"), F.col("external_id").alias("_id"),
    )
    joined = _w_fields(captures).join(known, ["scan_run_id", "capture_url"], "left")
    return joined.select(
        *_KEYS, F.coalesce("external_id", "_id").alias("external_id"),
        F.coalesce("url", "capture_url").alias("url"), "title", "locations", "employment_type",
        parse_iso_date(F.col("posted")).alias("posted_date"), "description_html", "metadata", "error_code",
    )


def w_detail_rows(captures: DataFrame) -> DataFrame:
    return _detail_rows(_w_fields(captures), F.col("capture_url"))


# --- ATS-I ------------------------------------------------------------------------------


def _i_total(parsed_total: Column, count: Column) -> Column:
    return F.coalesce(
        F.when(parsed_total != 0, parsed_total), F.when(count != 0, count)
    )


def i_pages(captures: DataFrame) -> DataFrame:
    parsed = captures.withColumn("_b", F.from_json("body", _I_PAGE))
    items = F.col("_b.jobs")
    ids = F.transform(
        items, lambda i: F.coalesce(blank_to_null(i["data"]["req_id"]), i["data"]["id"])
    )
    total = F.coalesce(_i_total(F.col("_b.totalCount"), F.col("_b.count")), F.size(items))
    return _page_counts(parsed, items, total, ids)


def i_facets(captures: DataFrame) -> DataFrame:
    parsed = captures.select(*_KEYS, F.from_json("body", _I_PAGE).alias("_b"))
    groups = parsed.select(*_KEYS, F.explode("_b.filter").alias("facet_parameter", "_values"))
    return groups.select(
        *_KEYS, "facet_parameter", F.posexplode("_values").alias("value_seq", "_v")
    ).select(
        *_KEYS, "facet_parameter", "value_seq", F.col("_v.name").alias("label"),
        F.col("_v.count").alias("count"),
    )


def i_jobs(captures: DataFrame) -> DataFrame:
    """Raw postings of API pages: entries with an id and a URL on the source host."""
    listed = captures.select(
        *_KEYS, "source_url", F.from_json("body", _I_PAGE)["jobs"].alias("_jobs")
    ).select(*_KEYS, "source_url", F.posexplode("_jobs").alias("position", "_j"))
    d = F.col("_j.data")
    external = F.coalesce(blank_to_null(d["req_id"]), blank_to_null(d["id"]))
    target = blank_to_null(d["meta_data"]["canonical_url"])
    placed = listed.withColumns(
        {
            "external_id": external,
            "url": canonicalize_url(target, F.col("source_url")),
        }
    ).where(
        F.col("external_id").isNotNull() & (url_host(F.col("url")) == url_host(F.col("source_url")))
    )
    return placed.select(
        *_KEYS, "position", "external_id", "url",
        F.coalesce(blank_to_null(d["title"]), F.lit("Untitled role")).alias("title"),
        F.array_compact(F.array(blank_to_null(d["full_location"]))).alias("locations"),
        d["employment_type"].alias("employment_type"),
        parse_iso_date(d["posted_date"]).alias("posted_date"),
        paragraph_html(d["description"]).alias("description_html"),
        F.create_map(
            F.lit("source"), F.lit("icims_jibe"), F.lit("identifier"), F.col("external_id"),
            F.lit("department"), d["category"], F.lit("date_modified"), d["update_date"],
        ).alias("metadata"),
    )


def i_page_rows(captures: DataFrame) -> DataFrame:
    """Counts and postings of API pages, each page parsed once; a posting is listed and its own detail."""
    items = F.col("_b.jobs")

    def found(job: Column) -> Column:
        d = job["data"]
        external = F.coalesce(blank_to_null(d["req_id"]), blank_to_null(d["id"]))
        url = canonicalize_url(blank_to_null(d["meta_data"]["canonical_url"]), F.col("source_url"))
        return F.struct(d.alias("d"), external.alias("external_id"), url.alias("url"))

    def rows(job: Column, at: Column) -> Column:
        d, external, url = job["d"], job["external_id"], job["url"]
        metadata = F.create_map(
            F.lit("source"), F.lit("icims_jibe"), F.lit("identifier"), external,
            F.lit("department"), d["category"], F.lit("date_modified"), d["update_date"],
        )
        own = external.isNotNull() & (url_host(url) == url_host(F.col("source_url")))
        return F.when(own, F.array(
            entry("listed", key=url, position=at, external_id=external),
            entry(
                "detail", key=url, url=url, position=at, external_id=external,
                title=F.coalesce(blank_to_null(d["title"]), F.lit("Untitled role")),
                locations=F.array_compact(F.array(blank_to_null(d["full_location"]))),
                employment_type=d["employment_type"], posted=d["posted_date"],
                description_html=paragraph_html(d["description"]), metadata=metadata,
            ),
        ))

    parsed = captures.withColumn("_b", F.from_json("body", _I_PAGE))
    ids = F.transform(items, lambda i: F.coalesce(blank_to_null(i["data"]["req_id"]), i["data"]["id"]))
    total = F.coalesce(_i_total(F.col("_b.totalCount"), F.col("_b.count")), F.size(items))
    jobs = F.flatten(F.array_compact(F.transform(F.transform(items, found), rows)))
    return scan_rows.unfolded(parsed, _entries(_page_entry(items, total, ids), jobs))


# --- ATS-O ------------------------------------------------------------------------------


def _o_parsed(captures: DataFrame) -> DataFrame:
    # Ids and titles come in two spellings that differ only in case, so a variant, not a struct.
    box = F.try_variant_get(F.try_parse_json("body"), "$.items[0]", "variant")
    return captures.withColumns(
        {
            "_total": F.try_variant_get(box, "$.TotalJobsCount", "int"),
            "_jobs": F.try_variant_get(box, "$.requisitionList", "array<variant>"),
        }
    )


def _o_text(job: Column, *names: str) -> Column:
    return F.coalesce(
        *[blank_to_null(F.try_variant_get(job, f"$.{n}", "string")) for n in names]
    )


def o_pages(captures: DataFrame) -> DataFrame:
    items, advertised = F.col("_jobs"), F.col("_total")
    total = F.coalesce(F.when(advertised != 0, advertised), F.size(items))
    ids = F.transform(items, lambda j: _o_text(j, "Id", "id"))
    return _page_counts(_o_parsed(captures), items, total, ids)


def o_listing(captures: DataFrame) -> DataFrame:
    """Entries of listing pages that carry an id and a title."""
    listed = _o_parsed(captures).select(
        *_KEYS, "source_url", F.posexplode("_jobs").alias("position", "_j")
    )
    job = F.col("_j")
    return listed.select(
        *_KEYS, "source_url", "position", _o_text(job, "Id", "id").alias("external_id"),
        _o_text(job, "Title", "title").alias("title"), _o_text(job, "PostedDate").alias("posted"),
        _o_text(job, "PrimaryLocation").alias("location"),
        _o_text(job, "JobSchedule").alias("employment_type"),
    ).where(F.col("external_id").isNotNull() & F.col("title").isNotNull()).withColumn(
        "url", o_detail_url(F.col("source_url"), F.col("external_id"))
    )


def o_page_rows(captures: DataFrame) -> DataFrame:
    """Counts and entries of listing pages, each page parsed once."""
    items, advertised = F.col("_jobs"), F.col("_total")

    def listed(job: Column, at: Column) -> Column:
        external, title = _o_text(job, "Id", "id"), _o_text(job, "Title", "title")
        return F.when(external.isNotNull() & title.isNotNull(), entry(
            "listed", key=external, position=at, external_id=external, title=title,
            url=o_detail_url(F.col("source_url"), external), place=blank_to_null(_o_text(job, "PrimaryLocation")),
            employment_type=_o_text(job, "JobSchedule"), posted=_o_text(job, "PostedDate"),
        ))

    total = F.coalesce(F.when(advertised != 0, advertised), F.size(items))
    page = _page_entry(items, total, F.transform(items, lambda j: _o_text(j, "Id", "id")))
    return scan_rows.unfolded(_o_parsed(captures), _entries(page, F.transform(items, listed)))


def _o_fields(captures: DataFrame) -> DataFrame:
    body = F.try_variant_get(F.try_parse_json("body"), "$.items[0]", "variant")
    kept = [c for c in captures.columns if c not in ("url", "body", "external_id")]
    parsed = captures.select(*kept, F.col("external_id").alias("key"), body.alias("_d"))
    d = F.col("_d")

    def text(name: str) -> Column:
        return blank_to_null(F.try_variant_get(d, f"$.{name}", "string"))

    def listed(name: str) -> Column:
        value = F.try_variant_get(d, f"$.{name}", "variant")
        wrapped = F.try_variant_get(value, "$.items", "array<variant>")
        return F.coalesce(wrapped, as_variants(value))

    def rendered(name: str) -> Column:
        return F.transform(listed(name), render_o_location)

    sections = sections_html(
        (
            (None, text("ExternalDescriptionStr")),
            ("Responsibilities", text("ExternalResponsibilitiesStr")),
            ("Qualifications", text("ExternalQualificationsStr")),
        )
    )
    return parsed.select(
        *kept, "key", F.coalesce(text("Id"), "key").alias("external_id"), text("Title").alias("title"),
        rendered("PrimaryLocation").alias("locations"),
        F.concat(rendered("secondaryLocations"), rendered("workLocation")).alias("more_locations"),
        text("JobSchedule").alias("employment_type"), text("ExternalPostedStartDate").alias("posted"),
        sections.alias("description_html"),
        F.create_map(
            F.lit("source"), F.lit("oracle_ce"), F.lit("identifier"), F.col("key"),
            F.lit("department"), text("JobFamily"),
        ).alias("metadata"),
        F.when(d.isNull(), "malformed_detail").alias("error_code"),
    )


def o_detail_rows(captures: DataFrame) -> DataFrame:
    """Details by requisition id (``captures.external_id``)."""
    return _detail_rows(_o_fields(captures), F.col("key"))


def o_detail(captures: DataFrame, listing: DataFrame) -> DataFrame:
    """Raw postings from detail answers joined to their listing entry by requisition id
    (``captures.external_id``)."""
    known = listing.select(
        "scan_run_id", F.col("external_id").alias("key"), F.col("url").alias("_url"), F.col("title").alias("_title"),
        F.col("posted").alias("_posted"), blank_to_null(F.col("location")).alias("_location"),
        F.col("employment_type").alias("_type"),
    )
    joined = _o_fields(captures).join(known, ["scan_run_id", "key"], "left")
    return joined.select(
        *_KEYS, "external_id", F.col("_url").alias("url"),
        F.coalesce("title", "_title", F.lit("Untitled role")).alias("title"),
        F.array_compact(F.concat("locations", F.array("_location"), "more_locations")).alias("locations"),
        F.coalesce("employment_type", "_type").alias("employment_type"),
        parse_iso_date(F.coalesce("posted", "_posted")).alias("posted_date"),
        "description_html", "metadata", "error_code",
    )
