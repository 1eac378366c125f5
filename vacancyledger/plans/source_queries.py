"""Queries over captures: extraction per platform, access, coverage, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.locations import escape_html
from ..functions.text import slug
from ..operators import access, coverage, matching, normalize, profiles, quality
from ..sources import ats_json, extractors, html_fields, html_pages, jsonld
from . import derived
from .derived import sql, table


def doc_id(col: str = "doc_id"):
    return F.col(col).cast("string")


# --- extraction round trips: documents rendered as a platform's payload, then read back ---


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", "lang", "source",
        F.concat(F.lit("Rôle "), doc_id()).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("day"),
        F.concat(F.lit("scan-"), "source").alias("scan_run_id"),
        F.col("source").alias("source_id"),
    )


def _result(raw):
    """What every round trip shows of the extracted postings."""
    return raw.select(
        "source_id", "external_id", "url", "title", F.array_join("locations", "|").alias("locations"),
        "employment_type", F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"),
        F.md5("description_html").alias("html_md5"),
    )


def _result_sql(url: str, locations: str, employment: str, html: str, where: str = "", **other: str) -> str:
    title = other.get("title", "'Rôle ' || doc_id")
    external = other.get("external_id", "CAST(doc_id AS VARCHAR)")
    return f"""SELECT source AS source_id, {external} AS external_id, {url} AS url, {title} AS title, {locations} AS locations,
    {employment} AS employment_type, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS posted_date,
    md5({html}) AS html_md5 FROM documents {where}"""


def _escape_sql(x: str) -> str:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{ref}')"
    return x


def _captures(df, kind: str, url, body, source_url=None):
    return df.select(
        "source_id", "scan_run_id", F.col("doc_id").alias("seq"), F.lit(kind).alias("kind"),
        url.alias("url"), body.alias("body"),
        (source_url if source_url is not None else F.lit(None).cast("string")).alias("source_url"),
    )


def jsonld_roundtrip(spark, sf_dir):
    """Plain, listed, wrapped and broken JobPosting blocks; every seventh page has none."""
    d = _documents(spark, sf_dir)
    posting = F.struct(
        F.when(F.col("doc_id") % 2 == 0, F.lit("JobPosting")).otherwise("JobPosting").alias("@type"),
        F.struct(doc_id().alias("value")).alias("identifier"),
        "title", F.date_format("day", "yyyy-MM-dd'T'00:00:00").alias("datePosted"),
        F.col("text").alias("description"),
        F.array(F.lit("FULL_TIME"), F.upper("lang")).alias("employmentType"),
        F.array(
            F.struct(F.struct(
                F.col("source").alias("addressLocality"),
                F.struct(F.upper("lang").alias("name")).alias("addressCountry"),
            ).alias("address"))
        ).alias("jobLocation"),
    )
    one = F.to_json(posting)
    graph = F.concat(F.lit('{"@graph":[{"@type":"Organization","name":"x"},'), one, F.lit("]}"))
    listed = F.concat(F.lit("["), one, F.lit("]"))
    k = F.col("doc_id") % 7
    block = F.when(k == 1, graph).when(k == 2, listed).when(k == 3, F.concat(one, F.lit(","))).otherwise(one)
    tag = F.concat(F.lit('<script type="application/ld+json">'), F.replace(block, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    body = F.concat(
        F.lit("<html><script>var x = 1;</script>"), F.when(k != 4, tag).otherwise(""), F.lit("</html>")
    )
    site = F.concat(F.lit("https://careers.example.com/en/jobs/"), doc_id())
    found = jsonld.extract_jobposting(_captures(d, "detail", site, body))
    errors = found.where(F.col("error_code").isNotNull()).select(
        "source_id", F.col("seq").cast("string").alias("external_id"), F.col("url"),
        F.col("error_code").alias("title"),
        *[F.lit(None).cast("string").alias(c) for c in ("locations", "employment_type", "posted_date", "html_md5")],
    )
    fields = jsonld.posting_fields(found, "phenom").withColumn("url", F.col("capture_url"))
    return _result(fields).unionByName(errors)


_SITE = "'https://careers.example.com/en/jobs/' || doc_id"
JSONLD_SQL = (
    _result_sql(_SITE, "source || ', ' || upper(lang)", "'FULL_TIME, ' || upper(lang)", "text", "WHERE doc_id % 7 NOT IN (3, 4)")
    + f""" UNION ALL SELECT source, CAST(doc_id AS VARCHAR), {_SITE},
    CASE doc_id % 7 WHEN 3 THEN 'malformed_jsonld' ELSE 'missing_jsonld' END, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 7 IN (3, 4)"""
)


def embedded_roundtrip(spark, sf_dir):
    """Listing pages with links and a script object, one entry per document, read by the site's
    rules and completed from their detail pages."""
    d = _documents(spark, sf_dir)
    entry = F.to_json(F.struct(
        F.concat(F.lit("SEQ"), doc_id()).alias("jobSeqNo"), doc_id().alias("reqId"), "title"
    ))
    blank = F.lit(',{"reqId":"0","title":""}')
    script = F.concat(
        F.lit('<script>phApp.ddo = {"eagerLoadRefineSearch":{"hits":1,"totalHits":1,"data":{"jobs":['),
        entry, blank, F.lit("]}}}; phApp.next = {};</script>"),
    )
    anchor = F.concat(
        F.lit('<a href="/us/en/job/A'), doc_id(), F.lit('?utm_source=x">Link &amp; <b>'), "title",
        F.lit('</b></a><a href="https://evil.example/us/en/job/9/x">bad</a>'),
    )
    odd = F.col("doc_id") % 2 == 1
    home = F.lit("https://jobs.example.com/us/en/search-results")
    listing = _captures(d, "listing", home, F.when(odd, anchor).otherwise(script), home)
    path = F.when(odd, F.concat(F.lit("/us/en/job/A"), doc_id())).otherwise(
        F.concat(F.lit("/us/en/job/SEQ"), doc_id(), F.lit("/"), slug(F.col("title")))
    )
    posting = F.struct(
        F.lit("JobPosting").alias("@type"), F.date_format("day", "yyyy-MM-dd").alias("datePosted"),
        escape_html(F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("description"),
        F.when(odd, F.lit("https://other.example/x")).otherwise(
            F.concat(F.lit("https://jobs.example.com"), path, F.lit("?src=1#a"))
        ).alias("url"),
        F.lit("CONTRACT").alias("employmentType"),
        F.struct(F.concat("source", F.lit(" town")).alias("address")).alias("jobLocation"),
    )
    body = F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(posting), F.lit("</script>"))
    detail = _captures(d, "detail", F.concat(F.lit("https://jobs.example.com"), path), body, home)
    rules = extractors.SITE_RULES["phenom_kwiktrip"]
    return _result(extractors.html_jsonld(listing.unionByName(detail), rules))


EMBEDDED_SQL = _result_sql(
    "'https://jobs.example.com/us/en/job/' || CASE WHEN doc_id % 2 = 1 THEN 'A' || doc_id ELSE 'SEQ' || doc_id || '/Role-' || doc_id END",
    "source || ' town'", "'CONTRACT'", "'<p>' || text || '</p>'",
    title="CASE WHEN doc_id % 2 = 1 THEN 'Link & Rôle ' || doc_id ELSE 'Rôle ' || doc_id END",
    external_id="CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END",
)


def ats_w_roundtrip(spark, sf_dir):
    d = _documents(spark, sf_dir)
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("/job/"), "lang", F.lit("/R"), doc_id())
    home = F.lit("https://acme.wd1.myworkdayjobs.com/Careers")
    listing_body = F.to_json(F.struct(
        F.lit(2).alias("total"),
        F.array(
            F.struct("title", path.alias("externalPath"), F.array(doc_id()).alias("bulletFields")),
            F.struct(F.lit("no path").alias("title"), F.lit(None).cast("string").alias("externalPath"),
                     F.array(F.lit("x")).alias("bulletFields")),
        ).alias("jobPostings"),
    ))
    info = F.struct(
        F.when(k != 1, doc_id()).alias("jobReqId"),
        F.when(k != 3, F.col("title")).alias("title"),
        F.col("source").alias("location"), F.array(F.col("lang")).alias("additionalLocations"),
        F.lit("Full time").alias("timeType"),
        F.when(k != 2, F.date_format("day", "yyyy-MM-dd")).alias("startDate"),
        F.date_format("day", "yyyy-MM-dd'T'12:00:00'Z'").alias("postedOn"),
        F.col("text").alias("jobDescription"),
    )
    listing = _captures(d, "listing", home, listing_body, home)
    url = F.concat(F.lit("https://acme.wd1.myworkdayjobs.com"), path)
    detail = _captures(d, "detail", url, F.to_json(F.struct(info.alias("jobPostingInfo"))), home)
    return _result(extractors.ats_w(listing.unionByName(detail)))


ATS_W_SQL = _result_sql(
    "'https://acme.wd1.myworkdayjobs.com/job/' || lang || '/R' || doc_id", "source || '|' || lang",
    "'Full time'", "text", "WHERE doc_id % 4 <> 3",
)


def ats_i_roundtrip(spark, sf_dir):
    d = _documents(spark, sf_dir)
    k = F.col("doc_id") % 4
    target = (
        F.when(k == 0, F.concat(F.lit("/careers-home/jobs/"), doc_id()))
        .when(k == 1, F.concat(F.lit("https://careers.example.com/careers-home/jobs/"), doc_id(), F.lit("?utm_source=t")))
        .when(k == 2, F.concat(F.lit("https://evil.example/jobs/"), doc_id()))
        .otherwise("jobs/x")
    )
    data = F.struct(
        F.when(k == 1, "").when(k == 3, F.lit(None)).otherwise(doc_id()).alias("req_id"),
        F.when(k == 1, F.concat(F.lit("i"), doc_id())).alias("id"),
        "title", F.when(k == 1, F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>"))).otherwise(F.concat("text", F.lit(" & more"))).alias("description"),
        F.col("source").alias("full_location"), F.lit("Full-time").alias("employment_type"),
        F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("posted_date"),
        F.lit("Software").alias("category"), F.struct(target.alias("canonical_url")).alias("meta_data"),
    )
    body = F.to_json(F.struct(
        F.lit(1).alias("count"), F.array(F.struct(data.alias("data"))).alias("jobs")
    ))
    home = F.lit("https://careers.example.com/careers-home/jobs")
    return _result(extractors.ats_i(_captures(d, "listing", home, body, home)))


ATS_I_SQL = _result_sql(
    "'https://careers.example.com/careers-home/jobs/' || doc_id", "source", "'Full-time'",
    f"CASE WHEN doc_id % 4 = 1 THEN '<p>' || {_escape_sql('text')} || '</p>' WHEN regexp_matches(text, '<\\s*[a-zA-Z][^>]*>') THEN text || ' & more'"
    f" ELSE '<p>' || {_escape_sql('text')} || ' &amp; more</p>' END",
    "WHERE doc_id % 4 IN (0, 1)",
    external_id="CASE doc_id % 4 WHEN 1 THEN 'i' || doc_id ELSE CAST(doc_id AS VARCHAR) END",
)


def ats_o_roundtrip(spark, sf_dir):
    d = _documents(spark, sf_dir)
    k = F.col("doc_id") % 3
    home = F.lit("https://careers.example.com/en/sites/CX_1/jobs")
    box = F.struct(
        F.lit(1).alias("TotalJobsCount"),
        F.array(F.struct(
            doc_id().alias("Id"), F.col("title").alias("Title"),
            F.date_format("day", "yyyy-MM-dd").alias("PostedDate"),
            F.concat("source", F.lit(" list")).alias("PrimaryLocation"),
            F.lit("Part time").alias("JobSchedule"),
        )).alias("requisitionList"),
    )
    listing = _captures(d, "listing", home, F.to_json(F.struct(F.array(box).alias("items"))), home)
    item = F.struct(
        doc_id().alias("Id"),
        F.when(k == 0, F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'")).alias("ExternalPostedStartDate"),
        F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>")).alias("ExternalDescriptionStr"),
        F.lit("Lead <3 teams").alias("ExternalResponsibilitiesStr"),
        F.lit(" ").alias("ExternalQualificationsStr"),
        F.when(k == 1, "Full time").alias("JobSchedule"),
        F.col("source").alias("PrimaryLocation"),
        F.array(F.struct(F.lit("Phoenix").alias("LocationName"))).alias("secondaryLocations"),
        F.struct(
            F.col("lang").alias("TownOrCity"), F.lit("Georgia").alias("Region2"),
            F.struct(F.lit("Georgia").alias("State"), F.lit("US").alias("Country")).alias("Address"),
        ).alias("workLocation"),
    )
    url = F.concat(F.lit("https://t.fa.oraclecloud.com/hcmRestApi/x?finder=ById;Id="), doc_id(), F.lit(",siteNumber=CX_1"))
    detail = _captures(d, "detail", url, F.to_json(F.struct(F.array(item).alias("items"))), home)
    return _result(extractors.ats_o(listing.unionByName(detail)))


ATS_O_SQL = _result_sql(
    "'https://careers.example.com/en/sites/CX_1/job/' || doc_id",
    "source || '|' || source || ' list|Phoenix|' || lang || ', Georgia, US'",
    "CASE doc_id % 3 WHEN 1 THEN 'Full time' ELSE 'Part time' END",
    "'<p>' || " + _escape_sql("text") + " || '</p><h2>Responsibilities</h2><p>Lead &lt;3 teams</p>'",
)


def ats_html_roundtrip(spark, sf_dir):
    """Detail pages of both HTML-only platforms; odd documents take location and type from
    their listing entry, every ninth page has no title."""
    d = _documents(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    text = escape_html(F.col("text"))
    head = F.when(F.col("doc_id") % 9 == 4, "").otherwise(F.concat(F.lit("<h1> "), "title", F.lit("<br></h1>")))
    place = F.when(
        even, F.concat(F.lit("<div class='x location'>"), "source", F.lit("</div><p class='job-type'>Full &amp; <i>fixed</i></p>"))
    ).otherwise("")
    body = F.concat(
        F.lit("<html><body><main>"), head, place, F.lit('<time datetime="'),
        F.date_format("day", "yyyy-MM-dd"), F.lit('">then</time><section id="JobDescription">'), text,
        F.lit("</section></main></body></html>"),
    )
    url = F.concat(F.lit("https://recruit.hirebridge.com/v3/Jobs/Details.aspx?cid=7&jid="), doc_id())
    details = html_fields.ats_h_detail(_captures(d, "detail", url, body))
    listing = d.select(
        "scan_run_id", url.alias("url"), doc_id().alias("external_id"),
        F.concat("source", F.lit(" list")).alias("location"), F.lit("Part time").alias("employment_type"),
    )
    return _result(html_fields.with_listing(details, listing))


ATS_HTML_SQL = _result_sql(
    "'https://recruit.hirebridge.com/v3/Jobs/Details.aspx?cid=7&jid=' || doc_id",
    "CASE doc_id % 2 WHEN 0 THEN source ELSE source || ' list' END",
    "CASE doc_id % 2 WHEN 0 THEN 'Full & fixed' ELSE 'Part time' END",
    "'<section id=\"JobDescription\">' || " + _escape_sql("text") + " || '</section>'",
    "WHERE doc_id % 9 <> 4",
)


def ats_a_roundtrip(spark, sf_dir):
    d = _documents(spark, sf_dir)
    home = F.lit("https://acme.avature.net/careers/SearchJobs")
    path = F.concat(F.lit("/careers/JobDetail/"), "lang", F.lit("-x/"), doc_id())
    listing_body = F.concat(
        F.lit("<article><a href='"), path, F.lit("?utm_source=x'>E</a></article><a rel=next href='/careers/SearchJobs?page=2'>n</a>")
    )
    detail_body = F.concat(
        F.lit("<main><div class=job-title>"), "title", F.lit("</div><p>intro</p><span class='a my-location'>"), "source",
        F.lit("</span><div data-field='location'>"), "lang", F.lit("</div><time datetime='"),
        F.date_format("day", "yyyy-MM-dd"), F.lit("'></time><div data-field='description'>"), escape_html(F.col("text")), F.lit("</div></main>"),
    )
    url = F.concat(F.lit("https://acme.avature.net"), path)
    listing = _captures(d, "listing", home, listing_body, home)
    return _result(extractors.ats_a(listing.unionByName(_captures(d, "detail", url, detail_body, home))))


ATS_A_SQL = _result_sql(
    "'https://acme.avature.net/careers/JobDetail/' || lang || '-x/' || doc_id", "source || '|' || lang",
    "CAST(NULL AS VARCHAR)", "'<div data-field=''description''>' || " + _escape_sql("text") + " || '</div>'",
)


def repeated_listing_pages(spark, sf_dir):
    """Listing captures, one per document, whose entries repeat those of an earlier page."""
    d = _documents(spark, sf_dir)
    entry = F.struct(F.concat(F.lit("/job/"), "lang", (F.col("doc_id") % 9).cast("string")).alias("externalPath"))
    body = F.when(
        F.col("doc_id") % 6 == 0, F.lit('{"jobPostings":[],"total":3}')
    ).otherwise(F.to_json(F.struct(F.array(entry, entry).alias("jobPostings"))))
    pages = ats_json.w_pages(_captures(d, "listing", F.lit("https://x"), body))
    return coverage.repeated_pages(pages.withColumn("page", F.col("seq")), ["signature"])


REPEATED_SQL = """WITH p AS (SELECT 'scan-' || source AS scan_run_id, doc_id AS page, lang || (doc_id % 9) AS sig FROM documents WHERE doc_id % 6 <> 0),
    f AS (SELECT *, min(page) OVER (PARTITION BY scan_run_id, sig) AS first_page FROM p)
    SELECT scan_run_id, page, first_page, 2 AS items FROM f WHERE page > first_page"""


def generated_next_pages(spark, sf_dir):
    """Next pages by arithmetic: pages that state their total (here the length of the page, the offset
    the number in its URL), and pages that are full (here of links)."""
    p = table(spark, sf_dir, "pages")
    number = F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/([0-9]+)", 1)
    root = F.concat(F.lit("https://h.example/us/en?s=0&x=%20&utm_term=a"))
    counted = p.select(
        F.lit("s").alias("source_id"), F.col("page_id").cast("string").alias("scan_run_id"),
        F.when(number == "0", root).otherwise(F.concat(root, F.lit("&from="), number)).alias("page_url"),
        F.lit(10).alias("page_size"), (F.length("html") % 1000).cast("int").alias("total"),
    )
    full = p.select(
        F.lit("s").alias("source_id"), F.col("page_id").cast("string").alias("scan_run_id"),
        F.concat(F.lit("https://e.example/careers?start="), F.when(F.col("page_id") % 9 == 4, "x").otherwise(number)).alias("page_url"),
        F.regexp_count("html", F.lit('<a href="')).alias("items"),
    )
    nexts = html_pages.counted_next_pages(counted, "from", {"s": "1"}).unionByName(
        html_pages.full_next_pages(full, 6)
    )
    return nexts.select("scan_run_id", "next_url")


NEXT_SQL = """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS scan_run_id, page_id % 9 = 4 AS odd, CAST(regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS INTEGER) AS n,
      length(html) % 1000 AS total, len(regexp_extract_all(html, '<a href="')) AS items FROM pages)
    SELECT scan_run_id, 'https://h.example/us/en?from=' || (n + 10) || '&s=1&x=+' AS next_url FROM p WHERE n + 10 < total
    UNION ALL SELECT scan_run_id, 'https://e.example/careers?start=' || (n + 6) FROM p WHERE items >= 6 AND NOT odd"""


def _scan_result(spark, sf_dir):
    """A scan per source: listing pages of up to a thousand documents and their job pages. Some job
    pages were refused, not read or hold no posting; some listing pages lead back to themselves or off the
    host; the first listing page of one source was refused."""
    d = _documents(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / 1000))
    root, n = "https://jobs.veralto.com/global/en/", F.col("block").cast("string")
    posting = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"), F.struct(doc_id().alias("value")).alias("identifier"), "title",
            F.col("text").alias("description"),
        )
    )
    script = F.concat(F.lit('<script type="application/ld+json">'), F.replace(posting, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    details = d.where(F.col("doc_id") % 19 != 4).select(
        "source_id", "scan_run_id", F.col("doc_id").alias("seq"), F.lit("detail").alias("kind"),
        F.concat(F.lit(root + "job/"), doc_id()).alias("url"),
        F.when(F.col("doc_id") % 11 == 3, 403).when(F.col("doc_id") % 13 == 7, 503).otherwise(200).alias("status"),
        F.when(F.col("doc_id") % 17 == 2, "<p>gone</p>").otherwise(script).alias("body"),
    )
    link = F.concat(F.lit('<a href="/global/en/job/'), doc_id(), F.lit('">x</a>'))
    pages = d.groupBy("source_id", "scan_run_id", "block").agg(F.array_join(F.collect_list(link), "").alias("links"))
    loop = F.when(F.col("block") % 3 == 1, F.concat(F.lit('<a class="paginationItem" href="list?p='), n, F.lit('">n</a>'))).otherwise("")
    off = F.when(F.col("block") % 4 == 2, '<a href="https://evil.example/global/en/job/1">x</a>').otherwise("")
    listing = pages.select(
        "source_id", "scan_run_id", F.col("block").alias("seq"), F.lit("listing").alias("kind"),
        F.concat(F.lit(root + "list?p="), n).alias("url"),
        F.when((F.col("source_id") == "src5") & (F.col("block") == 0), 403).otherwise(200).alias("status"),
        F.concat("links", loop, off).alias("body"),
    )
    sources = d.select("source_id").distinct().select(
        "source_id", F.lit(root).alias("url"), F.lit("paginated_html_jsonld").alias("connector_type"),
        F.lit("phenom").alias("platform"),
    )
    return extractors.extract_scans(listing.unionByName(details), sources)


def extract_outcomes(spark, sf_dir):
    """What became of every listed posting: the posting's text, or why there is none."""
    found = _scan_result(spark, sf_dir)
    posting = found.postings.select(
        "scan_run_id", F.concat(F.lit("https://jobs.veralto.com/global/en/job/"), "external_id").alias("key"),
        "title", F.md5("description_html").alias("html_md5"),
    )
    return found.details.join(posting, ["scan_run_id", "key"], "left")


def scan_result(spark, sf_dir):
    return _scan_result(spark, sf_dir).scans


_SCAN_CTES = """WITH d AS (SELECT doc_id, source, doc_id // 1000 AS block, text, CASE WHEN doc_id % 19 = 4 THEN 'detail_not_captured' WHEN doc_id % 11 = 3 THEN 'access_blocked'
      WHEN doc_id % 13 = 7 THEN 'transient_http_failure' WHEN contains(lower(text), 'captcha') OR contains(lower(text), 'verify you are human') THEN 'access_blocked'
      WHEN doc_id % 17 = 2 THEN 'missing_jsonld' END AS error_code FROM documents),
    l AS (SELECT * FROM d WHERE NOT (source = 'src5' AND block = 0))"""
OUTCOMES_SQL = f"""{_SCAN_CTES} SELECT 'scan-' || source AS scan_run_id, 'https://jobs.veralto.com/global/en/job/' || doc_id AS key, error_code,
    CASE WHEN error_code IS NULL THEN 'Rôle ' || doc_id END AS title, CASE WHEN error_code IS NULL THEN md5(text) END AS html_md5 FROM l"""
SCAN_SQL = f"""{_SCAN_CTES}, p AS (SELECT source, count(DISTINCT block) FILTER (WHERE NOT (source = 'src5' AND block = 0)) AS pages, bool_or(source = 'src5' AND block = 0) AS refused,
      count(DISTINCT block) FILTER (WHERE block % 3 = 1) AS loops, count(DISTINCT block) FILTER (WHERE block % 4 = 2) AS off FROM d GROUP BY 1),
    c AS (SELECT p.*, count(l.doc_id) AS listed, count(l.doc_id) FILTER (WHERE l.error_code IS NULL) AS usable FROM p LEFT JOIN l ON l.source = p.source GROUP BY ALL),
    e AS (SELECT *, CASE WHEN refused THEN 'access_blocked' WHEN listed = 0 THEN 'zero_results' WHEN usable = 0 THEN 'detail_extraction_failure' END AS error_code FROM c),
    f AS (SELECT *, error_code IS NULL AND listed = usable AND loops = 0 AS complete, listed - usable + loops + off AS w FROM e)
    SELECT source AS source_id, 'scan-' || source AS scan_run_id, pages + listed AS pages_visited, listed, usable, complete, error_code,
    w + CASE WHEN error_code IS NULL AND NOT complete THEN 1 ELSE 0 END AS warnings,
    CASE WHEN error_code IS NOT NULL THEN 'failed' WHEN NOT complete THEN 'partial' WHEN w > 0 THEN 'success_with_warnings' ELSE 'success' END AS status FROM f"""


def _paging_captures(spark, sf_dir):
    """Captures and sources of scans whose listings are cut short or go in circles, on the platforms that page by number or link.

    Sources take turns: an API that lost every third result page (or none); one that gives its first page
    again, or whose saved facet got another id; linked pages that go on beyond the last captured one,
    with and without a page limit; a board whose pages all link to the next captured page, or beyond."""
    d = _documents(spark, sf_dir).withColumns({
        "turn": F.substring("source", 4, 9).cast("int") % 8, "block": F.floor(F.col("doc_id") / 100).cast("long"),
    })
    turn, block = F.col("turn"), F.col("block")
    api, avature = F.lit("https://careers.example.com/careers-home/jobs"), "https://acme.avature.net/careers/"
    work, board = F.lit("https://acme.wd1.myworkdayjobs.com/Careers"), "https://recruit.hirebridge.com/v3/Jobs/"
    data = F.struct(
        doc_id().alias("req_id"), "title", F.col("text").alias("description"),
        F.struct(F.concat(F.lit("/careers-home/jobs/"), doc_id()).alias("canonical_url")).alias("meta_data"),
    )
    entry = F.struct(F.concat(F.lit("/job/R"), doc_id()).alias("externalPath"), "title")
    a_link = F.concat(F.lit('<article><a href="/careers/JobDetail/x/'), doc_id(), F.lit('">j</a></article>'))
    h_link = F.concat(F.lit('<li><a href="D.aspx?cid=7&amp;jid='), doc_id(), F.lit('">j</a><b class="location">'), "lang", F.lit("</b></li>"))
    per = ["source_id", "scan_run_id", "turn", "block"]
    pages = d.groupBy(*per).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", data.alias("data")))).alias("jobs"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.sort_array(F.collect_list(F.struct("doc_id", F.when(turn % 4 == 2, a_link).otherwise(h_link).alias("link")))).alias("links"),
    )
    sizes = d.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"), F.min("block").alias("low"), F.max("block").alias("high"),
        F.countDistinct("block").alias("blocks"),
    )
    pages = pages.join(sizes, "source_id").where((turn != 4) | (block % 3 != 1))
    # The first result page once more, after the last.
    again = pages.where((turn == 1) & (block == F.col("low"))).withColumn("block", F.col("high") + 1)
    pages = pages.unionByName(again)
    facets = F.array(F.struct(
        F.lit("loc").alias("facetParameter"),
        F.array(F.struct(F.lit("Rome").alias("descriptor"), F.when(turn == 5, "new").otherwise("r").alias("id"))).alias("values"),
    ))
    links = F.array_join(F.transform("links", lambda x: x["link"]), "")
    number = F.col("block").cast("string")
    following = (block + 1).cast("string")
    goes_on = (turn == 7) | (block < F.col("high"))
    body = (
        F.when(turn % 4 == 0, F.to_json(F.struct(F.col("total").alias("totalCount"), "jobs")))
        .when(turn % 4 == 1, F.to_json(F.struct("total", F.col("entries").alias("jobPostings"), facets.alias("facets"))))
        .when(turn % 4 == 2, F.concat(
            links, F.lit('<a href="http://acme.avature.net/careers/JobDetail/x/1">plain</a><a rel="next" href="SearchJobs?page='),
            following, F.lit('">n</a>'),
        ))
        .otherwise(F.concat(
            links, F.lit('<a href="D.aspx?cid=9&amp;jid=1">other client</a>'),
            F.when(goes_on, F.concat(F.lit('<a rel="next" href="list.aspx?cid=7&amp;page='), following, F.lit('">n</a>'))).otherwise(""),
        ))
    )
    url = (
        F.when(turn % 4 == 0, api).when(turn % 4 == 1, work)
        .when(turn % 4 == 2, F.concat(F.lit(avature + "SearchJobs?page="), number))
        .otherwise(F.concat(F.lit(board + "list.aspx?cid=7&page="), number))
    )
    listing = pages.select(
        "source_id", "scan_run_id", F.col("block").alias("seq"), F.lit("listing").alias("kind"), url.alias("url"), body.alias("body"),
    )
    job = F.concat(F.lit("<h1>"), "title", F.lit('</h1><div id="job-description">'), escape_html(F.substring("text", 1, 200)), F.lit("</div>"))
    details = d.where((turn % 4 == 2) & (F.col("doc_id") % 5 != 0) | (turn % 4 == 3)).select(
        "source_id", "scan_run_id", F.col("doc_id").alias("seq"), F.lit("detail").alias("kind"),
        F.when(turn % 4 == 2, F.concat(F.lit(avature + "JobDetail/x/"), doc_id()))
        .otherwise(F.concat(F.lit(board + "D.aspx?cid=7&jid="), doc_id())).alias("url"),
        job.alias("body"),
    )
    kinds = ("icims_jibe", "workday", "avature", "hirebridge")
    connectors = ("icims_jibe_api", "workday_cxs", "avature_html", "hirebridge_html")
    homes = (api, work, F.lit(avature + "SearchJobs"), F.lit(board + "list.aspx?cid=7"))

    def by_turn(values):
        return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), turn % 4 + 1)

    saved = F.lit('[{"facet_parameter":"loc","label":"Rome","id":"r"}]')
    config = F.when(turn % 4 == 1, F.create_map(F.lit("selected_facets"), saved)).when(
        turn == 2, F.create_map(F.lit("max_pages"), F.col("blocks").cast("string"))
    )
    sources = d.select("source_id", "turn").distinct().join(sizes, "source_id").select(
        "source_id", by_turn(homes).alias("url"), by_turn(connectors).alias("connector_type"),
        by_turn(kinds).alias("platform"), config.alias("config"),
    )
    return listing.unionByName(details), sources


def scan_paging(spark, sf_dir):
    """What scans with cut or circular listings come to."""
    return extractors.extract_scans(*_paging_captures(spark, sf_dir)).scans


def source_validation(spark, sf_dir):
    """The same scans as trials of their sources."""
    rows = extractors.validate_sources(*_paging_captures(spark, sf_dir))
    return rows.select(
        "source_id", "valid", "setup_status", "code", "job_count", "listed", "warnings",
        F.array_join(F.transform("samples", lambda s: s["url"]), "|").alias("samples"),
        F.array_join(F.transform("facets", lambda f: F.concat_ws(":", f["parameter"], f["label"], f["id"])), "|").alias("facets"),
    )


PAGING_SQL = """WITH d AS (SELECT *, CAST(substr(source, 4) AS INTEGER) % 8 AS turn, doc_id // 100 AS block FROM documents),
    z AS (SELECT source, turn, count(*) AS total, max(block) AS high, count(DISTINCT block) AS blocks FROM d GROUP BY ALL),
    k AS (SELECT * FROM d WHERE turn <> 4 OR block % 3 <> 1),
    c AS (SELECT z.source, z.turn, z.total, z.blocks, count(*) AS listed, count(DISTINCT k.block) AS pages,
        count(DISTINCT k.block) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.source = k.source AND o.block = k.block + 1)
          AND (z.turn <> 3 OR k.block < z.high)) AS unread,
        CASE WHEN z.turn % 4 = 1 THEN 0 WHEN z.turn % 4 = 2 THEN count(*) FILTER (WHERE k.doc_id % 5 <> 0) ELSE count(*) END AS usable
      FROM k JOIN z ON z.source = k.source GROUP BY z.source, z.turn, z.total, z.blocks, z.high),
    e AS (SELECT *, pages + CASE WHEN turn = 1 THEN 1 ELSE 0 END AS read,
        CASE WHEN turn = 1 THEN 'pagination_loop' WHEN turn = 5 THEN 'facet_drift' WHEN usable = 0 THEN 'detail_extraction_failure' END AS error_code,
        CASE WHEN turn % 4 = 0 THEN CASE WHEN listed < total THEN 1 ELSE 0 END WHEN turn % 4 = 1 THEN 0
          WHEN turn = 2 THEN CASE WHEN unread > 0 THEN 1 ELSE 0 END ELSE unread END AS cut FROM c),
    f AS (SELECT *, error_code IS NULL AND listed = usable AND cut = 0 AS complete,
        cut + listed - usable + CASE WHEN turn % 4 IN (2, 3) THEN pages ELSE 0 END AS w FROM e)
    SELECT source AS source_id, 'scan-' || source AS scan_run_id, read + listed AS pages_visited, listed, usable, complete, error_code,
      w + CASE WHEN error_code IS NULL AND NOT complete THEN 1 ELSE 0 END AS warnings,
      CASE WHEN error_code IS NOT NULL THEN 'failed' WHEN NOT complete THEN 'partial' WHEN w > 0 THEN 'success_with_warnings' ELSE 'success' END AS status FROM f"""


VALIDATION_SQL = """WITH d AS (SELECT *, CAST(substr(source, 4) AS INTEGER) % 8 AS turn, doc_id // 100 AS block FROM documents),
    k AS (SELECT * FROM d WHERE turn <> 4 OR block % 3 <> 1),
    u AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'https://careers.example.com/careers-home/jobs/' || doc_id
        WHEN 1 THEN 'https://acme.wd1.myworkdayjobs.com/job/R' || doc_id WHEN 2 THEN 'https://acme.avature.net/careers/JobDetail/x/' || doc_id
        ELSE 'https://recruit.hirebridge.com/v3/Jobs/D.aspx?cid=7&jid=' || doc_id END AS url,
        CASE WHEN turn % 4 = 1 THEN '/job/R' || doc_id ELSE lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS place FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, place) AS n FROM u),
    t AS (SELECT source, count(*) AS total FROM d GROUP BY 1)
    SELECT r.source AS source_id, turn <> 5 AS valid, CASE turn WHEN 5 THEN 'setup_required' ELSE 'ready' END AS setup_status,
      CASE turn WHEN 5 THEN 'facet_drift' END AS code, CASE WHEN turn % 4 < 2 THEN total END AS job_count, count(*) AS listed,
      CASE WHEN turn % 4 > 1 THEN count(DISTINCT block) ELSE 0 END AS warnings,
      string_agg(url, '|' ORDER BY n) FILTER (WHERE n <= 5) AS samples,
      CASE turn WHEN 1 THEN 'loc:Rome:r' WHEN 5 THEN 'loc:Rome:new' END AS facets
    FROM r JOIN t ON t.source = r.source GROUP BY r.source, turn, total"""


def valid_items(spark, sf_dir):
    """Listing entries without an id or title or off the host, counted per source."""
    d = _documents(spark, sf_dir)
    items = d.select(
        "source_id", F.when(F.col("doc_id") % 5 != 0, doc_id()).alias("external_id"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, "https://evil.example/1").otherwise("https://JOBS.example/1").alias("url"),
        F.lit("https://jobs.example/").alias("source_url"),
    )
    good, rejects = normalize.valid_items(items, ["source_id"])
    kept = good.groupBy("source_id").agg(F.count(F.lit(1)).alias("items")).withColumn("reason", F.lit("kept"))
    return rejects.unionByName(kept)


VALID_SQL = """SELECT source AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_id' WHEN doc_id % 7 = 0 THEN 'missing_title'
    WHEN doc_id % 3 = 0 THEN 'off_host' ELSE 'kept' END AS reason, count(*) AS items FROM documents GROUP BY ALL"""


# --- access -----------------------------------------------------------------------------


def _page_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("k", F.col("page_id"))


def response_outcome(spark, sf_dir):
    statuses = (200, 200, 404, 429, 503, 403, 406, 200, 500)
    codes = F.array(*[F.lit(s) for s in statuses])
    p = _page_rows(spark, sf_dir)
    captures = p.select(
        "page_id",
        F.when(F.col("k") % 13 != 5, F.element_at(codes, (F.col("k") % 9 + 1).cast("int"))).alias("status"),
        F.when(F.col("k") % 9 == 7, F.concat(F.lit("<p>Please VERIFY you are human"), "html")).otherwise(F.col("html")).alias("body"),
    )
    return access.response_outcome(captures).select("page_id", "status", "outcome", "retryable")


OUTCOME_SQL = """WITH c AS (SELECT page_id, CASE WHEN page_id % 13 <> 5 THEN [200, 200, 404, 429, 503, 403, 406, 200, 500][page_id % 9 + 1] END AS status,
      page_id % 9 = 7 OR contains(lower(html), 'captcha') OR contains(lower(html), 'verify you are human') AS challenged FROM pages),
    o AS (SELECT page_id, CAST(status AS INTEGER) AS status, CASE WHEN status IS NULL THEN 'network_failure' WHEN status IN (429, 503, 500) THEN 'transient_http_failure'
      WHEN status IN (403, 406) THEN 'access_blocked' WHEN status >= 400 THEN 'http_failure' WHEN challenged THEN 'access_blocked' ELSE 'ok' END AS outcome FROM c)
    SELECT page_id, status, outcome, outcome IN ('network_failure', 'transient_http_failure') AS retryable FROM o"""


def robots_eligibility(spark, sf_dir):
    """Robots files per origin: .org sites have several rules, .net sites have no file."""
    p = _page_rows(spark, sf_dir)
    origin = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    org = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/7\nDisallow: /fr # note\nDisallow: /en\n"
    com = "user-agent: *\nDisallow:\n\n"
    robots = (
        p.select(origin.alias("origin")).distinct().where(~F.col("origin").endswith(".net"))
        .withColumn("body", F.when(F.col("origin").endswith(".org"), org).otherwise(com))
    )
    return access.robots_filter(p.select("page_id", "url"), robots).drop("url")


ROBOTS_SQL = r"""WITH b AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM pages),
    r AS (SELECT *, NOT (ends_with(origin, '.org') AND NOT starts_with(path, '/en/7') AND (starts_with(path, '/fr') OR starts_with(path, '/en'))) AS allowed FROM b)
    SELECT page_id, allowed, CASE WHEN ends_with(origin, '.net') THEN 'robots_unavailable' WHEN NOT allowed THEN 'robots_disallowed' END AS robots_code FROM r"""

_SITES = (
    "https://acme.wd1.myworkdayjobs.com/Ext/{}", "https://wd5.myworkdaysite.com/Recruiting/ten/site{}",
    "https://wd5.myworkdaysite.com/x/{}", "https://jobs.veralto.com/global/en/{}",
    "https://CAREERS.box.com/en/jobs/{}", "https://jobs.kwiktrip.com/us/en/{}",
    "https://careers.toyota.com/us/en/{}/", "https://globalfoundries.eightfold.ai/careers?p={}",
    "https://careers.rivian.com/careers-home/jobs/{}", "https://t.fa.oraclecloud.com/{}",
    "https://prgx.com/company/careers/{}", "https://bloomberg.avature.net/careers/SearchJobs?b=1&page={}",
    "https://careers.rivian.com/other/{}", "https://unknown.example/{}",
)


def detect_platform(spark, sf_dir):
    p = _page_rows(spark, sf_dir)
    site = F.element_at(F.array(*[F.lit(s) for s in _SITES]), (F.col("k") % len(_SITES) + 1).cast("int"))
    sources = p.select(
        "page_id", F.replace(site, F.lit("{}"), F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/([0-9]+)", 1)).alias("url"),
        F.when(F.col("k") % 2 == 0, F.create_map(F.lit("max_pages"), F.lit("7"))).alias("config"),
    )
    out = access.detect_platform(sources)

    def setting(name: str):
        return F.try_element_at("settings", F.lit(name))

    return out.select(
        "page_id", "platform", "connector", "confidence", "error_code",
        setting("max_pages").alias("max_pages"), setting("site").alias("site"),
        setting("api_url").alias("api_url"), setting("listing_url").alias("listing_url"),
        setting("allowed_paths").alias("allowed_paths"),
    )


_P = "page_id % 14"
PLATFORM_SQL = f"""WITH d AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS n, CASE {_P} WHEN 0 THEN 'workday' WHEN 1 THEN 'workday' WHEN 3 THEN 'phenom' WHEN 4 THEN 'happydance' WHEN 5 THEN 'phenom_kwiktrip'
      WHEN 6 THEN 'phenom_toyota' WHEN 7 THEN 'eightfold' WHEN 8 THEN 'icims_jibe' WHEN 9 THEN 'oracle_ce' WHEN 10 THEN 'hirebridge' WHEN 11 THEN 'avature' END AS platform FROM pages)
    SELECT page_id, platform, CASE WHEN {_P} BETWEEN 3 AND 7 THEN 'paginated_html_jsonld' ELSE
      CASE platform WHEN 'workday' THEN 'workday_cxs' WHEN 'icims_jibe' THEN 'icims_jibe_api' WHEN 'oracle_ce' THEN 'oracle_ce_rest' WHEN 'hirebridge' THEN 'hirebridge_html' WHEN 'avature' THEN 'avature_html' END END AS connector,
    CAST(CASE WHEN {_P} BETWEEN 3 AND 7 THEN 0.98 WHEN platform IS NOT NULL THEN 0.99 END AS DOUBLE) AS confidence,
    CASE WHEN {_P} = 2 THEN 'invalid_workday_url' WHEN platform IS NULL THEN 'unsupported_source' END AS error_code,
    CASE WHEN platform IS NULL THEN NULL WHEN page_id % 2 = 0 THEN '7' WHEN {_P} IN (3, 4, 5, 6) THEN '500' WHEN {_P} IN (7, 10, 11) THEN '100' END AS max_pages,
    CASE {_P} WHEN 0 THEN 'Ext' WHEN 1 THEN 'site' || n END AS site,
    CASE {_P} WHEN 8 THEN 'https://careers.rivian.com/api/jobs' END AS api_url,
    CASE {_P} WHEN 5 THEN '/us/en/search-results' WHEN 7 THEN '/careers' WHEN 11 THEN 'https://bloomberg.avature.net/careers/SearchJobs?b=1&page=' || n END AS listing_url,
    CASE {_P} WHEN 3 THEN '/global/en' WHEN 4 THEN '/en/jobs' WHEN 5 THEN '/us/en' WHEN 6 THEN '/us/en' WHEN 7 THEN '/careers' END AS allowed_paths FROM d"""


def discover_coordinates(spark, sf_dir):
    p = _page_rows(spark, sf_dir)
    k, n = F.col("k") % 6, F.col("page_id").cast("string")
    tag = (
        F.when(k == 0, F.concat(F.lit('<base data-apibaseurl="https://T'), n, F.lit('.fa.ocs.oraclecloud.com:443/" data-sitenumber=" CX_1 ">')))
        .when(k == 1, F.lit('<base data-sitenumber="CX_1" data-apibaseurl="https://evil.example">'))
        .when(k == 2, F.lit("<base href='/'>"))
        .when(k == 3, F.concat(F.lit("<iframe class=a src='//recruit.hirebridge.com/v3/c?x=1&amp;cid="), n, F.lit("'></iframe>")))
        .when(k == 4, F.lit('<iframe src="https://recruit.hirebridge.com/v3/c?cid=a1"></iframe>'))
        .otherwise('<!-- <iframe src="https://recruit.hirebridge.com/?cid=1"> --><iframe src="https://www.hirebridge.com/?cid=1"></iframe>')
    )
    captures = p.select(
        n.alias("source_id"), F.concat(F.lit("https://careers.example.com/"), n).alias("url"),
        F.when(k < 3, "oracle_ce").otherwise("hirebridge").alias("platform"),
        F.concat(tag, "html").alias("body"),
    )
    return html_pages.discover_coordinates(captures).drop("url")


COORDINATES_SQL = """SELECT CAST(page_id AS VARCHAR) AS source_id, CASE WHEN page_id % 6 < 3 THEN 'oracle_ce' ELSE 'hirebridge' END AS platform,
    CASE WHEN page_id % 6 = 0 THEN 'https://t' || page_id || '.fa.ocs.oraclecloud.com' END AS api_base_url, CASE WHEN page_id % 6 = 0 THEN 'CX_1' END AS site_number,
    CASE WHEN page_id % 6 = 3 THEN 'https://recruit.hirebridge.com/v3/c?cid=' || page_id || '&x=1' END AS embed_url,
    CASE WHEN page_id % 6 = 3 THEN CAST(page_id AS VARCHAR) END AS client_id,
    CASE page_id % 6 WHEN 1 THEN 'unsafe_oracle_configuration' WHEN 2 THEN 'oracle_configuration_missing' WHEN 4 THEN 'invalid_hirebridge_client' WHEN 5 THEN 'unsafe_embed_host' END AS error_code FROM pages"""


# --- coverage ---------------------------------------------------------------------------


def page_signature_loops(spark, sf_dir):
    """Orders as result pages, 25 to a scan; a page's items are its parts modulo five."""
    li = table(spark, sf_dir, "lineitem")
    items = li.select(
        F.floor(F.col("l_orderkey") / 25).alias("scan_run_id"), (F.col("l_orderkey") % 25).alias("page"),
        F.col("l_linenumber").alias("position"), (F.col("l_partkey") % 5).cast("string").alias("item_id"),
    )
    one = items.groupBy("scan_run_id", "page", "position").agg(F.min("item_id").alias("item_id"))
    return coverage.page_loops(one)


LOOPS_SQL = """WITH i AS (SELECT l_orderkey // 25 AS scan_run_id, l_orderkey % 25 AS page, l_linenumber AS pos, min(CAST(l_partkey % 5 AS VARCHAR)) AS item FROM lineitem GROUP BY ALL),
    s AS (SELECT scan_run_id, page, count(*) AS items, string_agg(pos || '=' || item, ',' ORDER BY pos) AS sig FROM i GROUP BY ALL),
    f AS (SELECT *, min(page) OVER (PARTITION BY scan_run_id, sig) AS first_page FROM s)
    SELECT scan_run_id, page, first_page, items FROM f WHERE page > first_page"""


def _listing_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    scan = F.floor(F.col("l_orderkey") / 25)
    return li.groupBy(scan.alias("scan_run_id"), ((F.col("l_orderkey") % 25) * 4).alias("page_offset")).agg(
        F.count(F.lit(1)).alias("items")
    ).withColumn("total", 96 - (F.col("scan_run_id") % 3) * 10)


def listing_coverage(spark, sf_dir):
    return coverage.listing_coverage(_listing_pages(spark, sf_dir))


_PAGES_SQL = """SELECT l_orderkey // 25 AS scan_run_id, (l_orderkey % 25) * 4 AS page_offset, count(*) AS items, 96 - (l_orderkey // 25 % 3) * 10 AS total
    FROM lineitem GROUP BY 1, 2, 4"""
COVERAGE_SQL = f"""WITH p AS ({_PAGES_SQL}), g AS (SELECT scan_run_id, count(*) AS pages, CAST(sum(items) AS BIGINT) AS received, max(total) AS advertised,
    bool_or(page_offset + items >= total) AS reached_end FROM p GROUP BY 1) SELECT *, reached_end AND received >= advertised AS complete FROM g"""


def next_offsets(spark, sf_dir):
    chunk = F.floor(F.col("page_offset") / 40)
    out = coverage.next_offsets(_listing_pages(spark, sf_dir), 4, chunk)
    return out.select("scan_run_id", "page_offset", "expected_offset", "next_offset")


OFFSETS_SQL = f"""WITH p AS ({_PAGES_SQL}), n AS (SELECT *, lead(page_offset) OVER (PARTITION BY scan_run_id ORDER BY page_offset) AS next_offset FROM p)
    SELECT scan_run_id, page_offset, page_offset + 4 AS expected_offset, next_offset FROM n
    WHERE page_offset + 4 < total AND (next_offset IS NULL OR next_offset <> page_offset + 4)"""


def crawl_reachability(spark, sf_dir):
    """Pages of a top-level domain as one site, crawled along the links in their html: a link leads to
    the first page of the site whose own first link has that target."""
    p = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    pages = p.select(
        F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)[/:?#]", 1).alias("source_id"),
        F.col("page_id").alias("url"), hrefs.alias("hrefs"),
    )
    answers = pages.groupBy("source_id", F.try_element_at("hrefs", F.lit(1)).alias("href")).agg(
        F.min("url").alias("next_url")
    )
    links = pages.select("source_id", "url", F.posexplode("hrefs").alias("position", "href")).join(
        answers, ["source_id", "href"]
    )
    starts = pages.groupBy("source_id").agg(F.min("url").alias("url"))
    _, summary = coverage.crawl_coverage(starts, links, 12)
    return summary


CRAWL_SQL = r"""WITH RECURSIVE pg AS (SELECT page_id AS u, regexp_extract(url, '^https?://[^/]*\.([a-z]+)[/:?#]', 1) AS s, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages),
    an AS (SELECT s, h[1] AS href, min(u) AS v FROM pg WHERE len(h) > 0 GROUP BY ALL),
    x AS (SELECT s, u, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM pg),
    l AS (SELECT x.s, x.u, an.v, min(pos) AS pos FROM x JOIN an ON an.s = x.s AND an.href = x.href GROUP BY ALL),
    r(s, u, depth, path) USING KEY (s, u) AS (
      SELECT s, min(u), 0, []::BIGINT[] FROM pg GROUP BY s
      UNION SELECT l.s, l.v, min(r.depth) + 1, min(list_append(r.path, l.pos)) FROM r JOIN l ON l.s = r.s AND l.u = r.u
        WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.s = l.s AND k.u = l.v) GROUP BY l.s, l.v),
    lo AS (SELECT l.s, count(*) AS n FROM l JOIN r a ON a.s = l.s AND a.u = l.u JOIN r b ON b.s = l.s AND b.u = l.v
      WHERE b.depth < a.depth OR b.depth = a.depth AND b.path <= a.path GROUP BY 1)
    SELECT r.s AS source_id, count(*) AS reachable, CAST(least(count(*), 12) AS BIGINT) AS visited, coalesce(any_value(lo.n), 0) AS loop_links, count(*) > 12 AS page_limit_reached
    FROM r LEFT JOIN lo ON lo.s = r.s GROUP BY r.s"""


def _facet_tables(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    source = F.col("p_partkey") % 20
    label = F.concat("p_type", (F.col("p_size") % 3).cast("string"))
    selected = part.where(F.col("p_partkey") % 3 == 0).select(
        source.alias("source_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("facet_parameter"),
        label.alias("label"), F.col("p_name").alias("id"),
    )
    available = part.where(F.col("p_partkey") % 3 != 0).select(
        source.alias("source_id"), (F.col("p_size") % 2).alias("group_seq"), F.col("p_brand").alias("facet_parameter"),
        F.col("p_partkey").alias("value_seq"), label.alias("label"), F.col("p_name").alias("id"),
    )
    return selected, available


def facet_drift(spark, sf_dir):
    return coverage.facet_drift(*_facet_tables(spark, sf_dir))


DRIFT_SQL = """WITH b AS (SELECT p_partkey % 20 AS source_id, p_partkey AS seq, p_brand AS facet_parameter, p_type || (p_size % 3) AS label, p_name AS id, p_size % 2 AS g FROM part),
    a AS (SELECT * FROM b WHERE seq % 3 <> 0), l AS (SELECT source_id, facet_parameter, max(g) AS g FROM a GROUP BY ALL),
    c AS (SELECT a.source_id, a.facet_parameter, a.label, arg_min(a.id, a.seq) AS current_id FROM a JOIN l ON a.source_id = l.source_id AND a.facet_parameter = l.facet_parameter AND a.g = l.g GROUP BY ALL)
    SELECT b.source_id, b.seq, b.facet_parameter, b.label, b.id, CASE WHEN current_id IS NULL THEN 'label_missing' ELSE 'id_changed' END AS reason, current_id
    FROM b LEFT JOIN c ON b.source_id = c.source_id AND b.facet_parameter = c.facet_parameter AND b.label = c.label
    WHERE b.seq % 3 = 0 AND (current_id IS NULL OR current_id <> b.id)"""


def facet_payload(spark, sf_dir):
    """Saved facets of a row (brand, type, brand again) as a filter payload."""
    part = table(spark, sf_dir, "part")

    def facet(parameter: str, value: str):
        return F.struct(F.col(parameter).alias("facet_parameter"), F.col(value).cast("string").alias("id"))

    facets = F.array(facet("p_brand", "p_name"), facet("p_type", "p_size"), facet("p_brand", "p_partkey"))
    payload = coverage.facet_payload(facets)
    return part.select("p_partkey", F.to_json(payload).alias("payload"))


PAYLOAD_SQL = """SELECT p_partkey, '{"' || p_brand || '":["' || p_name || '","' || p_partkey || '"],"' || p_type || '":["' || p_size || '"]}' AS payload FROM part"""


def source_preview(spark, sf_dir):
    listing = derived.raw_postings(spark, sf_dir).select("source_id", "seq", "title", "url")
    out = coverage.source_preview(listing)
    return out.select("source_id", "rank", F.md5("title").alias("title_md5"), "job_count")


PREVIEW_SQL = """SELECT source AS source_id, CAST(rn AS INTEGER) AS rank, md5(split_part(text, chr(10), 1)) AS title_md5, job_count FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS job_count FROM documents) WHERE rn <= 5"""


# --- integrity --------------------------------------------------------------------------


def _one_of(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def constraint_audit(spark, sf_dir):
    """Every domain and limit, uniqueness and references; some columns get values outside. Documents stand
    for what users may enter: their lines and words fill the lists."""
    srcs, history = derived.scan_state(spark, sf_dir)
    number = F.substring("source_id", 4, 9).cast("int")
    srcs = srcs.withColumn("health_status", _one_of(("unknown", "healthy", "temporarily_failing", "setup_required", "broken"), number))
    history = history.withColumn("trigger", _one_of(("initial", "scheduled", "manual", "cron"), F.col("scan_seq")))
    listing = derived.scan_listing(spark, sf_dir)
    matches = (
        derived.matches(spark, sf_dir)
        .withColumn("provider", _one_of(("local", "anthropic", "other"), F.col("score")))
        .withColumn("provider_status", _one_of(("success", "fallback", "hard_constraint", "lost"), F.col("score")))
    )
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    words = F.split(F.try_element_at(F.split("text", "\n"), F.lit(1)), " ")
    entered = docs.select(
        F.array_join(words, " ").alias("company"), F.array_join(F.slice(words, 1, 3), " ").alias("name"),
        *[F.col("text").alias(c) for c in ("notes", "resume_text", "preference_notes")],
        words.alias("target_roles"), F.split("text", "\n").alias("adjacent_roles"),
        F.split("text", ", ").alias("preferred_locations"), F.split("text", "\\. ").alias("employment_types"),
        F.split("text", " ").alias("required_terms"), F.split("text", " the ").alias("excluded_terms"),
    )
    texts = ("company", "name", "notes", "resume_text", "preference_notes")
    limits = {f"limit_{c}": quality.within_limit(c) if c in texts else quality.list_within_limit(c) for c in quality.LIMITS}

    def domains(*names):
        return {f"domain_{n}": quality.in_domain("status" if n == "scan_status" else n, n) for n in names}

    scored = domains("classification", "provider", "provider_status")
    parts = [
        quality.audit({
            "unique_scan": quality.duplicates(history, ["source_id", "scan_seq"]),
            "unique_observation_url": quality.duplicates(listing, ["scan_run_id", "canonical_url"]),
            "unique_text": quality.duplicates(docs.select(F.md5("text").alias("m")), ["m"]),
            "unique_match": quality.duplicates(matches, list(matching.MEMO_KEY)),
            "orphan_label": quality.orphans(labels, docs, "doc_id", "doc_id"),
            "orphan_observation": quality.orphans(listing, history, "scan_run_id", "scan_run_id"),
        }),
        quality.violations(derived.jobs(spark, sf_dir), domains("lifecycle_status")),
        quality.violations(history, domains("scan_status", "trigger")),
        quality.violations(srcs, domains("setup_status", "health_status", "monitoring_status")),
        quality.violations(matches, scored | {"score_range": F.col("score").between(0, 100)}),
        quality.violations(derived.profiles(spark, sf_dir), domains("remote_preference")),
        quality.violations(entered, limits),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _limit_sql() -> str:
    first = "string_split(string_split(text, chr(10))[1], ' ')"
    sizes = {
        "company": "length(string_split(text, chr(10))[1])", "name": f"length(array_to_string({first}[1:3], ' '))",
        **{c: "length(text)" for c in ("notes", "resume_text", "preference_notes")},
        "target_roles": f"len({first})", "adjacent_roles": "len(string_split(text, chr(10)))",
        "preferred_locations": "len(string_split(text, ', '))", "employment_types": "len(string_split(text, '. '))",
        "required_terms": "len(string_split(text, ' '))", "excluded_terms": "len(string_split(text, ' the '))",
    }
    return " ".join(
        f"UNION ALL SELECT 'limit_{c}', count(*) FILTER (WHERE {sizes[c]} > {quality.LIMITS[c]}) FROM documents"
        for c in quality.LIMITS
    )


AUDIT_SQL = sql(
    """, number AS (SELECT DISTINCT source_id, CAST(substr(source_id, 4) AS INTEGER) AS k FROM scans)
    SELECT 'unique_scan' AS check_name, 0::BIGINT AS violations
    UNION ALL SELECT 'unique_observation_url', count(*) FROM (SELECT 1 FROM listing GROUP BY scan_run_id, canonical_url HAVING count(*) > 1)
    UNION ALL SELECT 'unique_text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
    UNION ALL SELECT 'unique_match', count(*) FROM (SELECT 1 FROM matches GROUP BY job_id, profile_id, profile_version, fp HAVING count(*) > 1)
    UNION ALL SELECT 'orphan_label', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'orphan_observation', count(*) FROM listing l WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.scan_run_id = l.scan_run_id)
    UNION ALL SELECT 'domain_lifecycle_status', count(*) FROM jobs WHERE lifecycle_status NOT IN ('active', 'possibly_closed', 'closed')
    UNION ALL SELECT 'domain_scan_status', 0
    UNION ALL SELECT 'domain_trigger', count(*) FROM scans WHERE scan_seq % 4 = 3
    UNION ALL SELECT 'domain_setup_status', 0 UNION ALL SELECT 'domain_monitoring_status', 0
    UNION ALL SELECT 'domain_health_status', count(*) FROM number WHERE k % 5 = 4
    UNION ALL SELECT 'domain_classification', count(*) FROM matches WHERE classification NOT IN ('strong', 'possible', 'irrelevant')
    UNION ALL SELECT 'domain_provider', count(*) FROM matches WHERE score % 3 = 2
    UNION ALL SELECT 'domain_provider_status', count(*) FROM matches WHERE score % 4 = 3
    UNION ALL SELECT 'score_range', count(*) FROM matches WHERE score NOT BETWEEN 0 AND 100
    UNION ALL SELECT 'domain_remote_preference', 0 """ + _limit_sql(),
    "listing", "scans", "matches", "jobs",
)


def purge(spark, sf_dir):
    """Row counts of all tables after the sources of odd number were removed."""
    jobs = derived.jobs(spark, sf_dir).select("source_id", "job_id")
    other = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    obs = table(spark, sf_dir, "events").select(other.alias("source_id"), derived.text_id("user_id").alias("job_id"))
    states = profiles.user_state_latest(derived.user_state_patches(spark, sf_dir)).select("job_id")
    tables = {
        "jobs": jobs, "observations": obs, "user_states": states,
        "matches": derived.matches(spark, sf_dir).select("job_id", "score"),
    }
    gone = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().where(
        F.substring("source_id", 4, 9).cast("int") % 2 == 1
    )
    left = quality.purge(tables, gone)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.count("job_id").alias("linked")).select(F.lit(name).alias("table_name"), "n", "linked")
        for name, df in left.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


PURGE_SQL = sql(
    """, gone AS (SELECT DISTINCT source AS source_id FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 1),
    gj AS (SELECT CAST(doc_id AS VARCHAR) AS job_id FROM documents WHERE source IN (SELECT source_id FROM gone)),
    o AS (SELECT CASE WHEN CAST(user_id AS VARCHAR) IN (SELECT job_id FROM gj) THEN NULL ELSE user_id END AS job_id FROM events WHERE 'src' || (user_id % 20) NOT IN (SELECT source_id FROM gone))
    SELECT 'jobs' AS table_name, count(*) AS n, count(*) AS linked FROM documents WHERE source NOT IN (SELECT source_id FROM gone)
    UNION ALL SELECT 'observations', count(*), count(job_id) FROM o
    UNION ALL SELECT 'user_states', count(*), count(*) FROM states WHERE job_id NOT IN (SELECT job_id FROM gj)
    UNION ALL SELECT 'matches', count(*), count(*) FROM matches WHERE job_id NOT IN (SELECT job_id FROM gj)""",
    "states", "matches",
)

QUERIES = {
    "jsonld_roundtrip": (jsonld_roundtrip, JSONLD_SQL),
    "embedded_roundtrip": (embedded_roundtrip, EMBEDDED_SQL),
    "ats_w_roundtrip": (ats_w_roundtrip, ATS_W_SQL),
    "ats_i_roundtrip": (ats_i_roundtrip, ATS_I_SQL),
    "ats_o_roundtrip": (ats_o_roundtrip, ATS_O_SQL),
    "ats_html_roundtrip": (ats_html_roundtrip, ATS_HTML_SQL),
    "ats_a_roundtrip": (ats_a_roundtrip, ATS_A_SQL),
    "extract_outcomes": (extract_outcomes, OUTCOMES_SQL),
    "scan_result": (scan_result, SCAN_SQL),
    "scan_paging": (scan_paging, PAGING_SQL),
    "source_validation": (source_validation, VALIDATION_SQL),
    "repeated_listing_pages": (repeated_listing_pages, REPEATED_SQL),
    "generated_next_pages": (generated_next_pages, NEXT_SQL),
    "valid_items": (valid_items, VALID_SQL),
    "response_outcome": (response_outcome, OUTCOME_SQL),
    "robots_eligibility": (robots_eligibility, ROBOTS_SQL),
    "detect_platform": (detect_platform, PLATFORM_SQL),
    "discover_coordinates": (discover_coordinates, COORDINATES_SQL),
    "page_signature_loops": (page_signature_loops, LOOPS_SQL),
    "listing_coverage": (listing_coverage, COVERAGE_SQL),
    "next_offsets": (next_offsets, OFFSETS_SQL),
    "crawl_reachability": (crawl_reachability, CRAWL_SQL),
    "facet_drift": (facet_drift, DRIFT_SQL),
    "facet_payload": (facet_payload, PAYLOAD_SQL),
    "source_preview": (source_preview, PREVIEW_SQL),
    "constraint_audit": (constraint_audit, AUDIT_SQL),
    "purge": (purge, PURGE_SQL),
}
