"""Platform readers on small payloads of the shapes the platforms send."""

import datetime
import json
import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from tests import html_parser
from vacancyledger.operators import access, coverage, normalize
from vacancyledger.sources import ats_json, extractors, html_fields, html_pages, jsonld

DAY = datetime.date(2026, 8, 2)
CAPTURE = "source_id string, scan_run_id string, seq bigint, kind string, url string, body string, source_url string"


def captures(spark, rows, home="https://jobs.example.com/us/en"):
    data = [("s", "r", i, kind, url, body, home) for i, (kind, url, body) in enumerate(rows)]
    return spark.createDataFrame(data, CAPTURE)


def posting(**changes):
    base = {
        "@type": "JobPosting", "title": "Data Engineer", "datePosted": "2026-08-02",
        "description": "<p>Build.</p>", "employmentType": ["FULL_TIME"], "identifier": {"value": "R1"},
        "jobLocation": {"address": {"addressLocality": "Malta", "addressCountry": {"name": "US"}}},
    }
    return {**base, **changes}


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_first_posting_and_error_codes(spark):
    other = json.dumps({"@type": "Organization"})
    graph = json.dumps({"@graph": [{"@type": "Organization", "x": posting(title="Nested")}, posting(title="Later")]})
    pages = {
        "direct": ld(json.dumps(posting())), "second": ld(other, json.dumps(posting(title="B"))),
        "graph": ld(graph), "typed": ld(json.dumps(posting(**{"@type": ["Thing", "JobPosting"]}))),
        "broken_then_good": ld("{oops", json.dumps(posting(title="C"))), "broken": ld("{oops"), "none": "<p>x</p>",
        "wrong": ld(other), "trailing": ld(json.dumps(posting()) + "}"),
    }
    df = captures(spark, [("detail", name, body) for name, body in pages.items()])
    got = {r.url: (r.t, r.error_code) for r in jsonld.extract_jobposting(df).select(
        "url", "error_code", F.try_variant_get("posting", "$.title", "string").alias("t")).collect()}
    assert got["direct"] == ("Data Engineer", None) and got["second"] == ("B", None)
    assert got["graph"] == ("Nested", None) and got["typed"] == ("Data Engineer", None)
    assert got["broken_then_good"] == ("C", None) and got["broken"] == (None, "malformed_jsonld")
    assert got["none"] == (None, "missing_jsonld") and got["wrong"] == (None, "missing_jsonld")


def test_escaped_description_shows_its_tags(spark):
    df = captures(spark, [
        ("detail", "a", ld(json.dumps(posting(description="&lt;p&gt;Hi&lt;/p&gt;")))),
        ("detail", "b", ld(json.dumps(posting(description="R&amp;D")))),
        ("detail", "c", ld(json.dumps(posting(description=" ", identifier="X9", employmentType="CONTRACT")))),
    ])
    rows = {r.capture_url: r for r in jsonld.posting_fields(jsonld.extract_jobposting(df), "x").collect()}
    assert rows["a"].description_html == "<p>Hi</p>" and rows["b"].description_html == "R&amp;D"
    assert rows["c"].description_html is None and rows["c"].external_id == "X9"
    assert rows["a"].locations == ["Malta, US"] and rows["a"].posted_date == DAY
    assert rows["a"].employment_type == "FULL_TIME" and rows["c"].employment_type == "CONTRACT"


def test_html_site_end_to_end(spark):
    home = "https://jobs.example.com/us/en/search-results"
    script = 'phApp.ddo = {"eagerLoadRefineSearch":{"hits":2,"totalHits":3,"data":{"jobs":[{"jobSeqNo":"T1","reqId":"1","title":"Data Ingénieur"},{"jobSeqNo":"","title":"x"}]}}};'
    listing = f'<script>{script}</script><a href="/us/en/job/A7?utm_source=x">Anchor <b>job</b></a><a href="https://evil.example/us/en/job/9">off</a>'
    detail = "https://jobs.example.com/us/en/job/"
    df = captures(spark, [
        ("listing", home, listing),
        ("detail", detail + "T1/Data-Ingenieur", ld(json.dumps(posting(url="https://jobs.example.com/us/en/job/T1/x?b=1#f")))),
        ("detail", detail + "A7", ld(json.dumps(posting(url="https://evil.example/z", title="", identifier=None)))),
    ], home)
    rows = {r.title: r for r in extractors.html_jsonld(df, extractors.SITE_RULES["phenom_kwiktrip"]).collect()}
    assert rows["Data Engineer"].url == "https://jobs.example.com/us/en/job/T1/x"
    assert rows["Anchor job"].url == detail + "A7" and rows["Anchor job"].external_id is None
    value = jsonld.embedded_object(F.col("body"), "phApp.ddo =")
    counts = df.limit(1).select(jsonld.embedded_counts(value, ["eagerLoadRefineSearch", "totalHits"], ["eagerLoadRefineSearch", "hits"]).alias("c")).first().c
    assert (counts.total, counts.page_size) == (3, 2)


def test_links_and_next_pages(spark):
    page = (
        '<!-- <a href="/en/jobs/0">no</a> --><a class=t href=/en/jobs/1/x>One</a><A HREF=\'/en/jobs/2\'>Two</A>'
        '<a data-href="/en/jobs/3">no</a><a rel="next" href="?page=2&amp;ref=q">&gt;</a><a aria-label="Go to Next" href="/en/jobs?page=2">n</a>'
        '<a rel="next" href="https://evil.example/en/jobs">n</a><script>"<a href=\'/en/jobs/4\'>"</script>'
    )
    home = "https://careers.example.com/en/jobs"
    links = html_pages.anchors(captures(spark, [("listing", home, page)], home))
    prefixes = F.array(F.lit("/en/jobs"))
    jobs, rejected = html_pages.extract_links(links, r"/en/jobs/(\d+)(?:/|$)", F.lit(home), prefixes, 1)
    assert [(r.external_id, r.url, r.title) for r in jobs.orderBy("position").collect()] == [
        ("1", home + "/1/x", "One"), ("2", home + "/2", "Two"),
    ]
    assert rejected.count() == 0
    allowed, unsafe = html_pages.extract_next_links(links, F.lit(home), prefixes)
    assert [r.next_url for r in allowed.collect()] == [home + "?page=2"]
    assert [(r.code, r.n) for r in unsafe.collect()] == [("unsafe_pagination_ignored", 1)]
    both = html_pages.union_next_pages(allowed, allowed.withColumn("position", F.lit(99)))
    assert [r.position for r in both.collect()] == [r.position for r in allowed.collect()]


def test_ats_w(spark):
    home = "https://acme.wd1.myworkdayjobs.com/Ext"
    listing = {"total": 2, "facets": [{"facetParameter": "t", "values": [{"id": "1", "descriptor": "Full", "count": 2}]}],
               "jobPostings": [{"title": "A", "externalPath": "/job/x/A_R1", "bulletFields": ["R1"]}, {"title": "no path"}]}
    info = {"title": "A", "location": "Remote", "additionalLocations": ["Chicago"], "postedOn": "2026-08-02", "jobDescription": "<p>d</p>"}
    url = "https://acme.wd1.myworkdayjobs.com/job/x/A_R1"
    df = captures(spark, [
        ("listing", home, json.dumps(listing)), ("detail", url, json.dumps({"jobPostingInfo": info})),
        ("detail", url + "2", "<html>"), ("detail", url + "3", "{}"),
    ], home)
    (row,) = extractors.ats_w(df).collect()
    assert (row.external_id, row.url, row.locations, row.posted_date) == ("R1", url, ["Remote", "Chicago"], DAY)
    pages = ats_json.w_pages(df.where("kind = 'listing'")).first()
    assert (pages["items"], pages["total"], pages["error_code"]) == (2, 2, None)
    assert [(r.facet_parameter, r.label, r.id) for r in ats_json.w_facets(df.where("kind = 'listing'")).collect()] == [("t", "Full", "1")]
    codes = ats_json.w_detail(df.where("kind = 'detail'"), ats_json.w_listing(df.where("kind = 'listing'")))
    assert [r.error_code for r in codes.orderBy("seq").collect()] == [None, "malformed_response", "missing_job_detail"]


def test_ats_i_and_o(spark):
    home = "https://careers.example.com/careers-home/jobs"
    data = {"req_id": "7", "title": "A", "description": "x < y", "full_location": "Palo Alto", "meta_data": {"canonical_url": "/careers-home/jobs/7?src=a"}, "posted_date": "2026-08-02"}
    body = json.dumps({"count": 1, "totalCount": 0, "filter": {"c": [{"name": "n", "count": 1}]}, "jobs": [{"data": data}, {"data": None}, {}]})
    df = captures(spark, [("listing", home, body)], home)
    (row,) = extractors.ats_i(df).collect()
    assert (row.url, row.description_html, row.locations) == (home + "/7", "<p>x &lt; y</p>", ["Palo Alto"])
    assert ats_json.i_pages(df).first()["total"] == 1 and ats_json.i_facets(df).first().label == "n"

    home = "https://careers.example.com/sites/X/jobs"
    listing = {"items": [{"TotalJobsCount": 3, "requisitionList": [{"id": "5", "title": "B", "PostedDate": "2026-08-02", "PrimaryLocation": "P"}, {"Id": 6}]}]}
    detail = {"items": [{"ExternalDescriptionStr": "<p>d</p>", "ExternalQualificationsStr": "q & r", "workLocation": {"TownOrCity": "T"}, "secondaryLocations": {"items": [{"LocationName": "S"}]}}]}
    df = captures(spark, [("listing", home, json.dumps(listing)), ("detail", "https://t.oraclecloud.com/x?finder=ById;Id=5,siteNumber=1", json.dumps(detail))], home)
    (row,) = extractors.ats_o(df).collect()
    assert (row.external_id, row.title, row.url) == ("5", "B", "https://careers.example.com/sites/X/job/5")
    assert row.locations == ["P", "S", "T"] and row.posted_date == DAY
    assert row.description_html == "<p>d</p><h2>Qualifications</h2><p>q &amp; r</p>"
    assert ats_json.o_pages(df.where("kind = 'listing'")).first()["total"] == 3


DETAIL = (
    "<html><main><h1>Senior <i>Engineer</i></h1><div class='job-location'>NY</div><p class='employment-type'>Full<br>Time</p>"
    "<time datetime='2026-08-02'>x</time><section {}><p>a &amp; b</p></section></main></html>"
)


def test_ats_a(spark):
    home = "https://acme.avature.net/careers/SearchJobs"
    listing = '<a href="/careers/JobDetail/NY-Eng/7001">E</a><a href="/careers/SearchJobs?page=2">2</a><a href="http://acme.avature.net/careers/JobDetail/x/1">plain http</a>'
    url = "https://acme.avature.net/careers/JobDetail/NY-Eng/7001"
    df = captures(spark, [("listing", home, listing), ("detail", url, DETAIL.format("class='job-description x'")), ("detail", url + "9", "<h1>t</h1>")], home)
    kinds = html_pages.ats_a_listing(html_pages.anchors(df.where("kind = 'listing'")), F.lit(home))
    assert [r.kind for r in kinds.orderBy("position").collect()] == ["job", "next", "rejected"]
    (row,) = extractors.ats_a(df).collect()
    assert (row.external_id, row.title, row.locations, row.employment_type) == ("7001", "Senior Engineer", ["NY"], "Full Time")
    assert row.description_html == "<section class='job-description x'><p>a &amp; b</p></section>" and row.posted_date == DAY


def test_ats_h(spark):
    board = "https://recruit.hirebridge.com/v3/c?cid=7"
    listing = (
        '<article><a href="/v3/Jobs/D.aspx?cid=7&amp;jid=1">One</a><span class="location">Rome</span><b class="job-type">Part</b></article>'
        '<article><a href="/v3/Jobs/D.aspx?cid=9&amp;jid=2">Wrong</a></article><a rel="next" href="/v3/c?cid=7&amp;page=2">n</a>'
    )
    url = "https://recruit.hirebridge.com/v3/Jobs/D.aspx?cid=7&jid=1"
    body = "<h1>One</h1><div id='JobDescription'>text<p>open</div>"
    df = captures(spark, [("listing", board, listing), ("detail", url, body)], board)
    (row,) = extractors.ats_h(df).collect()
    assert (row.external_id, row.locations, row.employment_type) == ("1", ["Rome"], "Part")
    assert row.description_html == "<div id='JobDescription'>text<p>open</div>"
    entries = html_fields.html_entries(df.where("kind = 'listing'"), html_fields.ATS_H_FIELDS)
    assert [(r.text, r.location) for r in entries.orderBy("position").collect()] == [("One", "Rome"), ("Wrong", None), ("n", None)]


def test_all_platforms_union(spark):
    home = "https://careers.example.com/careers-home/jobs"
    data = {"req_id": "7", "title": " A  B ", "description": "d", "meta_data": {"canonical_url": "/careers-home/jobs/7"}}
    df = captures(spark, [("listing", home, json.dumps({"jobs": [{"data": data}]}))], home).drop("source_url")
    sources = spark.createDataFrame([("s", home, "icims_jibe_api", "icims_jibe")], "source_id string, url string, connector_type string, platform string")
    (row,) = extractors.extract_postings(df, sources).collect()
    assert (row.title, row.identity_key, row.description_text, row.locations) == ("A B", "external:7", "d", [])


def parsed_fields(body, fields):
    """The fields by the standard library's parser."""
    page = html_parser.Fields(body or "", fields)

    def text(element):
        return " ".join(element["text"]) if element else None

    def first(name):
        return (page.found.get(name) or [None])[0]

    described, posted = first("description") or first("description_fallback"), first("posted")
    return (
        text(first("title")), page.source[described["start"]:described["end"]] if described else None,
        [text(e) for e in page.found["location"]], text(first("employment_type")),
        posted["attrs"].get("datetime") if posted else None,
    )


ODD_PAGES = (
    "<h1>One</h1><div id='JobDescription'>text<p>open</div>", "<div class='job-description'>never <b>closed", "", None, "plain",
    "<h1/>x<h1>A&nbsp;B</h1>", "<main>a<img src=x>b<!-- <h1>no</h1> --><script>var x='<h1>q</h1>'</script><H1 CLASS=z> T </H1></main>",
    "<div><h1>t</div></h1><span class='a my-location'>x<span>y</span></span><div data-field='location'>z &lt;b&gt;</div>",
    "<div data-job-description='1'>a<div>b<div>c</div></div>d</div>e", "<time datetime='2026-08-02'>x</time>",
)


def test_fields_equal_a_parser(spark):
    rng, bodies = random.Random(1), list(ODD_PAGES)
    marks = ["", " class='job-description'", " class=job-location", ' data-field="title"', ' class="employment-type z"', " id=job-description"]
    for _ in range(80):
        opened, out = [], []
        for _ in range(rng.randint(3, 25)):
            r = rng.random()
            if r < 0.45:
                opened.append(rng.choice(["div", "p", "b", "section", "h1", "main"]))
                out.append(f"<{opened[-1]}{rng.choice(marks)}>")
            elif r < 0.75 and opened:
                out.append(f"</{opened.pop()}>")
            else:
                out.append(rng.choice(["<br/>", "<!-- <p> -->", " a ", "b &amp; c", "x > y", "\n"]))
        bodies.append("".join(out + [f"</{t}>" for t in reversed(opened)]))
    df = spark.createDataFrame([("s", "r", i, "u", b) for i, b in enumerate(bodies)], "source_id string, scan_run_id string, seq long, url string, body string")
    for fields in (html_fields.ATS_A_FIELDS, html_fields.ATS_H_FIELDS):
        for r in html_fields.html_fields(df, fields).collect():
            got = (r.title, r.description, r.locations, r.employment_type, r.posted)
            assert got == parsed_fields(bodies[r.seq], fields), bodies[r.seq]


def test_entries_equal_a_parser(spark):
    """Links with the fields of the nearest block, before or after them, on random pages."""
    rng = random.Random(2)
    bodies = [
        "", None, '<li><a href="/1">a</a><b class=location>x</b></li><a href=2>b</a>',
        '<div><span class="location">out</span><li><a href="/1">a &amp; b</a></li><a href="/2" REL="Next">c</a></div>',
        '<div class="location">own<a href="?x=1&amp;y=2">in</a></div><tr><a href>bare</a><b class="job-type">T</b>',
    ]
    marks = ["", " class='location'", ' class="x job-type"', ' data-field="location"', " class=employment-type"]
    for _ in range(60):
        opened, out = [], []
        for _ in range(rng.randint(3, 30)):
            r = rng.random()
            if r < 0.4:
                opened.append(rng.choice(["div", "li", "span", "article", "b"]))
                out.append(f"<{opened[-1]}{rng.choice(marks)}>")
            elif r < 0.65 and opened:
                out.append(f"</{opened.pop()}>")
            elif r < 0.85:
                out.append(f'<a href="/j{rng.randint(0, 99)}?a=1&amp;b=2" aria-label="Go">l <i>{rng.randint(0, 9)}</i></a>')
            else:
                out.append(rng.choice(["<br/>", "<!-- <li> -->", " a ", "b &amp; c"]))
        bodies.append("".join(out + [f"</{t}>" for t in reversed(opened)]))
    schema = "source_id string, scan_run_id string, seq long, url string, source_url string, body string"
    df = spark.createDataFrame([("s", "r", i, "u", "h", b) for i, b in enumerate(bodies)], schema)
    got = {}
    for r in html_fields.html_entries(df, html_fields.ATS_H_FIELDS).collect():
        got.setdefault(r.seq, []).append((r.position, r.href, r.text, r.rel, r.aria_label, r.location, r.employment_type))

    def text(element):
        return " ".join(element["text"]) if element else None

    wanted = ("location", "employment_type")
    fields = {n: html_fields.ATS_H_FIELDS[n] for n in wanted}
    for i, body in enumerate(bodies):
        links = html_parser.Entries(body or "", fields).links
        expected = [
            (n, a["attrs"]["href"], text(a) or None, a["attrs"].get("rel", "").lower() or None, a["attrs"].get("aria-label", "").lower() or None,
             *[text((block or {}).get(w)) for w in wanted])
            for n, (a, block) in enumerate(links)
        ]
        assert sorted(got.get(i, [])) == expected, body


def scan_of(spark, rows, robots=None, config=None, platform="happydance"):
    """extract_scans over (kind, url, status, body) rows of one scan."""
    data = [("s", "r", i, *row[:3], row[3]) for i, row in enumerate(rows)]
    schema = "source_id string, scan_run_id string, seq bigint, kind string, url string, status int, body string"
    sources = spark.createDataFrame(
        [("s", "https://careers.box.com/en/jobs", "paginated_html_jsonld", platform, config)],
        "source_id string, url string, connector_type string, platform string, config map<string,string>",
    )
    files = None if robots is None else spark.createDataFrame([("https://careers.box.com", robots)], "origin string, body string")
    return extractors.extract_scans(spark.createDataFrame(data, schema), sources, files)


SITE = "https://careers.box.com/en/jobs"


def test_scan_outcomes(spark):
    links = "".join(f'<a href="/en/jobs/{i}">j</a>' for i in range(1, 7))
    page = links + '<nav><a href="/en/jobs?page=1">1</a><a href="/en/jobs?page=2">2</a></nav><a href="https://o.example/en/jobs/9">x</a>'
    good = ld(json.dumps(posting()))
    got = scan_of(spark, [
        ("listing", SITE, 200, page), ("listing", SITE + "?page=2", 200, page), ("detail", SITE + "/1", 200, good),
        ("detail", SITE + "/2", 403, good), ("detail", SITE + "/3", 200, "<p>"), ("detail", SITE + "/4", None, good),
        ("detail", SITE + "/5", 200, good), ("detail", SITE + "/5", 503, good),
    ])
    assert {r.key[-1]: r.error_code for r in got.details.collect()} == {
        "1": None, "2": "access_blocked", "3": "missing_jsonld", "4": "network_failure", "5": None, "6": "detail_not_captured",
    }
    assert sorted(r.canonical_url[-1] for r in got.postings.collect()) == ["1", "5"]
    (scan,) = got.scans.collect()
    assert (scan.pages_visited, scan.listed, scan.usable, scan.complete, scan.status, scan.error_code) == (8, 6, 2, False, "partial", None)
    warned = {(r.code, r.url): r.n for r in got.warnings.collect()}
    assert warned["off_host_links_ignored", SITE] == 1 and warned["pagination_loop", SITE + "?page=2"] == 1
    assert ("access_blocked", SITE + "/2") in warned


def test_refused_and_empty_listings_fail_the_scan(spark):
    good = ld(json.dumps(posting()))
    rows = [("listing", SITE, 429, "x"), ("detail", SITE + "/1", 200, good)]
    assert scan_of(spark, rows).scans.first().error_code == "transient_http_failure"
    assert scan_of(spark, [("listing", SITE, 200, "<p>")]).scans.first().error_code == "zero_results"
    listing = ("listing", SITE, 200, '<a href="/en/jobs/1">j</a>')
    failed = scan_of(spark, [listing, ("detail", SITE + "/1", 200, "<p>")]).scans.first()
    assert (failed.status, failed.error_code) == ("failed", "detail_extraction_failure")
    full = scan_of(spark, [listing, ("detail", SITE + "/1", 200, good)]).scans.first()
    assert (full.status, full.complete, full.pages_visited) == ("success", True, 2)
    barred = scan_of(spark, [listing, ("detail", SITE + "/1", 200, good)], robots="User-agent: *\nDisallow: /en/jobs/1\n")
    assert [r.error_code for r in barred.details.collect()] == ["robots_disallowed"] and barred.postings.count() == 0


def test_next_pages_decide_completeness(spark):
    good = ("detail", SITE + "/1", 200, ld(json.dumps(posting())))
    link = '<a href="/en/jobs/1">j</a>'
    nav = '<nav><a href="/en/jobs?page=2">2</a></nav>'
    first, last = ("listing", SITE, 200, link + nav), ("listing", SITE + "?page=2", 200, link)
    whole = scan_of(spark, [first, last, good])
    assert [(r.complete, r.status) for r in whole.scans.collect()] == [(True, "success")] and whole.warnings.count() == 0
    short = scan_of(spark, [first, good])
    assert [(r.complete, r.status, r.error_code) for r in short.scans.collect()] == [(False, "partial", None)]
    assert [(r.code, r.url) for r in short.warnings.collect()] == [("page_not_captured", SITE + "?page=2")]
    limited = scan_of(spark, [first, good], config={"max_pages": "1"}).scans.first()
    assert (limited.complete, limited.status, limited.error_code) == (False, "failed", "page_limit")


def test_own_pattern_of_a_source(spark):
    rows = [("listing", SITE, 200, '<a href="/en/jobs/1">j</a><a href="/en/role/x7">k</a>')]
    own = scan_of(spark, rows, config={"detail_path_regex": r"/en/role/(?P<id>\w+)", "allowed_paths": "/en"})
    assert [r.key for r in own.details.collect()] == ["https://careers.box.com/en/role/x7"]


def test_settings_of_a_source_override_the_site(spark):
    listing = ("listing", SITE, 200, '<a href="/en/jobs/1">j</a>')
    detail = ("detail", SITE + "/1", 200, ld(json.dumps(posting())))
    assert scan_of(spark, [listing, detail], config={"allowed_paths": "/fr, /en"}).scans.first().listed == 1
    assert scan_of(spark, [listing, detail], config={"allowed_paths": "/fr"}).scans.first().listed == 0


def test_sites_follow_their_own_page_links(spark):
    page = '<a class="x paginationItem" href="?p=2">2</a><nav id="n"><a href="?page=3">3</a></nav><a href="?page=4">4</a>'
    links = html_pages.anchors(captures(spark, [("listing", SITE, page)], SITE))

    def nexts(also):
        found, _ = html_pages.extract_next_links(links, F.lit(SITE), F.array(F.lit("/en/jobs")), also)
        return sorted(r.next_url[-1] for r in found.collect())

    assert nexts(None) == [] and nexts(html_pages.paging_item(links)) == ["2"] and nexts(html_pages.nav_page(links)) == ["3"]
    assert [r.position for r in links.orderBy("position").collect()] == [0, 1, 2]


def test_landed_captures_are_read_by_platform_and_kind(spark, tmp_path):
    rows = [("s", "r", 0, "listing", SITE, 200, '<a href="/en/jobs/1">j</a>'), ("s", "r", 1, "detail", SITE + "/1", 200, ld(json.dumps(posting())))]
    df = spark.createDataFrame(rows, "source_id string, scan_run_id string, seq bigint, kind string, url string, status int, body string")
    sources = spark.createDataFrame([("s", SITE, "paginated_html_jsonld", "happydance")], "source_id string, url string, connector_type string, platform string")
    extractors.land_captures(df, sources, str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    out = extractors.extract_postings(landed, sources)
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(tag") == 2
    parsed = extractors.parse_captures(extractors.gate(landed))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in parsed.splitlines() if "FileScan" in line and "body" in line]
    assert all("kind#" in line.split("PartitionFilters")[1] for line in scans) and 0 < len(scans) <= 3


def test_fingerprint_ignores_what_is_not_content(spark):
    schema = "external_id string, url string, title string, locations array<string>, employment_type string, posted_date date, description_html string, metadata map<string,string>"
    base = ("1", "https://e/1", "T", ["b", "a", " a "], "F", DAY, "<p>x</p>", {"source": "s", "junk": "j"})
    rows = [base, ("2", "https://e/2", *base[2:6], "<div> x </div>", {}), (*base[:2], "", *base[3:]), (*base[:3], ["a"], *base[4:])]
    out = normalize.normalize(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)).orderBy("i").collect()
    assert out[0].content_fingerprint == out[1].content_fingerprint
    assert len({r.content_fingerprint for r in out}) == 3
    assert out[0].locations == ["a", "b"] and out[2].title == "Untitled role" and out[0].raw_metadata == {"source": "s"}


def test_valid_items(spark):
    rows = [("r", "1", "t", "https://h/a"), ("r", None, "t", "https://h/a"), ("r", "1", "", "https://h/a"), ("r", "1", "t", "https://o/a")]
    items = spark.createDataFrame(rows, "scan_run_id string, external_id string, title string, url string").withColumn("source_url", F.lit("https://h/"))
    good, rejects = normalize.valid_items(items, ["scan_run_id"])
    assert good.count() == 1
    assert {r.reason: r["items"] for r in rejects.collect()} == {"missing_id": 1, "missing_title": 1, "off_host": 1}


def test_robots_groups(spark):
    body = "User-agent: scout\nDisallow: /private\n\nUser-agent: *\nDisallow: /\n"
    robots = spark.createDataFrame([("https://h", body), ("https://n", None)], "origin string, body string")
    urls = spark.createDataFrame([("https://h/private/x",), ("https://h/open",), ("https://n/x",), ("https://z/x",)], "url string")
    got = {r.url: (r.allowed, r.robots_code) for r in access.robots_filter(urls, robots, "Scout/1.0").collect()}
    assert got == {
        "https://h/private/x": (False, "robots_disallowed"), "https://h/open": (True, None),
        "https://n/x": (True, "robots_unavailable"), "https://z/x": (True, "robots_unavailable"),
    }
    assert access.robots_filter(urls, robots, "other").where("allowed").count() == 2


ROBOTS = (
    "User-agent: *\nDisallow: /search?q=\nDisallow: /~joe\nAllow: /a b\nDisallow: /a\n",
    "User-agent: one\nUser-agent: Scout\nDisallow: /x # note\n# comment line\nDisallow:\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: scout\nCrawl-delay: 3\nDisallow: /%7ejoe\nUser-agent: *\nDisallow: /z\n",
    "Disallow: /ignored\nUser-agent: *\n\nDisallow: /also\nUser-agent: *\nDisallow: /caf\u00e9?\nDisallow: *",
    "user-agent : *\r\nDISALLOW : /A/\r\nallow: /A/b\r\nSitemap: https://h/s\r\nUser-agent: *\nDisallow: /B",
    "", "nonsense\n\n:", "User-agent: *\nDisallow: /a+b\nDisallow: /100%\n",
)
ROBOT_PATHS = (
    "", "/", "/search?q=1", "/search%3Fq=1", "/~joe/x", "/%7Ejoe/x", "/a%20b/c", "/abc", "/x", "/y", "/z?x=1", "/ignored", "/also",
    "/caf%C3%A9", "/caf\u00e9/x", "/A/", "/A/b", "/a/b", "/B", "/a+b", "/100%", "/*x", "/q?",
)


@pytest.mark.parametrize("agent", ["*", "Scout/1.0", "other"])
def test_robots_equal_the_standard_parser(spark, agent):
    rows, want = [], {}
    for i, body in enumerate(ROBOTS):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        rows.append((f"https://h{i}", body))
        for path in ROBOT_PATHS:
            want[f"https://h{i}{path}"] = parser.can_fetch(agent, f"https://h{i}{path}")
    robots = spark.createDataFrame(rows, "origin string, body string")
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r.url: r.allowed for r in access.robots_filter(urls, robots, agent).collect()}
    assert got == want


def test_attributes_are_read_in_order(spark):
    tags = [
        ('title="see href=/wrong" href="/real"', "/real"), ("data-href=/no href=/yes", "/yes"), ("HREF = '/a b' href=/c", "/a b"),
        ("href", None), ('href=""', ""), ("title='x'", None), ('alt="a>b" href=/q', "/q"),
    ]
    df = spark.createDataFrame(tags, "tag string, want string")
    for r in df.withColumn("got", html_pages.attribute(F.col("tag"), "href")).collect():
        assert r.got == r.want, r.tag


def test_anchors_with_marks_in_quotes(spark):
    body = '<a title="1 > 0, href=/no" href="/yes">go</a><a href="/open>text</a>'
    captures = spark.createDataFrame([("s", "r", 1, "https://h/", body)], "source_id string, scan_run_id string, seq long, url string, body string")
    first = html_pages.anchors(captures).orderBy("position").first()
    assert (first.url, first.text) == ("https://h/yes", "go")


def test_warnings_carry_counts(spark):
    rows = [("r", "off_host", "u", 3), ("r", "off_host", "u", 2), ("r", "x", "u", None), ("r", "robots_unavailable", "u", 5), ("r", "robots_unavailable", "v", 1)]
    df = spark.createDataFrame(rows, "scan_run_id string, code string, url string, n long")
    got = {(r.code, r.url): r.n for r in coverage.warning_counts(df).collect()}
    assert got == {("off_host", "u"): 5, ("x", "u"): 1, ("robots_unavailable", None): 1}


def test_challenge_anywhere_in_the_body(spark):
    df = spark.createDataFrame([(200, "x" * 5000 + "CAPTCHA")], "status int, body string")
    assert access.response_outcome(df).first().outcome == "access_blocked"
    assert access.response_outcome(df, head_chars=2000).first().outcome == "ok"


def crawled(edges, start):
    """Visited pages in queue order and links to pages visited before."""
    queue, seen, loops = [start], [], 0
    while queue:
        page = queue.pop(0)
        seen.append(page)
        for target in dict.fromkeys(edges.get(page, [])):
            if target in seen:
                loops += 1
            elif target not in queue:
                queue.append(target)
    return seen, loops


def test_crawl(spark):
    rng = random.Random(5)
    graphs = {"one": {0: [1, 2], 1: [2]}, "self": {0: [0, 1], 1: [0]}, "long": {i: [i + 1, max(0, i - 3)] for i in range(30)}, "none": {}}
    for n in range(6):
        graphs[f"g{n}"] = {i: [rng.randrange(15) for _ in range(rng.randrange(4))] for i in range(15)}
    starts = spark.createDataFrame([(s, 0) for s in graphs], "source_id string, url int")
    edges = [(s, u, k, v) for s, g in graphs.items() for u, vs in g.items() for k, v in enumerate(vs)]
    links = spark.createDataFrame(edges, "source_id string, url int, position int, next_url int")
    levels, summary = coverage.crawl_coverage(starts, links, 10)
    order = {}
    for r in levels.orderBy("depth", "place").collect():
        order.setdefault(r.source_id, []).append(r.url)
    for r in summary.collect():
        seen, loops = crawled(graphs[r.source_id], 0)
        assert order[r.source_id] == seen
        assert (r.reachable, r.visited, r.loop_links, r.page_limit_reached) == (len(seen), min(10, len(seen)), loops, len(seen) > 10)


def test_roundtrip_parses_each_capture_once(spark):
    """Entries come from listing pages and postings from detail pages; neither side plans the other's reader."""
    from vacancyledger.plans import catalog

    plan = catalog.queries()["embedded_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("ArrowEvalPython [_first_posting" in line for line in plan.splitlines()) == 1
