"""Links and coordinates on HTML pages, as JVM expressions over the page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, collapse_ws, settle, strip_markup, with_unescaped
from ..functions.urls import (
    canonicalize_url, in_scope, query_param, replace_query, url_path, url_query,
)
from ..operators.access import client_link_allowed, same_https_host, safe_api, safe_embed

_HIDDEN = r"(?s)<!--.*?-->|(?i)<(script|style|template)\b[^>]*>.*?</\1\s*>"
# The inside of a start tag up to its end: a ">" in quotes does not end it, unless a quote is left open.
_INSIDE = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*)"""
_ANCHOR = rf"(?is)<a\s{_INSIDE}>.*?(?=</a\s*>|<a\s|\z)"
_OPEN = rf"(?is)^<a\s({_INSIDE})>"
_INNER = rf"(?is)^<a\s{_INSIDE}>(.*)$"
_NAV = rf"(?is)<nav\b{_INSIDE}>|</nav\s*>"
ATTRIBUTE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute in the inside of a start tag; null when it is absent or bare.
    Attributes are read one after the other, so text in another one's value is not taken for one."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)
    at = F.array_position(names, name).cast("int")
    found = F.when(at > 0, F.get(values, at - 1))
    return F.when(found != "", F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2"))


def start_tag(html: Column, tag: str) -> Column:
    """Insides of the start tags of an element, in page order."""
    visible = F.regexp_replace(html, _HIDDEN, " ")
    return F.regexp_extract_all(visible, F.lit(rf"(?is)<{tag}\s({_INSIDE})>"), 1)


def anchors(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every link of a page: resolved URL (query kept), text, rel, aria-label, class, whether it stands
    in a ``nav`` block, position. Columns named in ``keep`` go along."""
    visible = F.regexp_replace("body", _HIDDEN, " ")
    tokens = F.regexp_extract_all(visible, F.lit(f"{_NAV}|{_ANCHOR}"), 0)

    def places(pattern: str) -> Column:
        at = F.transform("_tokens", lambda t, i: F.when(t.rlike(pattern), i))
        return F.array_compact(at)

    paged = captures.select(
        "source_id", "scan_run_id", "seq", *keep, F.col("url").alias("page_url"), tokens.alias("_tokens"),
    ).withColumns({"_opens": places("(?i)^<nav"), "_closes": places("(?i)^</nav")})
    listed = paged.select(
        "source_id", "scan_run_id", "seq", *keep, "page_url", "_opens", "_closes",
        F.posexplode("_tokens").alias("_place", "_a"),
    )
    opened = F.size(F.filter("_opens", lambda p: p < F.col("_place")))
    closed = F.size(F.filter("_closes", lambda p: p < F.col("_place")))
    listed = listed.where(F.col("_a").rlike(r"(?i)^<a\s")).select(
        "source_id", "scan_run_id", "seq", *keep, "page_url",
        (F.col("_place") - opened - closed).alias("position"), (opened > closed).alias("in_nav"), "_a",
    )
    parsed = with_unescaped(
        listed.withColumn("_in", F.regexp_extract("_a", _OPEN, 1)),
        {
            "href": attribute(F.col("_in"), "href"),
            "text": strip_markup(F.regexp_extract("_a", _INNER, 1)),
        },
        twice=("text",),
    )
    inside = F.col("_in")
    found = parsed.select(
        "source_id", "scan_run_id", "seq", *keep, "page_url", "position", "href",
        collapse_ws(F.col("text")).alias("text"),
        F.lower(attribute(inside, "rel")).alias("rel"),
        F.lower(attribute(inside, "aria-label")).alias("aria_label"),
        attribute(inside, "class").alias("class"),
        "in_nav",
        canonicalize_url(F.col("href"), F.col("page_url"), keep_query=True).alias("url"),
    )
    return settle(found, F.length("href") > 0)


def _without_query(url: Column) -> Column:
    return canonicalize_url(url)


def extract_links(
    links: DataFrame,
    detail_regex: str,
    source_url: Column,
    allowed_paths: Column,
    id_group: int = 0,
    keep: tuple[str, ...] = (),
    by_platform: dict[str, tuple[str, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Job links among a page's anchors, and off-host counts per page.

    A job link's path matches ``detail_regex``; ``id_group`` names the group that holds the
    external id (0: none). With ``by_platform`` both come from the row's ``platform``.
    """
    plain = _without_query(F.col("url"))
    path = url_path(F.col("url"))
    rules = by_platform or {"": (detail_regex, id_group)}
    hit, external = F.lit(False), F.lit(None).cast("string")
    for platform, (pattern, group) in rules.items():
        own = F.col("platform") == platform if by_platform else F.lit(True)
        hit = hit | (own & path.rlike(pattern))
        if group:
            external = F.when(own, blank_to_null(F.regexp_extract(path, pattern, group))).otherwise(external)
    hits = settle(
        links.select(*[plain.alias(c) if c == "url" else F.col(c) for c in links.columns]), hit
    )
    marked = hits.withColumn("_ok", in_scope(F.col("url"), source_url, allowed_paths))
    jobs = marked.where("_ok").select(
        "source_id", "scan_run_id", "seq", *keep, "position", external.alias("external_id"), "url",
        F.col("text").alias("title"),
    )
    rejected = (
        marked.where(~F.col("_ok"))
        .groupBy("scan_run_id", F.col("page_url").alias("url"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("code", F.lit("off_host_links_ignored"))
    )
    return jobs, rejected


def is_next(links: DataFrame) -> Column:
    marked = F.coalesce(links["rel"] == "next", F.lit(False))
    return marked | F.coalesce(links["aria_label"].contains("next"), F.lit(False))


def paging_item(links: DataFrame) -> Column:
    """A link of the class that one platform gives to its page numbers."""
    return F.coalesce(F.array_contains(F.split("class", r"\s+"), "paginationItem"), F.lit(False))


def nav_page(links: DataFrame) -> Column:
    """A link to a page number inside a navigation block."""
    return links["in_nav"] & links["href"].contains("page=")


def extract_next_links(
    links: DataFrame, source_url: Column, allowed_paths: Column, also: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Distinct allowed next pages in page order, and counts of rejected ones. ``also`` is what a
    site's own selector marks as a next page besides the usual marks."""
    chosen = is_next(links) if also is None else is_next(links) | F.coalesce(also, F.lit(False))
    marked = links.where(chosen).withColumn(
        "_ok", in_scope(F.col("url"), source_url, allowed_paths)
    )
    allowed = (
        marked.where("_ok")
        .groupBy("source_id", "scan_run_id", "page_url", F.col("url").alias("next_url"))
        .agg(F.min("position").alias("position"))
    )
    rejected = (
        marked.where(~F.col("_ok"))
        .groupBy("scan_run_id", F.col("page_url").alias("url"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("code", F.lit("unsafe_pagination_ignored"))
    )
    return allowed, rejected


def _page_number(url: Column, parameter: str) -> Column:
    """Offset a page URL stands for; null when the parameter is not a number."""
    return F.coalesce(query_param(url, parameter), F.lit("0")).try_cast("int")


def _next_page(pages: DataFrame, offset: Column, due: Column, parameter: str, fixed: dict[str, str]) -> DataFrame:
    values = F.create_map(
        F.lit(parameter), F.col("_next").cast("string"),
        *[F.lit(x) for pair in fixed.items() for x in pair],
    )
    found = pages.withColumn("_next", offset).where(due)
    return found.select(
        "source_id", "scan_run_id", "page_url",
        canonicalize_url(replace_query(F.col("page_url"), values), keep_query=True).alias("next_url"),
        F.lit(None).cast("int").alias("position"),
    )


def counted_next_pages(
    pages: DataFrame, parameter: str = "from", fixed: dict[str, str] | None = None
) -> DataFrame:
    """Next page of listings that state their total and page size (``total``, ``page_size``)."""
    offset = _page_number(F.col("page_url"), parameter) + F.col("page_size")
    due = (F.col("page_size") > 0) & (F.col("_next") < F.col("total"))
    return _next_page(pages, offset, due, parameter, fixed or {})


def full_next_pages(pages: DataFrame, page_size: int, parameter: str = "start") -> DataFrame:
    """Next page of listings without a total: there is one as long as a page is full
    (``items``)."""
    offset = _page_number(F.col("page_url"), parameter) + page_size
    due = (F.col("items") >= page_size) & F.col("_next").isNotNull()
    return _next_page(pages, offset, due, parameter, {})


def union_next_pages(linked: DataFrame, generated: DataFrame) -> DataFrame:
    """Next pages found as links and by arithmetic, each once; a link's place wins."""
    both = linked.unionByName(generated)
    return both.groupBy("source_id", "scan_run_id", "page_url", "next_url").agg(
        F.min("position").alias("position")
    )


# --- ATS-A and ATS-H listings -----------------------------------------------------------

# Fixed value: the path of a job page.
_A_DETAIL = r"(?i)/JobDetail/(?:[^/]+/)*([0-9]+)(?:/|$)"


def ats_a_listing(links: DataFrame, source_url: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Classified links of an ATS-A page: ``job``, ``next`` or ``rejected``."""
    path = url_path(F.col("url"))
    is_job = path.rlike(_A_DETAIL)
    same = same_https_host(F.col("url"), source_url)
    paging = is_next(links) | (path.contains("SearchJobs") & (url_query(F.col("url")) != ""))
    kind = (
        F.when(is_job, F.when(same, "job").otherwise("rejected"))
        .when(paging, F.when(same & path.contains("/careers/SearchJobs"), "next").otherwise("rejected"))
    )
    return links.select(
        "source_id", "scan_run_id", "seq", *keep, "page_url", "position", kind.alias("kind"),
        F.when(is_job, F.regexp_extract(path, _A_DETAIL, 1)).alias("external_id"),
        F.when(is_job, _without_query(F.col("url"))).otherwise(F.col("url")).alias("url"),
        F.col("text").alias("title"),
    ).where(F.col("kind").isNotNull())


def ats_h_listing(links: DataFrame, client_id: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Classified links of an ATS-H page: ``job``, ``next`` or ``rejected``."""
    job_id = query_param(F.col("url"), "jid")
    allowed = client_link_allowed(F.col("url"), client_id)
    kind = F.when(
        job_id.isNotNull(), F.when(allowed, "job").otherwise("rejected")
    ).when(is_next(links), F.when(allowed, "next").otherwise("rejected"))
    return links.select(
        "source_id", "scan_run_id", "seq", *keep, "page_url", "position", kind.alias("kind"),
        job_id.alias("external_id"), "url", F.col("text").alias("title"),
    ).where(F.col("kind").isNotNull())


# --- landing pages ----------------------------------------------------------------------


def discover_coordinates(captures: DataFrame) -> DataFrame:
    """API or embed coordinates that landing pages expose, with the safety verdict.

    ``captures``: source_id, url, platform (oracle_ce or hirebridge), body.
    """
    bases = F.filter(
        start_tag(F.col("body"), "base"),
        lambda t: t.rlike(r"(?i)\bdata-apibaseurl\s*=") & t.rlike(r"(?i)\bdata-sitenumber\s*="),
    )
    frames = F.filter(
        start_tag(F.col("body"), "iframe"),
        lambda t: t.rlike(r"""(?is)(?:^|\s)src\s*=\s*["']?[^"'\s]*hirebridge\.com"""),
    )
    found = captures.withColumns(
        {
            "_base": F.get(bases, F.lit(0)),
            "_frame": F.get(frames, F.lit(0)),
        }
    )
    staged = with_unescaped(
        found,
        {
            "_api": attribute(F.col("_base"), "data-apibaseurl"),
            "_src": attribute(F.col("_frame"), "src"),
        },
    ).withColumn("_site", F.trim(attribute(F.col("_base"), "data-sitenumber")))
    api = F.regexp_replace(canonicalize_url(F.col("_api")), "/+$", "")
    embed = canonicalize_url(F.col("_src"), F.col("url"), keep_query=True)
    named = staged.withColumns({"_api": api, "_embed": embed})
    verdict = safe_embed(F.col("_embed"))
    is_o, is_h = F.col("platform") == "oracle_ce", F.col("platform") == "hirebridge"
    code = (
        F.when(is_o & F.col("_base").isNull(), "oracle_configuration_missing")
        .when(is_o, safe_api(F.col("_api"), F.col("_site"), F.col("url"), F.col("url")))
        .when(is_h & F.col("_frame").isNull(), "hirebridge_embed_missing")
        .when(is_h, verdict["error_code"])
    )
    ok = code.isNull()
    return named.select(
        "source_id", "url", "platform",
        F.when(is_o & ok, F.col("_api")).alias("api_base_url"),
        F.when(is_o & ok, F.col("_site")).alias("site_number"),
        F.when(is_h & ok, F.col("_embed")).alias("embed_url"),
        F.when(is_h & ok, verdict["client_id"]).alias("client_id"),
        code.alias("error_code"),
    )
