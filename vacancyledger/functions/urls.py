"""URL normal form, traversal scope and the small URL templates of the hiring platforms.

Everything is a column expression over RFC 3986 components; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = (
    "ref", "referrer", "source", "src",
    "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
)

# scheme, authority with its slashes, path, query with its mark
_RFC3986 = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_HOST_PORT = r"(?s)^//(?:.*@)?\[?([^\]@]*?)\]?(?::0*([0-9]*))?$"
_SEP = "\x1f"


def _pieces(url: Column) -> Column:
    return F.split(F.regexp_replace(url, _RFC3986, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP)


def url_parts(url: Column) -> Column:
    """Struct of scheme (lower case), authority (with slashes), path and query (with mark)."""
    return let(
        _pieces(url),
        lambda a: F.struct(
            F.lower(F.get(a, F.lit(0))).alias("scheme"),
            F.get(a, F.lit(1)).alias("authority"),
            F.get(a, F.lit(2)).alias("path"),
            F.get(a, F.lit(3)).alias("query"),
        ),
    )


def _host_of(authority: Column) -> Column:
    return F.regexp_replace(F.lower(authority), _HOST_PORT, "$1")


def url_scheme(url: Column) -> Column:
    return F.lower(F.get(_pieces(url), F.lit(0)))


def url_authority(url: Column) -> Column:
    return F.regexp_replace(F.get(_pieces(url), F.lit(1)), "(?s)^.{0,2}", "")


def url_host(url: Column) -> Column:
    return _host_of(F.get(_pieces(url), F.lit(1)))


def url_path(url: Column) -> Column:
    return F.get(_pieces(url), F.lit(2))


def url_query(url: Column) -> Column:
    return F.regexp_replace(F.get(_pieces(url), F.lit(3)), "(?s)^.", "")


def url_origin(url: Column) -> Column:
    return let(url_parts(url), lambda p: F.concat(p["scheme"], F.lit(":"), p["authority"]))


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encode(part: Column) -> Column:
    encoded = F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column, keep_blank: bool = False) -> Column:
    """Decoded ``(k, v)`` pairs in written order; parameters without a value are dropped."""
    pieces = F.split(query, "&")
    if keep_blank:
        kept = F.filter(pieces, lambda p: F.length(p) > 0)
    else:
        kept = F.filter(pieces, lambda p: p.rlike("^[^=]*=."))
    return F.transform(
        kept,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def render_query(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, else null."""
    hits = F.filter(query_pairs(url_query(url)), lambda p: p["k"] == name)
    return F.try_element_at(hits, F.lit(1))["v"]


def _fold_path(path: Column) -> Column:
    rooted = path.startswith("/")

    def push(stack: Column, segment: Column) -> Column:
        poppable = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        shorter = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return (
            F.when(segment.isin("", "."), stack)
            .when((segment == "..") & poppable, shorter)
            .when((segment == "..") & rooted, stack)
            .otherwise(F.concat(stack, F.array(segment)))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push)
    lead = F.when(path.rlike("^//(?!/)"), "//").when(rooted, "/").otherwise("")
    return F.concat(lead, F.array_join(folded, "/"))


def _needs_folding(path: Column) -> Column:
    return path.contains("//") | path.contains("/.") | path.startswith(".")


def normalise_path(path: Column) -> Column:
    """Collapse '//', '.' and '..'; a trailing slash is not kept here. Empty becomes '/'."""
    return (
        F.when(path.isin("", "/"), F.lit("/"))
        .when(_needs_folding(path), _fold_path(path))
        .when(path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1))
        .otherwise(path)
    )


def _canonical_path(path: Column) -> Column:
    """Normalised path that keeps a trailing slash; most paths are already in that form."""
    folded = let(
        _fold_path(path),
        lambda p: F.when(path.endswith("/") & ~p.isin("/", "//"), F.concat(p, F.lit("/"))).otherwise(p),
    )
    return F.when(path == "", F.lit("/")).when(_needs_folding(path), folded).otherwise(path)


def _resolve(ref: Column, base: Column) -> Column:
    """Parts of a reference completed from the parts of its base."""
    own = (ref["authority"] != "") | ((ref["scheme"] != "") & (ref["scheme"] != base["scheme"]))
    joined = (
        F.when(ref["path"] == "", base["path"])
        .when(ref["path"].startswith("/"), ref["path"])
        .otherwise(F.concat(F.regexp_replace(base["path"], "[^/]*$", ""), ref["path"]))
    )
    # The base path of a bare origin is empty; a relative path below it starts at the root.

    def finish(p: Column) -> Column:
        # A reference that ends in a dot segment names a directory.
        folder = (ref["path"] != "") & (ref["path"].isin(".", "..") | p.endswith("/.") | p.endswith("/.."))
        return F.concat(
            F.when(p.startswith("/") | (p == ""), "").otherwise("/"), p,
            F.when(folder, "/").otherwise(""),
        )

    rooted = let(joined, finish)
    inherits = (ref["path"] == "") & (ref["query"] == "")
    return F.struct(
        F.when(ref["scheme"] == "", base["scheme"]).otherwise(ref["scheme"]).alias("scheme"),
        F.when(own, ref["authority"]).otherwise(base["authority"]).alias("authority"),
        F.when(own, ref["path"]).otherwise(rooted).alias("path"),
        F.when(own | ~inherits, ref["query"]).otherwise(base["query"]).alias("query"),
    )


def _netloc(scheme: Column, authority: Column) -> Column:
    """Lower-case host, with its port unless that is absent, zero or the https one."""
    with_port = F.regexp_replace(F.lower(authority), _HOST_PORT, "$1:$2")

    def drop_default(v: Column) -> Column:
        def cut(n: int) -> Column:
            return F.substring(v, F.lit(1), F.length(v) - n)

        return (
            F.when(v.endswith(":"), cut(1))
            .when((scheme == "https") & v.endswith(":443"), cut(4))
            .otherwise(v)
        )

    return let(with_port, drop_default)


def _kept_query(query: Column) -> Column:
    bare = F.regexp_replace(query, "(?s)^.", "")
    pairs = F.array_sort(
        F.filter(query_pairs(bare), lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    )
    rendered = let(
        render_query(pairs), lambda r: F.when(r == "", r).otherwise(F.concat(F.lit("?"), r))
    )
    return F.when(query == "", F.lit("")).otherwise(rendered)


def _render(parts: Column, keep_query: bool) -> Column:
    scheme, authority = parts["scheme"], parts["authority"]
    netloc = _netloc(scheme, authority)
    head = (
        F.when((scheme != "") & (authority != ""), F.concat(scheme, F.lit("://"), netloc))
        .when(scheme != "", F.concat(scheme, F.lit(":")))
        .when(authority != "", F.concat(F.lit("//"), netloc))
        .otherwise("")
    )
    tail = [_kept_query(parts["query"])] if keep_query else []
    return F.concat(head, _canonical_path(parts["path"]), *tail)


def canonicalize_url(url: Column, base: Column | None = None, keep_query: bool = False) -> Column:
    """Normal form of a URL: lower-case scheme and host, no user info, default https port,
    fragment or tracking parameters; path normalised with its trailing slash kept; query
    dropped, or sorted when ``keep_query``."""
    if base is None:
        return let(url_parts(url), lambda p: _render(p, keep_query))
    resolved = let(
        F.struct(url_parts(url).alias("ref"), url_parts(base).alias("base")),
        lambda both: _resolve(both["ref"], both["base"]),
    )
    return let(resolved, lambda p: _render(p, keep_query))


def in_scope(url: Column, source_url: Column, prefixes: Column) -> Column:
    """http(s), same host as the source, path equal to or below an allowed prefix."""

    def below(path: Column) -> Column:
        return F.exists(
            prefixes,
            lambda p: let(
                F.rtrim(p, F.lit("/")),
                lambda q: (path == q) | F.startswith(path, F.concat(q, F.lit("/"))),
            ),
        )

    def test(p: Column) -> Column:
        return (
            p["scheme"].isin("http", "https")
            & (_host_of(p["authority"]) == url_host(source_url))
            & let(normalise_path(p["path"]), below)
        )

    return let(url_parts(url), test)


def replace_query(url: Column, values: Column) -> Column:
    """Set query parameters from a map; existing ones keep their place, new ones are appended."""
    current = F.map_from_entries(query_pairs(url_query(url), keep_blank=True))
    merged = F.map_entries(F.map_concat(current, values))
    pairs = F.transform(merged, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    rendered = render_query(pairs)
    root = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat(root, F.when(rendered != "", F.concat(F.lit("?"), rendered)).otherwise(""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def w_coordinates(url: Column) -> Column:
    """Tenant, site, origin and error code of an ATS-W careers URL."""
    host, parts = url_host(url), path_segments(url)
    first, second, third = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    jobs_host = host.contains(".myworkdayjobs.com")
    site_host = host.contains(".myworkdaysite.com") & ~jobs_host
    recruiting = (F.size(parts) >= 3) & (F.lower(first) == "recruiting")
    tenant = F.when(jobs_host, F.substring_index(host, ".", 1)).when(site_host & recruiting, second)
    site = F.when(jobs_host, first).when(site_host & recruiting, third)
    valid = F.coalesce(F.length(site) > 0, F.lit(False))
    return F.struct(
        F.when(valid, tenant).alias("tenant"),
        F.when(valid, site).alias("site"),
        F.when(valid, url_origin(url)).alias("origin"),
        F.when(~valid, F.lit("invalid_workday_url")).alias("error_code"),
    )


def w_api_url(url: Column) -> Column:
    c = w_coordinates(url)
    return F.concat(c["origin"], F.lit("/wday/cxs/"), c["tenant"], F.lit("/"), c["site"], F.lit("/jobs"))


def i_api_url(url: Column) -> Column:
    return F.concat(url_origin(url), F.lit("/api/jobs"))


def o_detail_url(public_url: Column, job_id: Column) -> Column:
    """Public page of one ATS-O requisition, next to its listing page."""
    path = F.regexp_replace(F.regexp_replace(url_path(public_url), "/+$", ""), "/jobs$", "")
    return canonicalize_url(F.concat(url_origin(public_url), path, F.lit("/job/"), job_id))


def template_url(template: Column, route_id: Column, slug: Column) -> Column:
    """Fill the ``{id}`` and ``{slug}`` places of a detail path template."""
    with_id = F.replace(template, F.lit("{id}"), route_id)
    return F.replace(with_id, F.lit("{slug}"), slug)
