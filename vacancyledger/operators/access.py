"""What a landed response means, which URLs may be read, which platform a source runs on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, let, strip_ws
from ..functions.urls import (
    canonicalize_url, i_api_url, query_param, url_host, url_origin, url_path, url_query,
    url_scheme, w_coordinates,
)

# Response classes.
TRANSIENT_STATUSES = (408, 425, 429, 500, 502, 503, 504)
BLOCKED_STATUSES = (401, 403, 406)
CHALLENGE_PHRASES = ("captcha", "verify you are human")


def response_outcome(captures: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Add ``outcome`` (ok or an error code) and ``retryable`` to captures. Challenges are looked
    for in the whole body, or in its first ``head_chars`` characters."""
    status = F.col("status")
    head = F.lower("body" if head_chars is None else F.substring("body", 1, head_chars))
    challenged = F.lit(False)
    for phrase in CHALLENGE_PHRASES:
        challenged = challenged | head.contains(phrase)
    outcome = (
        F.when(status.isNull(), "network_failure")
        .when(status.isin(*TRANSIENT_STATUSES), "transient_http_failure")
        .when(status.isin(*BLOCKED_STATUSES), "access_blocked")
        .when(status >= 400, "http_failure")
        .when(F.coalesce(challenged, F.lit(False)), "access_blocked")
        .otherwise("ok")
    )
    return captures.withColumn("outcome", outcome).withColumn(
        "retryable", F.col("outcome").isin("network_failure", "transient_http_failure")
    )


# --- robots -----------------------------------------------------------------------------


def unquoted(part: Column) -> Column:
    """Percent-decoded text; a plus stays a plus, a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def robots_rules(body: Column, user_agent: str) -> Column:
    """Path rules (path decoded, allow), in file order, that a robots file holds for an agent.

    A group is one or more agent lines and the rules after them, up to a blank line or the next agent
    line after a rule. The first group that names the agent counts, else the first for all agents.
    """
    name = user_agent.split("/")[0].lower()
    none = F.array().cast("array<string>")
    no_rules = F.array().cast("array<struct<path:string,allow:boolean>>")
    no_groups = F.array().cast(
        "array<struct<agents:array<string>,rules:array<struct<path:string,allow:boolean>>>>"
    )

    def field_of(line: Column) -> Column:
        plain = F.regexp_replace(line, "#.*", "")
        stated = plain.contains(":")
        value = F.regexp_replace(plain, "^[^:]*:", "")
        return F.struct(
            (line == "").alias("blank"),
            F.when(stated, F.lower(strip_ws(F.substring_index(plain, ":", 1)))).otherwise("").alias("key"),
            F.regexp_replace(unquoted(strip_ws(value)), r"\?$", "").alias("value"),
        )

    def step(acc: Column, line: Column) -> Column:
        agent, rule = line["key"] == "user-agent", line["key"].isin("allow", "disallow")
        other = line["key"].isin("crawl-delay", "request-rate")
        ends = (acc["state"] == 2) & (line["blank"] | agent)
        fresh = ends | line["blank"]
        state = F.when(fresh, 0).otherwise(acc["state"])
        agents = F.when(fresh, none).otherwise(acc["agents"])
        rules = F.when(fresh, no_rules).otherwise(acc["rules"])
        counts = (state != 0) & (rule | other)
        allow = (line["key"] == "allow") | (line["value"] == "")
        added = F.array(F.struct(line["value"].alias("path"), allow.alias("allow")))
        group = F.array(F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules")))
        return F.struct(
            F.when(agent, 1).when(counts, 2).otherwise(state).alias("state"),
            F.when(agent, F.concat(agents, F.array(F.lower(line["value"])))).otherwise(agents).alias("agents"),
            F.when((state != 0) & rule, F.concat(rules, added)).otherwise(rules).alias("rules"),
            F.when(ends, F.concat(acc["groups"], group)).otherwise(acc["groups"]).alias("groups"),
        )

    def chosen(acc: Column) -> Column:
        last = F.array(F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules")))
        groups = F.when(acc["state"] == 2, F.concat(acc["groups"], last)).otherwise(acc["groups"])

        def first(found: Column) -> Column:
            general = F.filter(found, lambda g: F.array_contains(g["agents"], "*"))
            named = F.filter(
                found,
                lambda g: ~F.array_contains(g["agents"], "*")
                & F.exists(g["agents"], lambda a: F.contains(F.lit(name), a)),
            )
            return F.coalesce(
                F.try_element_at(named, F.lit(1))["rules"], F.try_element_at(general, F.lit(1))["rules"], no_rules
            )

        return let(groups, first)

    start = F.struct(
        F.lit(0).alias("state"), none.alias("agents"), no_rules.alias("rules"), no_groups.alias("groups")
    )
    lines = F.transform(F.split(body, LINE_BREAK), field_of)
    return F.aggregate(lines, start, step, chosen)


def robots_filter(urls: DataFrame, robots: DataFrame, user_agent: str = "*") -> DataFrame:
    """Add ``allowed`` and ``robots_code`` to URLs. ``robots``: one row per origin (origin,
    body); an origin without a row or body is allowed with a warning code. The first rule whose
    path starts the URL's path and query decides, both percent-decoded; a URL meets its origin's
    rules as one array, never as rows."""
    per_origin = robots.select(
        F.lower("origin").alias("_origin"), robots_rules(F.col("body"), user_agent).alias("_rules")
    )
    target = F.concat(
        F.when(url_path(F.col("url")) == "", "/").otherwise(url_path(F.col("url"))),
        F.when(url_query(F.col("url")) != "", F.concat(F.lit("?"), url_query(F.col("url")))).otherwise(""),
    )
    joined = urls.withColumn("_origin", F.lower(url_origin(F.col("url")))).withColumn(
        "_target", unquoted(target)
    ).join(per_origin, "_origin", "left")
    hits = F.filter("_rules", lambda r: F.startswith(F.col("_target"), r["path"]))
    allowed = F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True))
    code = F.when(F.col("_rules").isNull(), "robots_unavailable").when(~allowed, "robots_disallowed")
    return joined.select(*urls.columns, allowed.alias("allowed"), code.alias("robots_code"))


# --- platforms --------------------------------------------------------------------------


@dataclass(frozen=True)
class PlatformRule:
    """Hosts are exact names, or suffixes and parts where marked; rules apply in order."""

    platform: str
    connector: str
    confidence: float
    hosts: tuple[str, ...] = ()
    host_parts: tuple[str, ...] = ()
    host_suffixes: tuple[str, ...] = ()
    path_prefix: str = ""
    defaults: dict[str, str] = field(default_factory=dict)

    def matches(self, host: Column, path: Column) -> Column:
        found = F.lit(False)
        if self.hosts:
            found = found | host.isin(*self.hosts)
        for part in self.host_parts:
            found = found | host.contains(part)
        for suffix in self.host_suffixes:
            found = found | host.endswith(suffix)
        return found & path.startswith(self.path_prefix) if self.path_prefix else found


_HTML = "paginated_html_jsonld"

# Which site runs on which platform, in order of precedence, with default settings.
PLATFORM_RULES = (
    PlatformRule(
        "workday", "workday_cxs", 0.99, host_parts=(".myworkdayjobs.com", ".myworkdaysite.com"),
        defaults={"page_size": "20"},
    ),
    PlatformRule(
        "phenom", _HTML, 0.98, hosts=("jobs.veralto.com",), path_prefix="/global/en",
        defaults={"allowed_paths": "/global/en", "max_pages": "500"},
    ),
    PlatformRule(
        "happydance", _HTML, 0.98, hosts=("careers.box.com",), path_prefix="/en/jobs",
        defaults={"allowed_paths": "/en/jobs", "max_pages": "500"},
    ),
    PlatformRule(
        "phenom_kwiktrip", _HTML, 0.98, hosts=("jobs.kwiktrip.com",), path_prefix="/us/en",
        defaults={
            "allowed_paths": "/us/en", "listing_url": "/us/en/search-results", "max_pages": "500",
        },
    ),
    PlatformRule(
        "phenom_toyota", _HTML, 0.98, hosts=("careers.toyota.com",), path_prefix="/us/en",
        defaults={"allowed_paths": "/us/en", "max_pages": "500"},
    ),
    PlatformRule(
        "eightfold", _HTML, 0.98, hosts=("globalfoundries.eightfold.ai",), path_prefix="/careers",
        defaults={
            "allowed_paths": "/careers", "listing_url": "/careers", "max_pages": "100",
            "page_size": "10",
        },
    ),
    PlatformRule(
        "icims_jibe", "icims_jibe_api", 0.99, hosts=("careers.rivian.com",),
        path_prefix="/careers-home/jobs", defaults={"page_size": "100"},
    ),
    PlatformRule(
        "oracle_ce", "oracle_ce_rest", 0.99, hosts=("careers.honeywell.com",),
        host_suffixes=(".fa.oraclecloud.com",), defaults={"page_size": "100"},
    ),
    PlatformRule(
        "hirebridge", "hirebridge_html", 0.99, hosts=("prgx.com", "www.prgx.com"),
        path_prefix="/company/careers", defaults={"max_pages": "100"},
    ),
    PlatformRule(
        "avature", "avature_html", 0.99, hosts=("bloomberg.avature.net",),
        path_prefix="/careers/SearchJobs", defaults={"max_pages": "100"},
    ),
)


def overlay(defaults: Column, config: Column) -> Column:
    """Defaults overridden by a source's own settings."""
    kept = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(config, k), F.lit(False)))
    return F.when(config.isNull(), defaults).otherwise(F.map_concat(kept, config))


def detect_platform(sources: DataFrame, rules: tuple[PlatformRule, ...] = PLATFORM_RULES) -> DataFrame:
    """Add platform, connector, confidence, evidence, the effective settings and an error code
    for unknown sites. ``sources``: url, config (map or null)."""
    host = url_host(F.col("url"))
    path = F.regexp_replace(url_path(F.col("url")), "/+$", "")
    index = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        index = F.when(rules[i].matches(host, path), F.lit(i)).otherwise(index)
    staged = sources.withColumn("_rule", index)

    def by_rule(value):
        table = F.array(*[value(r) for r in rules])
        return F.try_element_at(table, F.col("_rule") + 1)

    def as_map(rule: PlatformRule) -> Column:
        pairs = [F.lit(x) for kv in rule.defaults.items() for x in kv]
        return F.create_map(*pairs)

    w = w_coordinates(F.col("url"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    derived = (
        F.when(
            F.col("platform") == "workday",
            F.create_map(F.lit("tenant"), w["tenant"], F.lit("site"), w["site"]),
        )
        .when(F.col("platform") == "icims_jibe", F.create_map(F.lit("api_url"), i_api_url(F.col("url"))))
        .when(
            F.col("platform") == "avature",
            F.create_map(F.lit("listing_url"), canonicalize_url(F.col("url"), keep_query=True)),
        )
        .otherwise(empty)
    )
    named = staged.withColumns(
        {
            "platform": by_rule(lambda r: F.lit(r.platform)),
            "connector": by_rule(lambda r: F.lit(r.connector)),
            "confidence": by_rule(lambda r: F.lit(r.confidence)),
            "_defaults": by_rule(as_map),
        }
    )
    broken = (F.col("platform") == "workday") & w["error_code"].isNotNull()
    code = F.when(F.col("_rule").isNull(), "unsupported_source").when(broken, w["error_code"])
    settings = overlay(F.map_concat(F.col("_defaults"), derived), F.col("config"))
    return named.select(
        *sources.columns,
        *[
            F.when(code.isNull(), F.col(c)).alias(c) for c in ("platform", "connector", "confidence")
        ],
        F.when(code.isNull(), F.concat(F.lit("host and path match "), F.col("platform"))).alias(
            "evidence"
        ),
        F.when(code.isNull(), settings).alias("settings"),
        code.alias("error_code"),
    )


# --- coordinates ------------------------------------------------------------------------

EMBED_HOST = "recruit.hirebridge.com"
API_DOMAIN = ".oraclecloud.com"


def safe_embed(embed_url: Column) -> Column:
    """Client id of an embedded ATS-H board, or why it may not be used."""
    client = F.coalesce(query_param(embed_url, "cid"), F.lit(""))
    host_ok = (url_scheme(embed_url) == "https") & (url_host(embed_url) == EMBED_HOST)
    code = F.when(~host_ok, "unsafe_embed_host").when(
        ~client.rlike("^[0-9]+$"), "invalid_hirebridge_client"
    )
    return F.struct(F.when(code.isNull(), client).alias("client_id"), code.alias("error_code"))


def safe_api(
    api_base: Column, site_number: Column, public_url: Column, source_url: Column
) -> Column:
    """Error code of discovered or configured ATS-O coordinates, null when they are safe."""
    unsafe = (
        ~F.coalesce(url_host(api_base).endswith(API_DOMAIN), F.lit(False))
        | ~F.coalesce(site_number.rlike("^[A-Za-z0-9_]+$"), F.lit(False))
        | (url_host(public_url) != url_host(source_url))
    )
    return F.when(unsafe, "unsafe_oracle_configuration")


def same_https_host(candidate: Column, source: Column) -> Column:
    return (url_scheme(candidate) == "https") & (url_host(candidate) == url_host(source))


def client_link_allowed(candidate: Column, client_id: Column) -> Column:
    """ATS-H links must stay on the vendor host and with the same client."""
    return (
        (url_scheme(candidate) == "https")
        & (url_host(candidate) == EMBED_HOST)
        & F.coalesce(query_param(candidate, "cid") == client_id, F.lit(False))
    )
