"""Named fields of HTML pages, for the two platforms that have no machine-readable form.

Selectors are data. A page is cut into tags and the texts between them; each tag's attributes are read
once, and one walk over the tags with the open elements as its state tells where every element that
matters ends. Fields are the texts inside, and a listing link's fields those of the nearest block around.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date
from ..functions.text import blank_to_null, let, settle, strip_ws, with_unescaped
from .html_pages import ATTRIBUTE

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


@dataclass(frozen=True)
class Selector:
    """Matches an element by tag, id, class, or an attribute that equals or contains a value."""

    tag: str = ""
    css_id: str = ""
    css_class: str = ""
    attr: str = ""
    equals: str = ""
    contains: str = ""

    def matches(self, tag: Column) -> Column:
        """Whether a start tag (see ``_tags``) matches."""
        ok = tag["name"] == self.tag if self.tag else F.lit(True)
        if self.css_id:
            ok = ok & (_value(tag, "id") == self.css_id)
        if self.css_class:
            ok = ok & F.array_contains(F.split(_value(tag, "class"), r"\s+"), self.css_class)
        if self.attr:
            ok = ok & F.array_contains(tag["names"], self.attr)
            value = F.coalesce(_value(tag, self.attr), F.lit(""))
            if self.equals:
                ok = ok & (value == self.equals)
            if self.contains:
                ok = ok & value.contains(self.contains)
        return F.coalesce(ok, F.lit(False))


def _value(tag: Column, name: str) -> Column:
    """Raw value of a tag's attribute; null when it is absent or bare."""
    found = F.get(tag["values"], F.array_position(tag["names"], name).cast("int") - 1)
    return F.when(found != "", F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2"))


# Where the two platforms keep their fields.
ATS_A_FIELDS = {
    "title": (Selector("h1"), Selector(css_class="job-title"), Selector(attr="data-field", equals="title")),
    "description": (
        Selector(css_class="job-description"), Selector(css_id="job-description"),
        Selector(attr="data-field", equals="description"),
    ),
    "description_fallback": (Selector("main"),),
    "location": (
        Selector(css_class="job-location"), Selector(attr="data-field", equals="location"),
        Selector(attr="class", contains="location"),
    ),
    "employment_type": (
        Selector(css_class="employment-type"), Selector(attr="data-field", equals="employment-type"),
    ),
    "posted": (Selector("time", attr="datetime"), Selector(attr="data-field", equals="posted-date")),
}
ATS_H_FIELDS = {
    "title": ATS_A_FIELDS["title"],
    "description": (
        Selector(css_id="JobDescription"), Selector(css_id="job-description"),
        Selector(css_class="job-description"), Selector(attr="data-job-description"),
    ),
    "location": (
        Selector(css_class="location"), Selector(css_class="job-location"),
        Selector(attr="data-field", equals="location"),
    ),
    "employment_type": (
        Selector(css_class="job-type"), Selector(css_class="employment-type"),
        Selector(attr="data-field", equals="employment-type"),
    ),
    "posted": ATS_A_FIELDS["posted"],
}


# A start tag, an end tag, or what holds no elements: comments, declarations, scripts and styles.
_TOKEN = (
    r"""(?s)<!--.*?-->|(?i:<(script|style|template)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?</\1\s*>)"""
    r"""|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
)
_GAP = "\x1f"


def _name(token: Column) -> Column:
    """Name of a tag, null for other tokens; end tags start with a slash."""
    found = F.lower(F.regexp_extract(token, r"^<(/?[a-zA-Z][^\s/>]*)", 1))
    whole = token.rlike(r"(?is)^<(script|style|template)\b")
    return F.when((found != "") & ~whole, found)


def _tags(tokens: Column) -> Column:
    """The start and end tags among the tokens: index ``i``, ``name`` (end tags start with a slash),
    attribute ``names`` and raw ``values``, and whether elements follow inside (``opens``: not for end
    tags, void elements and self-closed ones)."""

    def parsed(token: Column, i: Column) -> Column:
        inside = F.when(token.rlike(r"^<[a-zA-Z][^\s>]*\s"), F.regexp_replace(token, r"(?s)^<[a-zA-Z][^\s/>]*|/?>$", ""))
        none = F.array().cast("array<string>")

        def described(name: Column) -> Column:
            opens = ~name.startswith("/") & ~name.isin(*VOID) & ~token.rlike(r"/\s*>$")
            names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), F.lower)
            return F.struct(
                i.alias("i"), name.alias("name"), opens.alias("opens"), F.coalesce(names, none).alias("names"),
                F.coalesce(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 2), none).alias("values"),
            )

        return let(_name(token), described)

    return F.filter(F.transform(tokens, parsed), lambda t: t["name"].isNotNull())


def _ends(tags: Column, wanted: Column) -> Column:
    """(at, end): the index of the token that ends each element whose start tag is at a ``wanted`` index.

    One walk with the open elements as its state: an end tag closes up to its start, if that is open.
    Elements that stay open, or hold none, are not listed.
    """
    state = "struct<open:array<struct<name:string,at:int>>,done:array<struct<at:int,end:int>>>"

    def step(acc: Column, tag: Column) -> Column:
        open_, done = acc["open"], acc["done"]
        names = F.transform(open_, lambda o: o["name"])
        back = F.array_position(F.reverse(names), F.substr(tag["name"], F.lit(2))).cast("int")

        def closed(n: Column) -> Column:
            ended = F.filter(F.slice(open_, F.size(open_) - n + 1, n), lambda o: F.array_contains(wanted, o["at"]))
            listed = F.transform(ended, lambda o: F.struct(o["at"].alias("at"), tag["i"].alias("end")))
            left = F.slice(open_, F.lit(1), F.size(open_) - n)
            return F.struct(left.alias("open"), F.concat(done, listed).alias("done"))

        opened = F.concat(open_, F.array(F.struct(tag["name"].alias("name"), tag["i"].alias("at"))))
        return (
            F.when(tag["opens"], F.struct(opened.alias("open"), done.alias("done")))
            .when(tag["name"].startswith("/"), let(back, lambda n: F.when(n > 0, closed(n)).otherwise(acc)))
            .otherwise(acc)
        ).cast(state)

    first = F.struct(
        F.array().cast("array<struct<name:string,at:int>>").alias("open"),
        F.array().cast("array<struct<at:int,end:int>>").alias("done"),
    ).cast(state)
    return F.aggregate(tags, first, step, lambda acc: acc["done"])


def _places(tags: Column, selectors: tuple[Selector, ...]) -> Column:
    """Indexes of the start tags that a selector matches, in page order."""

    def fits(tag: Column) -> Column:
        hits = [s.matches(tag) for s in selectors]
        return ~tag["name"].startswith("/") & reduce(lambda one, two: one | two, hits, F.lit(False))

    return F.transform(F.filter(tags, fits), lambda t: t["i"])


def _walked(captures: DataFrame, keep: tuple[str, ...], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Tokens and the texts between them (``_gaps``), tags, the indexes of each of ``places``, and where
    the elements there end (``_ends``)."""
    body = F.coalesce("body", F.lit(""))
    cut = captures.select(
        "source_id", "scan_run_id", "seq", "url", *keep,
        F.regexp_extract_all(body, F.lit(_TOKEN), 0).alias("_tokens"), F.split(body, _TOKEN, -1).alias("_gaps"),
    )
    tagged = settle(cut.withColumn("_tags", _tags(F.col("_tokens"))))
    placed = settle(tagged.withColumns({f"_{n}": of(F.col("_tags")) for n, of in places.items()}))
    wanted = F.array_distinct(F.concat(*[F.col(f"_{n}") for n in places]))
    return settle(placed.withColumn("_wanted", wanted).withColumn("_ends", _ends(F.col("_tags"), F.col("_wanted"))))


def _end(start: Column) -> Column:
    """Index of the token that ends the element at ``start``: the start tag itself if nothing can follow
    inside, the number of tokens if it stays open."""
    known = F.get(F.filter("_ends", lambda e: e["at"] == start), F.lit(0))["end"]
    opens = F.get(F.filter("_tags", lambda t: t["i"] == start), F.lit(0))["opens"]
    return F.when(opens, F.coalesce(known, F.size("_tokens"))).otherwise(start)


def _pieces(start: Column) -> Column:
    """The texts directly and indirectly inside the element at ``start``, joined by a mark."""
    return let(_end(start), lambda end: F.array_join(F.slice("_gaps", start + 2, F.greatest(end - start, F.lit(0))), _GAP))


def _source(start: Column) -> Column:
    """The page's own text from the start tag at ``start`` to the end of its element."""
    tokens, gaps = F.col("_tokens"), F.col("_gaps")

    def cut(end: Column) -> Column:
        last = F.least(end, F.size(tokens) - 1)
        inner = F.transform(
            F.slice(tokens, start + 2, F.greatest(last - start, F.lit(0))),
            lambda token, i: F.concat(F.get(gaps, start + i + 1), token),
        )
        tail = F.when(end > last, F.get(gaps, F.size(tokens))).otherwise("")
        return F.concat(F.get(tokens, start), F.array_join(inner, ""), tail)

    return let(_end(start), cut)


def _shown(pieces: Column) -> Column:
    """Pieces stripped, blank ones dropped, joined by a space."""
    stripped = F.transform(F.split(pieces, _GAP), strip_ws)
    return F.array_join(F.filter(stripped, lambda t: F.length(t) > 0), " ")


def html_fields(
    captures: DataFrame, fields: dict[str, tuple[Selector, ...]], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Field values of detail pages: first title, description, type and date, all locations. Columns
    named in ``keep`` go along.
    """
    names = ("title", "description", "description_fallback", "location", "employment_type", "posted")
    placed = _walked(captures, keep, {n: (lambda tags, n=n: _places(tags, fields.get(n, ()))) for n in names})

    def first(name: str) -> Column:
        return F.get(f"_{name}", F.lit(0))

    def pieces(name: str) -> Column:
        return F.when(first(name).isNotNull(), _pieces(first(name)))

    described = F.coalesce(first("description"), first("description_fallback"))
    dated = F.get(F.filter("_tags", lambda t: t["i"] == first("posted")), F.lit(0))
    posted = let(dated, lambda tag: _value(tag, "datetime"))
    mark = "\x1e"
    texts = with_unescaped(
        placed.withColumn("description", F.when(described.isNotNull(), _source(described))),
        {
            "_title_text": pieces("title"),
            "_type_text": pieces("employment_type"),
            "_places": F.array_join(F.transform("_location", _pieces), mark),
            "posted": posted,
        },
    )
    # Computed here, so that the Python step does not end up inside the expressions below.
    texts = settle(
        texts.select(
            "source_id", "scan_run_id", "seq", *keep, "url", "description", "posted", "_title_text", "_type_text",
            "_places", "_location",
        )
    )
    places = F.when(F.size("_location") > 0, F.transform(F.split("_places", mark), _shown))
    return texts.select(
        "source_id", "scan_run_id", "seq", *keep, "url", _shown(F.col("_title_text")).alias("title"), "description",
        F.coalesce(places, F.array().cast("array<string>")).alias("locations"),
        _shown(F.col("_type_text")).alias("employment_type"), "posted",
    )


CONTAINERS = ("article", "li", "tr", "div")


def html_entries(captures: DataFrame, fields: dict[str, tuple[Selector, ...]]) -> DataFrame:
    """Links of listing pages with location and type from the nearest list item, row, article or block
    around each link: the first element that matches within it, before or after the link."""
    names = ("location", "employment_type")
    link = (Selector("a", attr="href"),)
    places = {n: (lambda tags, n=n: _places(tags, fields[n])) for n in names}
    blocks = (lambda tags: _places(tags, tuple(Selector(c) for c in CONTAINERS)))
    walked = _walked(captures, ("source_url",), {"link": lambda tags: _places(tags, link), "block": blocks, **places})
    spans = settle(walked.withColumn("_spans", F.transform("_block", lambda at: F.struct(at.alias("at"), _end(at).alias("end")))))

    def found(start: Column) -> Column:
        around = F.filter("_spans", lambda s: (s["at"] < start) & (s["end"] > start))
        # Blocks come in page order, so the last one around a link is the nearest.
        nearest = F.try_element_at(around, F.lit(-1))

        def described(block: Column) -> Column:
            def field(name: str) -> Column:
                inside = F.filter(f"_{name}", lambda i: (i > block["at"]) & (i < block["end"]))
                return let(F.get(inside, F.lit(0)), lambda i: F.when(i.isNotNull(), _pieces(i)))

            tag = F.get(F.filter("_tags", lambda t: t["i"] == start), F.lit(0))
            return let(tag, lambda t: F.struct(
                _value(t, "href").alias("_href"), _pieces(start).alias("_text"), F.lower(_value(t, "rel")).alias("rel"),
                F.lower(_value(t, "aria-label")).alias("aria_label"), *[field(n).alias(f"_{n}_text") for n in names],
            ))

        return let(nearest, described)

    listed = settle(spans.withColumn("_found", F.transform("_link", found)).select(
        "source_id", "scan_run_id", "seq", F.col("url").alias("page_url"), "source_url", F.posexplode("_found").alias("position", "_l"),
    ).select("source_id", "scan_run_id", "seq", "page_url", "source_url", "position", "_l.*"))
    texts = settle(with_unescaped(listed, {c: F.col(c) for c in ("_href", "_text", "_location_text", "_employment_type_text")}))
    return texts.select(
        "source_id", "scan_run_id", "seq", "page_url", "source_url", "position",
        F.coalesce("_href", F.lit("")).alias("href"), blank_to_null(_shown(F.col("_text"))).alias("text"),
        blank_to_null(F.col("rel")).alias("rel"), blank_to_null(F.col("aria_label")).alias("aria_label"),
        _shown(F.col("_location_text")).alias("location"), _shown(F.col("_employment_type_text")).alias("employment_type"),
    )


def _details(fields: DataFrame, locations, platform: str, keep: tuple[str, ...]) -> DataFrame:
    usable = F.col("title").isNotNull() & F.col("description").isNotNull()
    own = [] if "platform" in keep else [F.lit(platform).alias("platform")]
    return fields.select(
        "source_id", "scan_run_id", "seq", *keep, F.col("url").alias("capture_url"),
        "title", locations.alias("locations"), "employment_type", "posted",
        parse_iso_date(F.col("posted")).alias("posted_date"),
        F.col("description").alias("description_html"),
        *own,
        F.when(~usable, "malformed_detail").alias("error_code"),
    )


def ats_a_detail(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _details(html_fields(captures, ATS_A_FIELDS, keep), F.col("locations"), "avature", keep)


def ats_h_detail(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    first = F.slice("locations", 1, 1)
    return _details(html_fields(captures, ATS_H_FIELDS, keep), first, "hirebridge", keep)


def with_listing(details: DataFrame, listing: DataFrame) -> DataFrame:
    """Raw postings from usable details; id, location and type fall back to the listing entry.
    ``listing``: scan_run_id, url, external_id, location, employment_type."""
    known = listing.select(
        "scan_run_id", F.col("url").alias("capture_url"), "external_id",
        F.col("location").alias("_location"), F.col("employment_type").alias("_type"),
    )
    joined = details.where(F.col("error_code").isNull()).join(
        known, ["scan_run_id", "capture_url"], "left"
    )
    fallback = F.array_compact(F.array("_location"))
    return joined.select(
        "source_id", "scan_run_id", "seq", "external_id", F.col("capture_url").alias("url"), "title",
        F.when(F.size("locations") > 0, F.col("locations")).otherwise(fallback).alias("locations"),
        F.coalesce("employment_type", "_type").alias("employment_type"),
        "posted_date", "description_html",
        F.create_map(
            F.lit("source"), F.col("platform"), F.lit("identifier"), F.col("external_id")
        ).alias("metadata"),
    )
