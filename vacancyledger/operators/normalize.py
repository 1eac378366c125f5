"""Raw postings to the canonical posting row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locations import identity_key
from ..functions.text import collapse_ws, strip_markup, with_unescaped
from ..functions.urls import canonicalize_url, url_host

# Metadata that survives normalisation.
METADATA_KEYS = ("source", "identifier", "department", "workplace_type", "date_modified")

_FIELD = "\x1f"
_ITEM = "\x1d"
_NULL = "\x1e"


def fingerprint(
    title: Column, locations: Column, employment_type: Column, posted: Column, text: Column
) -> Column:
    """Content hash. Cleaned text holds none of the separators, so distinct content cannot
    collide by concatenation."""
    parts = [
        title,
        F.array_join(locations, _ITEM),
        employment_type,
        F.date_format(posted, "yyyy-MM-dd"),
        text,
    ]
    return F.sha2(F.concat_ws(_FIELD, *[F.coalesce(p, F.lit(_NULL)) for p in parts]), 256)


def normalize(raw: DataFrame) -> DataFrame:
    """Canonical posting columns from raw ones (``external_id, url, title, locations,
    employment_type, posted_date, description_html, metadata``); other columns pass through.
    """
    produced = {
        "external_id", "url", "title", "locations", "employment_type", "posted_date",
        "description_html", "metadata",
    }
    carried = [c for c in raw.columns if c not in produced]
    # A list crosses the entity step as one delimited string: Python cannot run in a lambda.
    safe = F.transform("locations", lambda v: F.replace(v, F.lit(_ITEM), F.lit(" ")))
    resolved = with_unescaped(
        raw,
        {
            "external_id": F.col("external_id"),
            "title": F.col("title"),
            "employment_type": F.col("employment_type"),
            "_places": F.array_join(safe, _ITEM),
            "description_text": strip_markup(F.col("description_html")),
        },
        twice=("description_text",),
    )
    places = F.filter(
        F.transform(F.split("_places", _ITEM), collapse_ws), lambda v: v.isNotNull()
    )
    no_places = F.array().cast("array<string>")
    shaped = resolved.select(
        *carried,
        collapse_ws(F.col("external_id")).alias("external_id"),
        canonicalize_url(F.col("url"), keep_query=True).alias("canonical_url"),
        F.coalesce(collapse_ws(F.col("title")), F.lit("Untitled role")).alias("title"),
        F.coalesce(F.array_sort(F.array_distinct(places)), no_places).alias("locations"),
        collapse_ws(F.col("employment_type")).alias("employment_type"),
        "posted_date",
        "description_html",
        collapse_ws(F.col("description_text")).alias("description_text"),
        F.map_filter("metadata", lambda k, _: k.isin(*METADATA_KEYS)).alias("raw_metadata"),
    )
    return shaped.withColumns(
        {
            "content_fingerprint": fingerprint(
                F.col("title"), F.col("locations"), F.col("employment_type"),
                F.col("posted_date"), F.col("description_text"),
            ),
            "identity_key": identity_key(F.col("external_id"), F.col("canonical_url")),
        }
    )


def valid_items(items: DataFrame, scan_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Listing entries with id, title and URL on the source host, and the reject counts."""
    reason = (
        F.when(F.coalesce(F.length("external_id"), F.lit(0)) == 0, "missing_id")
        .when(F.coalesce(F.length("title"), F.lit(0)) == 0, "missing_title")
        .when(F.coalesce(F.length("url"), F.lit(0)) == 0, "missing_url")
        .when(url_host(F.col("url")) != url_host(F.col("source_url")), "off_host")
    )
    marked = items.withColumn("_reject", reason)
    rejects = (
        marked.where(F.col("_reject").isNotNull())
        .groupBy(*scan_keys, F.col("_reject").alias("reason"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
    return marked.where(F.col("_reject").isNull()).drop("_reject"), rejects
