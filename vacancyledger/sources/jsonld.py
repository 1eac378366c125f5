"""schema.org JobPosting blocks and objects assigned in page scripts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_iso_date
from ..functions.locations import (
    coerce_employment, coerce_identifier, render_ld_locations, variant_field, variant_kind,
    with_description_html,
)
from ..functions.text import blank_to_null, settle, slug, strip_long
from ..functions.urls import canonicalize_url, in_scope, template_url

_LD_SCRIPT = (
    r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
)


@F.pandas_udf(T.StructType().add("posting", T.StringType()).add("malformed", T.IntegerType()))
def _first_posting(scripts: pd.Series) -> pd.DataFrame:
    """First JobPosting node, in document order, of the first block that holds one."""

    def walk(value):
        pending = [value]
        while pending:
            node = pending.pop()
            if isinstance(node, dict):
                kind = node.get("@type")
                if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind):
                    return node
                pending.extend(reversed(node.values()))
            elif isinstance(node, list):
                pending.extend(reversed(node))
        return None

    def pick(blocks):
        malformed = 0
        if blocks is None:
            return None, 0
        for block in blocks:
            try:
                node = walk(json.loads(block))
            except ValueError:
                malformed += 1
                continue
            if node is not None:
                return json.dumps(node, ensure_ascii=False), malformed
        return None, malformed

    return pd.DataFrame([pick(b) for b in scripts], columns=["posting", "malformed"])


def extract_jobposting(captures: DataFrame) -> DataFrame:
    """Add the posting object as a variant, and an error code when there is none.

    A first block that is itself a JobPosting is read in the JVM; only other pages with blocks
    (graphs, lists, wrappers, broken JSON) reach Python.
    """
    blocks = captures.withColumn(
        "_blocks", F.regexp_extract_all("body", F.lit(_LD_SCRIPT), 1)
    ).withColumn("_first", F.try_element_at("_blocks", F.lit(1))).withColumn("_head", strip_long(F.col("_first")))
    parsed = blocks.withColumn(
        "_direct", F.when(F.col("_head").rlike(r"(?s)^\{.*\}$"), F.try_parse_json("_head"))
    )
    kind = F.try_variant_get("_direct", "$.@type", "string")
    kinds = F.try_variant_get("_direct", "$.@type", "array<string>")
    is_posting = (kind == "JobPosting") | F.coalesce(
        F.array_contains(kinds, "JobPosting"), F.lit(False)
    )
    direct = parsed.withColumn("_is", F.coalesce(is_posting, F.lit(False)))
    rest = direct.withColumn(
        "_walk", _first_posting(F.when(~F.col("_is") & (F.size("_blocks") > 0), F.col("_blocks")))
    )
    posting = F.when(F.col("_is"), F.col("_direct")).otherwise(F.try_parse_json("_walk.posting"))
    code = F.when(
        F.col("posting").isNull(),
        F.when(F.col("_walk.malformed") > 0, "malformed_jsonld").otherwise("missing_jsonld"),
    )
    kept = [c for c in captures.columns if c != "body"]
    named = rest.select(*kept, posting.alias("posting"), "_walk")
    return settle(named.select(*kept, "posting", code.alias("error_code")))


def posting_fields(extracted: DataFrame, platform: str | Column, whole: bool = False) -> DataFrame:
    """Detail rows from JobPosting objects. Rows without one are dropped, unless ``whole``, which also
    keeps the other columns and the date as written (``posted``)."""
    platform = F.lit(platform) if isinstance(platform, str) else platform
    p = F.col("posting")

    def text(name: str) -> Column:
        return blank_to_null(F.try_variant_get(p, f"$.{name}", "string"))

    identifier = coerce_identifier(variant_field(p, "identifier"))
    description = variant_field(p, "description")
    is_text = variant_kind(description) == "STRING"
    found = with_description_html(
        extracted if whole else extracted.where(p.isNotNull()), "description_html",
        F.when(is_text, F.try_variant_get(p, "$.description", "string")),
    )
    kept = [c for c in extracted.columns if c not in ("url", "posting")] if whole else ["source_id", "scan_run_id", "seq"]
    kept += [text("datePosted").alias("posted")] if whole else []
    return found.select(
        *kept, F.col("url").alias("capture_url"),
        identifier.alias("external_id"),
        text("url").alias("url"),
        text("title").alias("title"),
        render_ld_locations(variant_field(p, "jobLocation")).alias("locations"),
        coerce_employment(variant_field(p, "employmentType")).alias("employment_type"),
        parse_iso_date(text("datePosted")).alias("posted_date"),
        "description_html",
        F.create_map(
            F.lit("source"), platform, F.lit("identifier"), identifier,
            F.lit("date_modified"), text("dateModified"),
        ).alias("metadata"),
    )


# --- objects in page scripts ------------------------------------------------------------


def embedded_object(body: Column, marker: str) -> Column:
    """JSON object that follows a marker in a page script, as a variant; null if there is none."""
    after = F.when(body.contains(marker), F.substring_index(body, marker, 1))
    rest = F.substring(body, F.length(after) + len(marker) + 1, F.length(body))
    opening = F.instr(rest, "{")
    tail = F.substring(rest, opening, F.length(rest))
    return F.try_parse_json(F.when(after.isNotNull() & (opening > 0), tail))


def nested(value: Column, path: list[str]) -> Column:
    """Member below a path of names."""
    return F.try_variant_get(value, "$" + "".join(f".{p}" for p in path), "variant")


def embedded_counts(value: Column, total_path: list[str], size_path: list[str]) -> Column:
    return F.struct(
        F.try_variant_get(nested(value, total_path), "$", "int").alias("total"),
        F.try_variant_get(nested(value, size_path), "$", "int").alias("page_size"),
    )


def extract_embedded_jobs(
    captures: DataFrame,
    marker: str,
    jobs_path: list[str],
    detail_template: str,
    source_url: Column,
    allowed_paths: Column,
    route_field: str = "jobSeqNo",
    id_field: str = "reqId",
    title_field: str = "title",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Listing entries held by an object in the page script, in listed order."""
    listed = captures.select(
        "source_id", "scan_run_id", "seq", *keep, F.col("url").alias("page_url"),
        F.posexplode(
            F.try_variant_get(
                nested(embedded_object(F.col("body"), marker), jobs_path), "$", "array<variant>"
            )
        ).alias("position", "_job"),
    )

    def text(name: str) -> Column:
        return blank_to_null(F.try_variant_get("_job", f"$.{name}", "string"))

    entries = listed.select(
        "source_id", "scan_run_id", "seq", *keep, "page_url", "position",
        text(route_field).alias("_route"), text(id_field).alias("external_id"),
        text(title_field).alias("title"),
    ).where(F.col("_route").isNotNull() & F.col("title").isNotNull())
    template = F.lit(detail_template) if isinstance(detail_template, str) else detail_template
    path = template_url(template, F.col("_route"), slug(F.col("title")))
    placed = entries.withColumn("url", canonicalize_url(path, F.col("page_url")))
    return placed.where(in_scope(F.col("url"), source_url, allowed_paths)).select(
        "source_id", "scan_run_id", "seq", *keep, "position", "external_id", "url", "title"
    )
