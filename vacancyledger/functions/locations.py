"""Location, description and identifier rendering shared by the platform readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import TAG_IN_TEXT, blank_to_null, let, not_blank, settle, strip_ws, with_unescaped

# Address parts in display order.
LD_ADDRESS_FIELDS = (
    "streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry",
)
O_LOCATION_FIELDS = (
    "LocationName", "Name", "AddressLine1", "TownOrCity", "City",
    "Region2", "State", "PostalCode", "Country",
)


def _text(variant: Column, path: str) -> Column:
    return blank_to_null(F.try_variant_get(variant, path, "string"))


def variant_field(variant: Column, name: str) -> Column:
    """A member of an object, null for a JSON null."""
    value = F.try_variant_get(variant, f"$.{name}", "variant")
    return let(value, lambda v: F.when(~F.is_variant_null(v), v))


def variant_kind(variant: Column) -> Column:
    """OBJECT, ARRAY or a scalar type name."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^([A-Z]+)", 1)


def as_variants(variant: Column) -> Column:
    """A JSON list as an array; any other value as a one-element array."""
    listed = F.try_variant_get(variant, "$", "array<variant>")
    single = F.when(variant.isNotNull() & ~F.is_variant_null(variant), F.array(variant))
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.when(variant_kind(variant) == "ARRAY", listed), single, empty)


def _ld_address(entry: Column) -> Column:
    address = F.try_variant_get(entry, "$.address", "variant")
    holder = F.when(address.isNotNull(), address).otherwise(entry)
    parts = []
    for name in LD_ADDRESS_FIELDS:
        value = F.try_variant_get(holder, f"$.{name}", "variant")
        # A country given as an object is shown by its name.
        is_object = variant_kind(value) == "OBJECT"
        parts.append(
            F.when(is_object, _text(holder, f"$.{name}.name")).otherwise(_text(holder, f"$.{name}"))
        )
    rendered = blank_to_null(F.concat_ws(", ", *parts))
    # An address given as text is used as it stands.
    is_text = variant_kind(holder) == "STRING"
    return F.when(is_text, F.try_variant_get(holder, "$", "string")).when(
        variant_kind(holder) == "OBJECT", rendered
    )


def render_ld_locations(job_location: Column) -> Column:
    """Display strings of a schema.org ``jobLocation`` value (object or list of objects)."""
    entries = F.filter(as_variants(job_location), lambda e: variant_kind(e) == "OBJECT")
    return F.array_compact(F.transform(entries, _ld_address))


def render_o_location(value: Column) -> Column:
    """Display string of one ATS-O location: text, or an object whose nested address wins."""
    nested_upper = F.try_variant_get(value, "$.Address", "variant")
    nested = F.when(
        nested_upper.isNotNull() & ~F.is_variant_null(nested_upper), nested_upper
    ).otherwise(F.try_variant_get(value, "$.address", "variant"))
    parts = []
    for name in O_LOCATION_FIELDS:
        inner = F.try_variant_get(nested, f"$.{name}", "variant")
        parts.append(
            F.when(inner.isNotNull(), _text(nested, f"$.{name}")).otherwise(_text(value, f"$.{name}"))
        )
    joined = F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ", ")
    as_text = strip_ws(F.try_variant_get(value, "$", "string"))
    return blank_to_null(
        F.when(variant_kind(value) == "STRING", as_text).when(
            variant_kind(value) == "OBJECT", joined
        )
    )


def escape_html(col: Column) -> Column:
    out = col
    # The ampersand first, so that later references stay intact.
    for raw, reference in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(reference))
    return out


def with_description_html(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a description, unescaped only when that brings tags to light; blank becomes null."""
    raw = settle(df.withColumn("_raw", value))
    staged = with_unescaped(raw, {"_decoded": F.col("_raw")})
    shown = F.when(F.col("_decoded").rlike(TAG_IN_TEXT), F.col("_decoded")).otherwise(F.col("_raw"))
    return staged.withColumn(
        name, F.when(not_blank(F.col("_raw")), shown)
    ).drop("_raw", "_decoded")


def paragraph_html(col: Column) -> Column:
    """The value if it holds tags, else one escaped paragraph; blank becomes null."""

    def shown(v: Column) -> Column:
        plain = F.concat(F.lit("<p>"), escape_html(v), F.lit("</p>"))
        return F.when(F.length(strip_ws(v)) > 0, F.when(v.rlike(TAG_IN_TEXT), v).otherwise(plain))

    return let(col, shown)


def sections_html(sections: Iterable[tuple[str | None, Column]]) -> Column:
    """Concatenate titled sections; blank ones are left out."""
    parts = []
    for heading, col in sections:
        body = paragraph_html(col)
        parts.append(
            F.concat(F.lit(f"<h2>{heading}</h2>"), body) if heading else body
        )
    return blank_to_null(F.concat_ws("", *parts))


def coerce_identifier(value: Column) -> Column:
    """Identifier given as a scalar, or as an object with a value or a name."""

    def read(v: Column) -> Column:
        inner = F.coalesce(_text(v, "$.value"), _text(v, "$.name"))
        return F.when(variant_kind(v) == "OBJECT", inner).otherwise(_text(v, "$"))

    return let(value, read)


def coerce_employment(value: Column) -> Column:
    """Employment type given as text or as a list of texts."""

    def read(v: Column) -> Column:
        listed = F.try_variant_get(v, "$", "array<string>")
        return F.when(variant_kind(v) == "ARRAY", F.array_join(listed, ", ")).otherwise(
            F.try_variant_get(v, "$", "string")
        )

    return let(value, read)


def identity_key(external_id: Column, url: Column) -> Column:
    """``external:<id>`` when the posting carries an id, else ``url:<url>``."""
    return F.when(
        F.length(external_id) > 0, F.concat(F.lit("external:"), strip_ws(external_id))
    ).otherwise(F.concat(F.lit("url:"), url))
