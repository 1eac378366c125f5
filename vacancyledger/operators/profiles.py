"""Folds over user input: profile patches, seen/dismissed patches, résumé pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .windows import with_previous, with_running_sums


def profile_versions(patches: DataFrame, chunk: Column) -> DataFrame:
    """Version of a profile after every patch: 1, plus one for each patch so far that changed
    some field. ``patches``: profile_id, patch_seq, field, value (one row per patched field)."""
    compared = with_previous(
        patches, ["profile_id", "field"], ["patch_seq"], chunk, ["value"]
    ).withColumn(
        "field_changed",
        ~F.col("value").eqNullSafe(F.coalesce("prev_value", F.when(F.col("is_first"), ""))),
    )
    per_patch = compared.groupBy("profile_id", "patch_seq").agg(
        F.max("field_changed").alias("changed")
    )
    counted = with_running_sums(
        per_patch, ["profile_id"], ["patch_seq"], chunk,
        {"bumps": F.when(F.col("changed"), 1).otherwise(0)},
    )
    return counted.select(
        "profile_id", "patch_seq", "changed", (F.col("bumps") + 1).alias("version")
    )


def user_state_latest(patches: DataFrame) -> DataFrame:
    """Seen and dismissed times per job after all patches; a patch touches only the fields it
    carries. ``patches``: job_id, ts, seq, seen, dismissed."""
    at = F.struct("ts", "seq")

    def last(flag: str) -> Column:
        stamp = F.when(F.col(flag), F.col("ts"))
        return F.max_by(
            F.struct(stamp.alias("at")), F.when(F.col(flag).isNotNull(), at)
        )["at"]

    return patches.groupBy("job_id").agg(
        last("seen").alias("seen_at"), last("dismissed").alias("dismissed_at")
    )


def assemble_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One text per document from its page texts: pages stripped, blank ones dropped, joined by
    a blank line, NUL removed.

    Empty documents are rejected, and so are those above ``max_chars`` where the caller sets a limit;
    sizes are summed first, so that only documents within it are gathered in one row. Documents too
    large for a row stay in ordered page rows (``document_pages``).
    """
    too_large = F.lit(False) if max_chars is None else F.col("chars") > max_chars
    stripped = pages.select("doc_id", "page", strip_ws(F.col("text")).alias("text"))
    usable = stripped.where(F.length("text") > 0)
    sizes = stripped.groupBy("doc_id").agg(
        F.sum(F.length("text").cast("long")).alias("chars"),
        F.sum((F.length("text") > 0).cast("long")).alias("pages"),
    )
    small = sizes.where(~too_large & (F.col("pages") > 0))
    texts = (
        usable.join(small.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
        .select(
            "doc_id",
            strip_ws(
                F.replace(
                    F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"),
                    F.lit("\x00"), F.lit(""),
                )
            ).alias("text"),
        )
    )
    joined = sizes.join(texts, "doc_id", "left")
    error = (
        F.when(too_large, "document_too_large")
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_selectable_text")
    )
    return joined.select(
        "doc_id", "pages",
        F.when(F.length("text") > 0, F.col("text")).alias("text"), error.alias("error_code"),
    )


def document_pages(pages: DataFrame) -> DataFrame:
    """The usable pages of each document as rows (doc_id, page, text), stripped and without NUL: the
    form for documents of any size, as nothing is gathered."""
    text = F.replace(strip_ws(F.col("text")), F.lit("\x00"), F.lit(""))
    return pages.select("doc_id", "page", text.alias("text")).where(F.length("text") > 0)
