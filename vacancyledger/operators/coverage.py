"""Did a scan see everything? Paging, loops, reachability, facets, previews, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .windows import numbered, top_k, with_next

PREVIEW_JOBS = 5
#: Pages whose links one task puts in order.
CHUNK_PAGES = 1024


def page_signatures(items: DataFrame) -> DataFrame:
    """Order-sensitive signature of each result page, as two 64-bit sums over its positions, so
    that a page of any size is reduced before the shuffle. ``items``: scan_run_id, page,
    position, item_id."""
    return items.groupBy("scan_run_id", "page").agg(
        F.count(F.lit(1)).alias("items"),
        F.bit_xor(F.xxhash64("position", "item_id")).alias("sig_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), "item_id", "position")).alias("sig_b"),
    )


def repeated_pages(signed: DataFrame, signature: list[str]) -> DataFrame:
    """Non-empty pages whose signature an earlier page of the scan already had."""
    shape = ["scan_run_id", "items", *signature]
    firsts = signed.where(F.col("items") > 0).groupBy(*shape).agg(
        F.min("page").alias("first_page"), F.count(F.lit(1)).alias("times")
    )
    repeated = firsts.where(F.col("times") > 1)
    return (
        signed.join(repeated, shape)
        .where(F.col("page") > F.col("first_page"))
        .select("scan_run_id", "page", "first_page", "items")
    )


def page_loops(items: DataFrame) -> DataFrame:
    """Pages that repeat an earlier page of their scan item by item."""
    return repeated_pages(page_signatures(items), ["sig_a", "sig_b"])


def listing_signature(ids: Column) -> Column:
    """Signature of one captured page whose item ids are already in the row."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: F.coalesce(i, F.lit("\x1e"))), "\x1f"), 256)


def listing_coverage(pages: DataFrame) -> DataFrame:
    """Items received against the advertised total per scan, and whether the stop condition
    (last page reached or an empty page) was met. ``pages``: scan_run_id, page_offset, items,
    total."""
    n, total = F.col("items"), F.col("total")
    ends = (F.col("page_offset") + n >= total) | (n == 0)
    return pages.groupBy("scan_run_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("items").cast("long").alias("received"),
        F.max("total").cast("long").alias("advertised"),
        F.max(ends).alias("reached_end"),
    ).withColumn("complete", F.col("reached_end") & (F.col("received") >= F.col("advertised")))


def next_offsets(pages: DataFrame, page_size: int, chunk: Column) -> DataFrame:
    """Pages whose successor is not at the offset it should be at: ``expected_offset`` follows
    from the page, ``next_offset`` is what was fetched (null if nothing was)."""
    ordered = with_next(pages, ["scan_run_id"], ["page_offset"], chunk, ["page_offset"])
    expected = F.col("page_offset") + page_size
    due = F.when(expected < F.col("total"), expected)
    return (
        ordered.withColumn("expected_offset", due)
        .withColumnRenamed("next_page_offset", "next_offset")
        .where(
            F.col("expected_offset").isNotNull()
            & ~F.col("expected_offset").eqNullSafe(F.col("next_offset"))
        )
    )


def crawl_coverage(
    starts: DataFrame, links: DataFrame, max_pages: int
) -> tuple[DataFrame, DataFrame]:
    """Pages reachable from each source's listing page, in the order a crawl visits them.

    ``starts``: source_id, url. ``links``: source_id, url, position, next_url. Pages are visited level
    by level, within a level in the order in which they were first found. Returns the pages with
    depth and place in their level, and per source the reachable and visited counts, loop links (to a
    page that was visited before, or to itself) and whether the page limit was met. One job per level,
    until no new page is found; levels are checkpointed to the shared folder.
    """
    ensure_checkpoint_dir(starts.sparkSession)
    # Every level reads the links again, so they are computed once; a repeated link counts once.
    edges = links.groupBy("source_id", "url", "next_url").agg(F.min("position").alias("position")).checkpoint()
    frontier = starts.select(
        "source_id", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place")
    ).checkpoint()
    visited, depth = frontier, 0
    while True:
        depth += 1
        reached = (
            frontier.join(edges, ["source_id", "url"])
            .groupBy("source_id", F.col("next_url").alias("url"))
            .agg(F.min(F.struct("place", "position")).alias("_from"))
            .join(visited.select("source_id", "url"), ["source_id", "url"], "left_anti")
        )
        # Chunks of the level before, so that a source with most of the pages is numbered by many tasks.
        chunk = F.floor(F.col("_from.place") / CHUNK_PAGES)
        order = [F.col("_from.place"), F.col("_from.position")]
        frontier = numbered(reached, ["source_id"], order, chunk, "place").select(
            "source_id", "url", F.lit(depth).alias("depth"), "place"
        ).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    levels = visited
    own = F.struct("depth", "place")
    target = levels.select("source_id", F.col("url").alias("next_url"), own.alias("_next"))
    loops = (
        edges.join(levels.select("source_id", "url", own.alias("_own")), ["source_id", "url"])
        .join(target, ["source_id", "next_url"])
        .where(F.col("_next") <= F.col("_own"))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("loop_links"))
    )
    counts = levels.groupBy("source_id").agg(F.count(F.lit(1)).alias("reachable"))
    summary = counts.join(loops, "source_id", "left").select(
        "source_id",
        "reachable",
        F.least(F.col("reachable"), F.lit(max_pages)).alias("visited"),
        F.coalesce("loop_links", F.lit(0)).cast("long").alias("loop_links"),
        (F.col("reachable") > max_pages).alias("page_limit_reached"),
    )
    return levels, summary


def warning_counts(warnings: DataFrame, once: tuple[str, ...] = ("robots_unavailable",)) -> DataFrame:
    """Warnings per scan, code and URL, with the count that each carries (``n``; null: 1); codes in
    ``once`` count one time per scan."""
    single = F.col("code").isin(*once)
    keyed = warnings.select(
        "scan_run_id", "code", F.when(single, F.lit(None)).otherwise(F.col("url")).alias("url"),
        F.coalesce("n", F.lit(1)).alias("n"),
    )
    counted = keyed.groupBy("scan_run_id", "code", "url").agg(F.sum("n").alias("n"))
    return counted.withColumn("n", F.when(single, F.lit(1)).otherwise(F.col("n")).cast("long"))


def source_preview(listing: DataFrame, k: int = PREVIEW_JOBS) -> DataFrame:
    """The first jobs of each source with its number of listed jobs."""
    counts = listing.groupBy("source_id").agg(F.count(F.lit(1)).alias("job_count"))
    samples = top_k(
        listing.select("source_id", "seq", "title", "url"), ["source_id"],
        [F.col("seq").asc()], k,
    )
    return samples.join(counts, "source_id").select(
        "source_id", "rank", "title", "url", "job_count"
    )


# --- facets -----------------------------------------------------------------------------


def facet_drift(selected: DataFrame, available: DataFrame) -> DataFrame:
    """Saved facets whose label is gone or whose id moved. The last group per parameter counts,
    in it the first value per label.

    ``selected``: source_id, seq, facet_parameter, label, id. ``available``: source_id,
    group_seq, facet_parameter, value_seq, label, id.
    """
    group = ["source_id", "facet_parameter"]
    last = available.groupBy(*group).agg(F.max("group_seq").alias("group_seq"))
    current = (
        available.join(last, [*group, "group_seq"], "left_semi")
        .groupBy(*group, "label")
        .agg(F.min_by(F.struct("id"), F.col("value_seq")).alias("_v"))
        .select(*group, "label", F.col("_v.id").alias("current_id"), F.lit(True).alias("_hit"))
    )
    joined = selected.join(current, [*group, "label"], "left")
    reason = F.when(F.col("_hit").isNull(), "label_missing").when(
        ~F.col("id").eqNullSafe(F.col("current_id")), "id_changed"
    )
    return (
        joined.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("source_id", "seq", "facet_parameter", "label", "id", "reason", "current_id")
    )


def facet_payload(selected: Column) -> Column:
    """Filter payload of a source's saved facets (an array of facet_parameter, id): parameter
    to ids, both in saved order."""
    names = F.array_distinct(F.transform(selected, lambda f: f["facet_parameter"]))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.transform(
                    F.filter(selected, lambda f: f["facet_parameter"] == n), lambda f: f["id"]
                ).alias("value"),
            ),
        )
    )

