"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, with_positions, written


def word_count(text) -> F.Column:
    """Number of words of a text; null has none."""
    words = F.regexp_count(text, F.lit(WORD))
    return F.coalesce(words, F.lit(0)).cast("long")


def water_filling(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to one row per source (``ord``, ``source_size``, ``weight``).

    The words of all sources are shared out by weight; a source stops at ``max_epochs`` times its
    size and what it cannot take is shared again by weight until no source is above. Sources are
    clamped in the order of (most it may take) / weight: the level that the others reach only rises
    as sources are clamped, so the first source that stays below its clamp fixes the level of all
    after it. This walk takes one pass over a table of one row per source.
    """
    most = F.lit(max_epochs) * F.col("source_size")
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy(most / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    free = most > F.col("weight") * F.col("_level")
    at = F.first(F.when(free, F.col("_level")), ignorenulls=True).over(
        everything.orderBy(most / F.col("weight"), "ord").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    return (
        sources.withColumn("_level", level)
        .withColumn("_at", at)
        .withColumn("target", F.when(free, F.col("weight") * F.col("_at")).otherwise(most).cast("double"))
        .drop("_level", "_at")
    )


def _key(seed: int, *columns) -> F.Column:
    """60 bits of MD5, a hash that SQL engines share; scaled to [0, 2^62)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") * 4


def mixture(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """One row per document with the words the mix takes of it.

    Sources in code point order, null last, weigh ``weights`` in turn. A source's target, rounded to
    whole words, is its budget: every document is taken ``budget div size`` times whole, and the rest
    goes to documents in seeded order, each once more, the last one with as many leading words as
    fill the budget. So a source takes its budget exactly and a document at most ``max_epochs`` times
    its size. Null and empty texts have size 0 and are taken 0 times. Null sources are one source,
    null ids are ids like others. Rows that are equal are documents of their own; their order among
    themselves does not matter, as they are equal. An empty table gives no rows.

    Returns doc_id, source, size, source_size, target, whole (copies), extra (words) and taken.
    """
    sized = columns_of(documents, doc_id="long", source="string", text="string").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    return mix_sized(written(sized, "sizes"), weights, max_epochs, seed)


def mix_sized(sized: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """:func:`mixture` for (doc_id, source, size) and any further columns, which are kept."""
    listed = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = sources.withColumn("ord", F.row_number().over(listed)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") - 1) % len(weights) + 1)
    )
    targets = written(water_filling(sources, max_epochs), "targets")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    rows = (
        sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(budget / size).cast("long"))
        .withColumn("_rest", budget - F.col("whole") * size)
        .withColumn("_key", _key(seed, "doc_id"))
    )
    rows = with_positions(rows, "ord", "_key", ["doc_id", "size"], "n_rows", amount="size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before"))).cast("long")
    return (
        rows.withColumn("extra", extra)
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
        .drop("_source", "_rest", "_key", "_range", "ord", "weight", "n_rows", "position", "before")
    )


def mixed_documents(
    documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0
) -> DataFrame:
    """The rows of the mix: ``documents``, all columns, repeated as :func:`mixture` says.

    A document's partial repetition holds its first ``extra`` words, joined by one space; ``n_chars``,
    where the table has it, is that of the text written. Documents without words, and those taken 0
    times, are left out.
    """
    sized = documents.select(
        F.struct("*").alias("_doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), F.lit(0))
    some = F.array_join(F.slice(words, F.lit(1), F.col("extra").cast("int")), " ")
    rows = (
        mix_sized(sized, weights, max_epochs, seed)
        .withColumn("_times", F.col("whole") + (F.col("extra") > 0).cast("long"))
        .filter("_times > 0 and size > 0")
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .withColumn("_part", (F.col("_nth") > F.col("whole")) & (F.col("extra") < F.col("size")))
        .withColumn("_text", F.when(F.col("_part"), some).otherwise(F.col("_doc.text")))
    )
    made = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.when(F.col("_part"), F.length("_text")).otherwise(F.col("_doc.n_chars"))
    return rows.select(
        *[
            made.get(f.name, F.col("_doc").getField(f.name)).cast(f.dataType).alias(f.name)
            for f in documents.schema.fields
        ]
    )
