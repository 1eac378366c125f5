"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacancyledger.llm import common, mixing, packing, pii, quality, simhash
from vacancyledger.session import configure


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality classifier on the labels and drop the documents it rejects."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    configure(spark)
    return simhash.deduplicated(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and e-mail names become pseudonyms of the same format."""
    configure(spark)
    return pii.pseudonymised(docs, found=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; documents repeat as the mix takes them."""
    configure(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024 tokens."""
    configure(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", pseudonymise),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the fingerprints have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
