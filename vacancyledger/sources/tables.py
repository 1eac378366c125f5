"""Schemas of the stored tables and their scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POSTING = """
    external_id string, canonical_url string, title string, locations array<string>,
    employment_type string, posted_date date, description_html string,
    description_text string, content_fingerprint string, raw_metadata map<string,string>
"""

SCHEMAS = {
    "captures": """
        source_id string, scan_run_id string, seq bigint, kind string, url string,
        status int, headers map<string,string>, body string
    """,
    "sources": """
        source_id string, company string, url string, platform string, connector_type string,
        config map<string,string>, setup_status string, health_status string,
        monitoring_status string, created_at timestamp, next_scan_at timestamp,
        last_scan_attempt_at timestamp, last_successful_scan_at timestamp
    """,
    "contacts": """
        contact_id string, source_id string, name string, contact_url string, notes string
    """,
    "scans": """
        scan_run_id string, source_id string, scan_seq bigint, trigger string, status string,
        complete boolean, created_at timestamp, started_at timestamp, finished_at timestamp,
        error_code string, warnings array<struct<code:string,message:string,count:bigint,url:string>>
    """,
    "profiles": """
        profile_id string, created_at timestamp, version int, resume_text string,
        target_roles array<string>, adjacent_roles array<string>,
        preferred_locations array<string>, remote_preference string,
        employment_types array<string>, required_terms array<string>,
        excluded_terms array<string>, preference_notes string
    """,
    "jobs": f"""
        source_id string, job_id string, identity_key string, {_POSTING},
        lifecycle_status string, consecutive_successful_absences int, initial_import boolean,
        first_discovered_at timestamp, last_observed_at timestamp
    """,
    "user_states": "job_id string, seen_at timestamp, dismissed_at timestamp",
    "matches": """
        job_id string, profile_id string, profile_version int, content_fingerprint string,
        matcher_version string, classification string, score int, role_score int,
        resume_score int, preference_score int, hard_constraint_pass boolean,
        hard_constraint_reasons array<string>, evidence array<string>, gaps array<string>,
        provider string, provider_status string, error string
    """,
    "observations": f"""
        scan_run_id string, source_id string, job_id string, identity_key string, seq bigint,
        scan_seq bigint, observed_at timestamp, {_POSTING}
    """,
}


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan of one stored table with its declared schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed responses with the declared schema, as parquet, JSON lines or ORC."""
    return spark.read.format(fmt).schema(SCHEMAS["captures"]).load(path)


def read_capture_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed response bodies kept one per file below ``source_id=…/scan_run_id=…`` folders; the
    file name takes the place of the URL."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("source_id").cast("string").alias("source_id"),
        F.col("scan_run_id").cast("string").alias("scan_run_id"),
        F.lit(0).cast("long").alias("seq"),
        F.lit(kind).alias("kind"),
        F.col("_metadata.file_path").alias("url"),
        F.lit(200).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.col("value").alias("body"),
    )


def stream_captures(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    return (
        spark.readStream.schema(SCHEMAS["captures"])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def stream_table(
    spark: SparkSession, path: str, table: str, files_per_batch: int = 1_000
) -> DataFrame:
    return (
        spark.readStream.schema(SCHEMAS[table])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path}/{table}")
    )
