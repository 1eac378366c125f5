"""Runtime settings every query in this package relies on.

Only SQL settings that can be changed on a running session are touched; memory,
executors and shuffle width stay with whoever submits the application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Timestamps are compared with engines that have no zone.
    "spark.sql.session.timeZone": "UTC",
    # Join strategies are picked from measured sizes; hot keys are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A later configuration layer overrides an earlier one.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches hold whole documents, so bound them by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for lineage cuts: the one ``spark.checkpoint.dir`` names; where that is unset on a local
    master (tests), a folder in the session's warehouse. A cluster must name one that all its machines share."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc.master.split("[")[0] not in ("local", "local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def shared_table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once, in folders of the columns ``by``, and read back. It lies in the folder that
    driver and executors share and is deleted when the application ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.partitionBy(*by).parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())
