"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from contentflow.functions.binding import TEXT_TASKS

# Adaptive execution does the run-time work this package relies on: it splits
# skewed join partitions, coalesces small shuffle partitions and only turns a
# join into a broadcast after the real size of that side is known.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pages may be megabytes each: few rows per batch keep a Python worker small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """Session for tests and local benches; clusters bring their own. ``scratch`` becomes the shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contentflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(TEXT_TASKS, str(os.cpu_count() or 8) if cores == "*" else cores)
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a folder of the warehouse where that is not set.

    Both are shared on a cluster, and a local master takes the same way.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/contentflow-scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
