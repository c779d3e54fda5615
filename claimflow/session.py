"""Session construction."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job relies on. Timestamps are rendered in UTC, AQE re-plans
# joins/aggregations at run time (coalescing small shuffle partitions and
# splitting skewed ones), and the UI server stays off.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Many small text documents should share a task.
    "spark.sql.files.openCostInBytes": str(1 << 20),
}


# Settings for a large cluster (hundreds of executors, tens of TB of text).
# Apply with ``get_spark(extra_conf=CLUSTER_CONF)`` or the launcher.
CLUSTER_CONF = {
    # Regex masking costs CPU per byte: smaller scan splits give more, shorter
    # tasks (less straggling, cheaper retries when an executor is lost).
    "spark.sql.files.maxPartitionBytes": str(64 << 20),
    # Let AQE size shuffles: start wide, coalesce to ~128 MB partitions.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    # Split skewed join partitions (e.g. one hot claim/source key).
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    # Arrow batches for mapInPandas stages (inference, k-NN kernel).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Re-run lost shuffle outputs instead of failing the stage.
    "spark.stage.maxConsecutiveAttempts": "8",
    "spark.task.maxFailures": "8",
}


def get_spark(
    master: str | None = None,
    app_name: str = "claimflow",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Return (or create) a session with claimflow's base settings.

    ``master`` is only applied when given; on a cluster the launcher sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM.
        conf.setdefault("spark.driver.memory", os.environ.get("CLAIMFLOW_DRIVER_MEMORY", "16g"))
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
