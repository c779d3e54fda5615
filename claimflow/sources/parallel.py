"""Parallelism guard for CPU-heavy text stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``min_partitions`` partitions (default:
    the cluster's default parallelism) when its scan yields fewer.

    Regex masking and chunking cost CPU per byte, so a small table stored as
    one row group would otherwise run in a single task. On large inputs the
    scan already has far more splits than cores and this is a no-op (no
    shuffle is added).
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    return df if _has_splits(spark, df, target) else df.repartition(target)


#: More tasks than these are no gain to a job of any size.
MAX_TASKS = 20_000


def tasks_by_size(df: DataFrame, task_bytes: int) -> int:
    """The number of tasks of which each gets the work of ``task_bytes`` of
    ``df``'s files: the cluster's default parallelism at least.

    For work that costs far more than its rows weigh: Spark sizes the tasks
    behind a shuffle by bytes, which leaves narrow rows with a few long ones."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // task_bytes), MAX_TASKS))


def _has_splits(spark: SparkSession, df: DataFrame, target: int) -> bool:
    """Whether the scan yields ``target`` splits or more, from its files' number and sizes alone."""
    files = df.inputFiles()
    if not files:  # no files below: only the plan knows
        return df.rdd.getNumPartitions() >= target
    if len(files) >= target:
        return True
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    conf = spark._jsc.hadoopConfiguration()
    return sum(-(-p.getFileSystem(conf).getFileStatus(p).getLen() // split) for p in paths) >= target
