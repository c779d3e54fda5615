"""Sinks and tolerant JSON sources.

The primary sink is a partitioned table; one-JSON-object-per-key files are
an export format only (many small files do not scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.sources.commits import MERGE_PARTS, CommittedTable

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("feedback_type", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("accuracy_rating", T.IntegerType()),
    T.StructField("speed_rating", T.IntegerType()),
    T.StructField("quality_rating", T.IntegerType()),
    T.StructField("user_agent", T.StringType()),
])


def latest_per_key(df: DataFrame, key_col: str = "output_key", order_cols=("processed_at", "input_file")) -> DataFrame:
    """Last write wins per output key. ``max_by`` aggregates partially,
    so a key written many times ships one candidate per partition."""
    payload = [c for c in df.columns if c != key_col]
    best = df.groupBy(key_col).agg(F.max_by(F.struct(*payload), F.struct(*order_cols)).alias("__r"))
    return best.select(key_col, "__r.*")


def write_summaries(df: DataFrame, path: str, stream: tuple[str, int] | None = None) -> None:
    """Add summaries to the store at ``path``, one commit of a part sorted
    by key. ``stream`` (application, epoch) makes a replayed epoch a no-op.

    The store is merged as it grows (:func:`compact_summaries`)."""
    CommittedTable(df.sparkSession, path).append(_by_key(df), *(stream or (None, None)), level=0)
    compact_summaries(df.sparkSession, path)


def _by_key(df: DataFrame) -> DataFrame:
    """Files of separate key ranges, each sorted, so that a look-up's filter leaves one row group of them."""
    return df.repartitionByRange("output_key").sortWithinPartitions("output_key")


def _newest(df: DataFrame) -> DataFrame:
    """The record that counts under each key: that of the latest version of
    the document, where the store knows its time, else the last one written."""
    order = ("processed_at", "input_file")
    return latest_per_key(df, order_cols=("modified", *order) if "modified" in df.columns else order)


def compact_summaries(spark: SparkSession, path: str, parts: int = MERGE_PARTS) -> int:
    """Merge parts of one size into one of the next, keeping one record of each key."""
    return CommittedTable(spark, path).merge_levels(lambda rows: _by_key(_newest(rows)), parts)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The latest summary under each key."""
    return _newest(CommittedTable(spark, path).read())


def read_summary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The latest summary under one key. The filter reaches the sorted
    files of each part, so a part costs one row group."""
    return _newest(CommittedTable(spark, path).read().where(F.col("output_key") == key))


def write_evaluation(results: DataFrame, path: str, run_id: str) -> None:
    """The results of one evaluation run under ``run_id=...``; earlier
    runs stay, and writing a run again replaces it."""
    results.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def write_json_export(df: DataFrame, path: str) -> None:
    """JSON-lines export (one object per row)."""
    df.write.mode("overwrite").json(path)


def nest_results(results: DataFrame) -> DataFrame:
    """S10 nested form ``claim -> model -> result`` as one JSON document per
    claim (the model map of one claim is bounded by the model list). Results
    carry every field; ``summary_length`` is added where there is a summary."""
    from claimflow.operators.evaluation import one_per_model
    fields = [c for c in ("success", "time_seconds", "extracted_info", "summary", "error") if c in results.columns]
    last = one_per_model(results.select("claim_name", "model_id", *fields), ("claim_name", "model_id"))
    result = F.struct(*fields, F.length("summary").alias("summary_length"))
    # Entries in model order, so equal runs give equal documents.
    per = last.groupBy("claim_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "model_id", result.alias("result"))))).alias("results"))
    return per.select("claim_name", F.to_json("results").alias("json"))


def parse_feedback(raw: DataFrame) -> DataFrame:
    """Feedback objects (text column ``value``) as entries with ``ok``.

    A value that is no JSON object of the entry's types is not ``ok``. A key
    missing from an object reads as ``unknown`` for ``feedback_type`` and
    ``model_id``, while an explicit JSON null stays null (Q11). Batch and
    stream read feedback through this function."""
    schema = T.StructType(FEEDBACK_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    keys = F.json_object_keys("value")
    rows = raw.withColumn("j", F.from_json("value", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("keys", keys)
    ok = F.col("j").isNotNull() & F.col("j._corrupt_record").isNull() & F.col("keys").isNotNull()
    named = [F.when(F.array_contains("keys", f.name), F.col("j")[f.name]).otherwise(F.lit("unknown")).alias(f.name)
             if f.name in ("feedback_type", "model_id") else F.col("j")[f.name].alias(f.name) for f in FEEDBACK_SCHEMA.fields]
    return rows.select(*named, *[c for c in raw.columns if c != "value"], F.col("value").alias("raw"), ok.alias("ok"))


def read_feedback_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every feedback object under ``path`` (pretty-printed, one per
    file), and the malformed ones (``file, raw``) apart."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    parsed = parse_feedback(raw.select("value", F.col("_metadata.file_path").alias("file")))
    return parsed.where("ok").drop("file", "raw", "ok"), parsed.where("not ok").select("file", "raw")


def write_feedback(df: DataFrame, path: str) -> None:
    """Append feedback entries (JSON lines)."""
    df.write.mode("append").json(path)


def latest_run_per_source(audit: DataFrame, source_col: str = "source", ts_col: str = "started_at") -> DataFrame:
    """K6: the most recent ingestion run of every data source (``max_by``,
    partially aggregated)."""
    payload = [c for c in audit.columns if c != source_col]
    best = audit.groupBy(source_col).agg(F.max_by(F.struct(*payload), F.col(ts_col)).alias("__r"))
    return best.select(source_col, "__r.*")


def ingestion_audit(stats: DataFrame, source: str, started_at) -> DataFrame:
    """One audit row for an ingestion run (A13 stats + source + start time)."""
    ts = started_at if not isinstance(started_at, str) else F.to_timestamp(F.lit(started_at))
    return stats.select(F.lit(source).alias("source"), ts.alias("started_at"), "*")
