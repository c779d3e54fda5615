"""Structured Streaming jobs.

* T1/T2/T3 ``process_on_arrival``: text documents landing in a folder are
  read whole, processed with the same batch operators, and committed to the
  summary store per micro-batch; rows that fail go to a quarantine table.
* T4 ``running_feedback``: feedback statistics as mergeable sums per epoch.
* T5 ``kb_sync``: policy documents under a prefix go into the index as they land.

Every epoch is one commit of a :class:`CommittedTable` under the id of the
streaming query, which its checkpoint keeps. A replayed epoch finds its own
commit and changes nothing, so a failure at any point neither loses nor
repeats rows, and readers never see half an epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimflow.operators import feedback, inference, kb
from claimflow.sources import sinks
from claimflow.sources.commits import CommittedTable


def document_stream(spark: SparkSession, root: str, glob: str = "*.txt",
                    max_files_per_trigger: int = 1000, key_root: str | None = None) -> DataFrame:
    """T1 source: one row per landed text file (``input_key, text, size,
    modified``); keys are relative to ``key_root`` (``root`` by default)."""
    r = (spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob)
         .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files_per_trigger).load(root))
    root = (key_root or root).rstrip("/")
    key = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + _re_escape(root) + "/", "")
    return r.select(key.alias("input_key"), F.col("value").alias("text"),
                    F.col("_metadata.file_size").alias("size"),
                    F.col("_metadata.file_modification_time").alias("modified"))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def _run(rows: DataFrame, handle: Callable[[DataFrame, tuple[str, int]], None], checkpoint: str,
         available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``handle`` gets each micro-batch and its (query id, epoch)."""
    def epoch(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the streaming query's id is not known")
        handle(batch, (query, number))

    w = rows.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def first_deliveries(deliveries: DataFrame, within: str = "1 day",
                     key_cols: tuple[str, ...] = ("input_key", "modified")) -> DataFrame:
    """Each delivery of a document's version once.

    The state holds the keys of the versions that arrived in the last
    ``within``, never their texts. The clock is the time at which a
    micro-batch was planned, which its offset log keeps: no row is ever late,
    and a replayed epoch decides as before. A redelivery after that time is
    processed again and overwrites the same output key with the same record.
    """
    arrived = deliveries.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", within)
    return arrived.dropDuplicatesWithinWatermark(list(key_cols)).drop("__arrived")


def process_deliveries(deliveries: DataFrame, output_path: str, quarantine_path: str, checkpoint: str, model_id: str,
                       client_factory: Callable[[], object] = inference.OfflineClient, available_now: bool = True,
                       transform: Callable[[DataFrame], DataFrame] | None = None, within: str = "1 day",
                       **limits) -> StreamingQuery:
    """T1-T3 over any stream of deliveries (``input_key, text, modified``).

    Repeated deliveries are dropped before the model is called. Summaries go
    to the store at ``output_path`` (read it with ``sinks.read_summaries``, in
    which the latest version of a document wins, however late an older one
    comes), failures to the committed table at ``quarantine_path``. ``limits``
    are those of the model calls (``inference.run_model``).
    """
    def handle(batch: DataFrame, stream: tuple[str, int]) -> None:
        b = batch.withColumn("model_id", F.lit(model_id))
        if transform is not None:
            b = transform(b)
        out = inference.process_documents(b, "text", "model_id", client_factory, **limits)
        ok = F.col("extract_success") & F.col("summary_success")
        # What the sinks take; a document's text stays behind.
        out = out.withColumn("__ok", ok).withColumn("processed_at", F.current_timestamp()).select(
            "input_key", "modified", "model_id", "extracted_info", "summary", "extract_error", "summary_error", "__ok", "processed_at")
        # Written once: both sinks read the same rows, and an epoch that failed between them does not call the model again.
        staging = CommittedTable(batch.sparkSession, f"{checkpoint.rstrip('/')}/_staging")
        if staging.version().done.get(stream[0], -1) >= stream[1]:
            # The stream's state wants every epoch's rows to pass through, a repeated one's too.
            batch.write.format("noop").mode("overwrite").save()
        else:
            staging.append(out, *stream, epoch=stream[1])
        rows = staging.read(lambda p: p["epoch"] == stream[1])
        if rows is None:  # a replayed epoch that both sinks have
            return
        good = inference.summary_record(rows.where("__ok"), "input_key", "model_id", F.col("processed_at"), keep=("modified",))
        sinks.write_summaries(good, output_path, stream)
        bad = rows.where(~F.col("__ok")).select(
            "input_key", F.coalesce("extract_error", "summary_error").alias("error"), "processed_at")
        CommittedTable(batch.sparkSession, quarantine_path).append(bad, *stream)
        staging.replace([p["name"] for p in staging.version().parts if p["epoch"] == stream[1]], [])
        staging.remove_unnamed(keep_versions=1)

    return _run(first_deliveries(deliveries, within), handle, checkpoint, available_now)


def process_on_arrival(spark: SparkSession, input_root: str, output_path: str, quarantine_path: str,
                       checkpoint: str, model_id: str, client_factory: Callable[[], object] = inference.OfflineClient,
                       available_now: bool = True, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Summarise every text file that lands under ``input_root``."""
    return process_deliveries(document_stream(spark, input_root), output_path, quarantine_path, checkpoint, model_id,
                              client_factory, available_now, transform)


def read_latest_summaries(spark: SparkSession, output_path: str) -> DataFrame:
    """Current summaries: the record of the latest version per output key."""
    return sinks.read_summaries(spark, output_path)


#: What the running feedback keeps for each (type, model): counts and sums of truthy ratings.
_RATINGS = ("rating", *(c for _, c in feedback.DIMENSIONS))
_SUMS = ("entries", *(f"{k}_{c}" for c in _RATINGS for k in ("n", "sum")))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feedback_type", "model_id").agg(*[F.sum(c).alias(c) for c in _SUMS])


def running_feedback(spark: SparkSession, feedback_root: str, output_path: str, checkpoint: str,
                     available_now: bool = True, whole_files: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """T4: running feedback statistics over everything submitted so far.

    Objects (one per file, or per line without ``whole_files``) are parsed as
    in batch (``sinks.parse_feedback``): malformed ones are skipped, an
    explicit null type stays null. An epoch adds the sums of its own entries,
    one row for each feedback type and model that it has, and never touches
    what earlier epochs wrote; sums of sums are merged as they gather. The
    stream keeps no state. Read it with :func:`read_running_feedback`.
    """
    raw = (spark.readStream.format("text").option("wholetext", whole_files).option("recursiveFileLookup", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(feedback_root))
    entries = sinks.parse_feedback(raw.select("value")).where("ok")
    truthy = lambda c: F.when(F.col(c) != 0, F.col(c))

    def handle(batch: DataFrame, stream: tuple[str, int]) -> None:
        sums = batch.groupBy("feedback_type", "model_id").agg(
            F.count(F.lit(1)).alias("entries"),
            *[x for c in _RATINGS for x in (F.count(truthy(c)).alias(f"n_{c}"),
                                            F.coalesce(F.sum(truthy(c)), F.lit(0)).cast("bigint").alias(f"sum_{c}"))])
        table = CommittedTable(batch.sparkSession, output_path)
        table.append(sums.coalesce(1), *stream, level=0)
        table.merge_levels(lambda rows: _merged(rows).coalesce(1))

    return _run(entries, handle, checkpoint, available_now)


def read_running_feedback(spark: SparkSession, output_path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest statistics per ``by`` (``feedback_type``, ``model_id``, both
    or neither): entries, and for each rating its count, sum and mean (0 where
    nobody rated)."""
    rows = CommittedTable(spark, output_path).read()
    agg = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
    return agg.withColumns({f"average_{c}": F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}")).otherwise(0.0)
                            for c in _RATINGS})


def kb_sync(spark: SparkSession, kb_root: str, index_path: str, checkpoint: str, prefix: str = "policies/",
            dim: int = 1024, embed: Callable = kb.hashed_terms, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """T5/V8: policy documents that land under ``prefix`` are chunked, embedded,
    checked and appended to the index (``kb.read_index``); texts that it has
    are skipped."""
    docs = document_stream(spark, f"{kb_root.rstrip('/')}/{prefix.strip('/')}", max_files_per_trigger=max_files_per_trigger,
                           key_root=kb_root)

    def handle(batch: DataFrame, stream: tuple[str, int]) -> None:
        kb.sync_index(batch, index_path, dim, "input_key", "text", embed=embed, stream=stream)

    return _run(docs, handle, checkpoint)
