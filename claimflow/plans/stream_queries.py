"""Registered queries that run a stream, or several writes of a store, over the given tables.

Each derives its input files from a table, in the shared folder, runs the
job over them to its end and returns what a reader finds afterwards.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import inference, kb
from claimflow.plans.registry import query
from claimflow.plans.source_queries import _SUMMARY_EVENTS_SQL, _extract_sql, _summary_events, _summary_sql
from claimflow.sources import documents, sinks, views
from claimflow.sources.commits import CommittedTable
from claimflow.sources.staging import shared_path
from claimflow.sources.tables import read_table
from claimflow.streaming import jobs

_REVISED = "\nRevised by the claimant."


# ------------------------------------------------------------ T1-T3 arrivals
def _waves(spark, sf_dir):
    """Deliveries of claim documents in three waves: every claim; every third
    again, and a revised version of every fifth; then the first version of the
    revised ones once more, late."""
    c = views.claims(spark, sf_dir).select(
        "claim_id", "input_key", F.col("claim_text").alias("text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("claim_id")).alias("modified"))
    k = F.col("claim_id")
    revised = c.where(k % 5 == 0).withColumn("text", F.concat("text", F.lit(_REVISED))).withColumn(
        "modified", F.col("modified") + F.expr("INTERVAL 1 DAY"))
    return [w.drop("claim_id") for w in (c, c.where(k % 3 == 0).unionByName(revised), c.where(k % 5 == 0))]


def run_arrivals(spark, sf_dir, files_per_trigger: int = 8, client_factory=inference.OfflineClient):
    """Land the waves and run the arrival stream to its end; returns the store's path."""
    root = shared_path(spark, "arrivals")
    for wave in _waves(spark, sf_dir):
        wave.write.mode("append").parquet(f"{root}/landing")
        deliveries = spark.readStream.schema(wave.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/landing")
        jobs.process_deliveries(deliveries, f"{root}/summaries", f"{root}/quarantine", f"{root}/checkpoint",
                                views.DEFAULT_MODELS[0], client_factory).awaitTermination()
    return f"{root}/summaries"


@query("arrival_summaries", views.with_views(
    f"""with v as (select input_key, claim_id, claim_text || case when claim_id % 5 = 0 then chr(10) || 'Revised by the claimant.' else '' end as claim_text
  from claims)
select 'summaries/' || list_last(string_split(input_key, '/')) || '.json' as output_key, input_key as input_file,
 '{views.DEFAULT_MODELS[0]}' as model_used, {_extract_sql('claim_text')} as extracted_info, {_summary_sql('claim_text')} as summary,
 strftime(to_timestamp(1704067200 + claim_id + case when claim_id % 5 = 0 then 86400 else 0 end) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as version
from v""", "claims"))
def arrival_summaries(spark, sf_dir):
    """Summaries after a stream of deliveries with repeated and
    revised documents, each wave a restart from the checkpoint."""
    store = sinks.read_summaries(spark, run_arrivals(spark, sf_dir))
    return store.select("output_key", "input_file", "model_used", "extracted_info", "summary",
                        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("version"))


class _RefusingClient(inference.OfflineClient):
    """Fails on one kind of document."""

    def invoke(self, model_id: str, body: str) -> str:
        if "Lost luggage on a trip." in body:
            raise RuntimeError("model refused")
        return super().invoke(model_id, body)


@query("arrival_quarantine", views.with_views(
    """select input_key, 'model refused' as error from claims where claim_id % 5 = 3""", "claims"))
def arrival_quarantine(spark, sf_dir):
    """Documents on which the model fails are in the quarantine table; the others have their summaries."""
    root = shared_path(spark, "refused")
    first = _waves(spark, sf_dir)[0]
    first.write.parquet(f"{root}/landing")
    deliveries = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/landing")
    jobs.process_deliveries(deliveries, f"{root}/summaries", f"{root}/quarantine", f"{root}/checkpoint", views.DEFAULT_MODELS[0],
                            _RefusingClient, transform=lambda b: b, retries=0).awaitTermination()
    return CommittedTable(spark, f"{root}/quarantine").read().select("input_key", "error")


# ------------------------------------------------------------- T4, S9 feedback
def _feedback_texts(spark, sf_dir):
    """Feedback entries as JSON texts: every seventh is cut short, every eleventh of the rest has a word for a rating."""
    f = views.feedback(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.to_json(F.struct(*f.columns), {"ignoreNullFields": "false"})
    n = F.col("id").cast("long")
    value = (F.when(n % 7 == 0, F.substring(text, 1, 40))
              .when(n % 11 == 0, F.regexp_replace(text, r'"rating":(null|\d+),"accuracy', '"rating":"five","accuracy'))
              .otherwise(text))
    return f.select("id", value.alias("value"))


_FEEDBACK_OK_SQL = """ok as (select * from feedback where cast(id as bigint) % 7 <> 0 and cast(id as bigint) % 11 <> 0)"""


@query("feedback_tolerant", views.with_views(
    f"""with {_FEEDBACK_OK_SQL}
select id as entry, 'entry' as status, rating, accuracy_rating, speed_rating, quality_rating, feedback_type, model_id, comment from ok
union all select id, 'quarantine', null, null, null, null, null, null, null from feedback
where cast(id as bigint) % 7 = 0 or cast(id as bigint) % 11 = 0""", "feedback"))
def feedback_tolerant(spark, sf_dir):
    """Feedback texts with cut and mistyped ones among them, parsed once; entries and quarantined texts in one result."""
    raw = _feedback_texts(spark, sf_dir).withColumnRenamed("id", "entry")
    parsed = sinks.parse_feedback(raw)
    kept = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)
    return parsed.select(
        "entry", F.when(F.col("ok"), "entry").otherwise("quarantine").alias("status"),
        *[kept(c) for c in ("rating", "accuracy_rating", "speed_rating", "quality_rating", "feedback_type", "model_id", "comment")])


def run_feedback(spark, sf_dir, files: int = 12, files_per_trigger: int = 2):
    """Land the feedback texts in ``files`` files and run the statistics stream to its end; returns its output path."""
    root = shared_path(spark, "feedback")
    _feedback_texts(spark, sf_dir).select("value").repartition(files).write.text(f"{root}/landing")
    jobs.running_feedback(spark, f"{root}/landing", f"{root}/sums", f"{root}/checkpoint", whole_files=False,
                          max_files_per_trigger=files_per_trigger).awaitTermination()
    return f"{root}/sums"


def _sums_sql(c):
    truthy = f"case when {c} <> 0 then {c} end"
    return (f"count({truthy}) as n_{c}, cast(coalesce(sum({truthy}), 0) as bigint) as sum_{c}, "
            f"case when count({truthy}) > 0 then sum({truthy}) / count({truthy}) else 0.0 end as average_{c}")


@query("feedback_running", views.with_views(
    f"""with {_FEEDBACK_OK_SQL}
select feedback_type, model_id, count(*) as entries, {', '.join(_sums_sql(c) for c in ('rating', 'accuracy_rating', 'speed_rating', 'quality_rating'))}
from ok group by feedback_type, model_id""", "feedback"))
def feedback_running(spark, sf_dir):
    """T4: feedback statistics that a stream has summed up, epoch by epoch."""
    out = jobs.read_running_feedback(spark, run_feedback(spark, sf_dir), ("feedback_type", "model_id"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in out.columns if c == "entries" or c.startswith(("n_", "sum_"))})


# ------------------------------------------------------------- V4/T5, S5/S7 stores
@query("kb_two_syncs", """with h as (select doc_id, source, sha256(text) as h, list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x0B]+'), lambda x: x <> '') as words
  from documents),
one as (select h, min(doc_id) as doc_id from h where doc_id in (select doc_id from labels) group by h),
two as (select h, min(doc_id) as doc_id from h where h not in (select h from one) group by h),
idx as (select doc_id, 1 as sync from one union all select doc_id, 2 from two),
n as (select h.*, sync, case when len(words) = 0 then 0 else greatest(cast(ceil((len(words) - 300) / 240.0) as bigint), 0) + 1 end as n_chunks
  from h join idx using (doc_id))
select doc_id, cast(i as int) as chunk_no, cast(len(list_slice(words, i * 240 + 1, i * 240 + 300)) as int) as n_words, 64 as dim
from n, range(n_chunks) t(i)""")
def kb_two_syncs(spark, sf_dir):
    """V4/V8: the index after two syncs, the labelled documents and then all of them: one document of each text."""
    path = shared_path(spark, "kb-index")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    kb.sync_index(docs.join(labels, "doc_id", "left_semi"), path, dim=64)
    kb.sync_index(docs, path, dim=64)
    kb.compact_index(spark, path)
    return kb.read_index(spark, path).select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"),
                                             F.col("n_words").cast("int").alias("n_words"), F.size("vector").alias("dim"))


@query("kb_sync_audit", """with h as (select doc_id, sha256(text) as h from documents),
one as (select * from h where doc_id in (select doc_id from labels))
select 1 as sync, (select count(*) from one) as documents_scanned, (select count(distinct h) from one) as new_documents_indexed,
 (select count(*) from one) - (select count(distinct h) from one) as documents_skipped
union all
select 2, (select count(*) from h), (select count(distinct h) from h where h not in (select h from one)),
 (select count(*) from h) - (select count(distinct h) from h where h not in (select h from one))""")
def kb_sync_audit(spark, sf_dir):
    """The statistics that two syncs leave, from the rows that the syncs themselves need."""
    path = shared_path(spark, "kb-audit")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    *_, one = kb.sync_index(docs.join(labels, "doc_id", "left_semi"), path, dim=16)
    *_, two = kb.sync_index(docs, path, dim=16)
    return one.withColumn("sync", F.lit(1)).unionByName(two.withColumn("sync", F.lit(2))).select(
        "sync", "documents_scanned", "new_documents_indexed", "documents_skipped")


@query("summary_store", f"""with {_SUMMARY_EVENTS_SQL}
select output_key, input_file, strftime(processed_at, '%Y-%m-%dT%H:%M:%S') as processed_at from latest""")
def summary_store(spark, sf_dir):
    """The store after twelve writes, which it has merged on the way; keys are written again by later ones."""
    path = shared_path(spark, "summary-store")
    events = _summary_events(spark, sf_dir).withColumn("__w", F.pmod(F.xxhash64("input_file"), F.lit(12)))
    for w in range(12):
        sinks.write_summaries(events.where(F.col("__w") == w).drop("__w"), path)
    return sinks.read_summaries(spark, path).select(
        "output_key", "input_file", F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"))


# ------------------------------------------------------------- S1-S3 files
@query("document_scan", """select doc_id, case when doc_id % 50 = 3 then 'not UTF-8 text' end as reason,
 case when doc_id % 50 <> 3 then length(coalesce(text, '')) + 1 end as n_chars,
 case when doc_id % 50 <> 3 then md5(coalesce(text, '') || chr(10)) end as text_md5 from documents""")
def document_scan(spark, sf_dir):
    """Every document exported to a file of its own, every fiftieth with a byte that is no text, and all scanned again."""
    root = shared_path(spark, "exported")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), body)
    documents.export_documents(docs.select("doc_id", F.when(F.col("doc_id") % 50 == 3, broken).otherwise(body).alias("body")),
                               f"{root}/documents", "doc_id", "body")
    scan = documents.scan_documents(spark, root, prefix="documents/")
    return scan.select(F.regexp_extract("input_key", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "reason",
                       F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------------- M11 batch inference
@query("batch_inference", f"""with p as (select role, text, case when conv_id % 2 = 0 then '{views.DEFAULT_MODELS[0]}' else '{views.DEFAULT_MODELS[1]}' end as model_id
  from conversations)
select role, model_id, count(*) as turns, count(distinct text) + max(case when text is null then 1 else 0 end) as calls,
 count(text) as answered, cast(coalesce(sum(length(text)), 0) as bigint) as answer_chars from p group by role, model_id""")
def batch_inference(spark, sf_dir):
    """Every turn of the conversations as a request; equal requests of a model are called once."""
    turns = read_table(spark, sf_dir, "conversations").select(
        "role", "text", F.when(F.col("conv_id") % 2 == 0, views.DEFAULT_MODELS[0]).otherwise(views.DEFAULT_MODELS[1]).alias("model_id"))
    out = inference.run_model(turns, "model_id", "text", once=True, concurrency=4, timeout=60.0, out_prefix="reply_")
    return out.groupBy("role", "model_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("reply_request_id").alias("calls"),
        F.count_if("reply_success").alias("answered"),
        F.coalesce(F.sum(F.length("reply_text")), F.lit(0)).cast("bigint").alias("answer_chars"))
