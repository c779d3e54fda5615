"""Registered landing, summary-store, catalog and model I/O queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from claimflow.operators import feedback as fb
from claimflow.operators import inference
from claimflow.plans.claim_queries import _extract_sql, _summary_sql
from claimflow.plans.registry import query
from claimflow.sources import documents, sinks, views
from claimflow.sources.parallel import spread
from claimflow.sources.tables import read_table

LAYOUT_MODELS = views.DEFAULT_MODELS + ("amazon.nova-lite-v1:0",)
_EPOCH_2024 = 1704067200
#: Of the orders' files: some 50,000 to 120,000 claims, each of which calls every model twice.
CHAIN_TASK_BYTES = 1 << 20

# The model catalog (family, id, name, description, cost tier).
MODEL_CATALOG = (
    ("claude-3.5", "anthropic.claude-3-5-sonnet-20241022-v2:0", "Claude 3.5 Sonnet v2",
     "Latest Sonnet - best for summarization", "Medium"),
    ("claude-3.5", "anthropic.claude-3-5-haiku-20241022-v1:0", "Claude 3.5 Haiku",
     "Fastest - good for simple summaries", "Low"),
    ("claude-3", "anthropic.claude-3-sonnet-20240229-v1:0", "Claude 3 Sonnet", "Previous generation Sonnet", "Medium"),
    ("claude-3", "anthropic.claude-3-haiku-20240307-v1:0", "Claude 3 Haiku", "Previous generation Haiku", "Low"),
)


def catalog(spark):
    """The model catalog as a table."""
    return spark.createDataFrame(list(MODEL_CATALOG), "family string, model_id string, name string, "
                                                      "description string, cost string")


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols):
    return "select * from (values " + ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows) + \
        f") t({', '.join(cols)})"


# ------------------------------------------------------------------ landing
@query("land_documents", f"""with u as (select doc_id, text,
  source || '/' || lang || ' résumé ' || cast(doc_id as varchar) || '.txt' as filename,
  make_timestamp(cast(({_EPOCH_2024} + doc_id) * 1000000 as bigint)) as uploaded_at from documents),
s as (select *, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(
  regexp_replace(strip_accents(filename), '[^\\x00-\\x7F]', '', 'g'), '/', ' ', 'g'),
  '\\s+', ' ', 'g')), ' ', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') as safe from u)
select doc_id,
 case when filename is null or filename = '' then 'No file selected' when octet_length(encode(text)) > {documents.MAX_UPLOAD_BYTES}
  then 'File too large' when safe = '' then 'Invalid file name' end as reason,
 'documents/' || strftime(uploaded_at, '%Y%m%d_%H%M%S') || '_' || safe as input_key from s""")
def land_documents(spark, sf_dir):
    """Every document as an upload: name guard, 16 MB limit, safe key."""
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("", "source", F.lit("/"), "lang", F.lit(" résumé "),
                              F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.octet_length("text").alias("size"),
        F.timestamp_seconds(F.lit(_EPOCH_2024) + F.col("doc_id")).alias("uploaded_at"))
    landed = documents.land_documents(d, "filename", "size", "uploaded_at")
    return landed.select("doc_id", "reason", "input_key")


# ----------------------------------------------------------- summary store
def _summary_events(spark, sf_dir, order_key=None):
    """Summary records of one processing run: every claim once, and claims
    of finished orders re-uploaded later under ``archive/`` (same basename,
    so their summary key is written twice). ``order_key`` narrows the scan to
    one order's records."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    if order_key is not None:
        o = o.where(F.col("o_orderkey") == order_key)
    base = F.concat(F.lit("claim_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".txt"))
    first = o.select(F.concat(F.lit("documents/"), base).alias("input_file"),
                     (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("processed_at"))
    again = o.where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("archive/"), base).alias("input_file"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("processed_at"))
    ev = first.unionByName(again)
    return ev.withColumn("output_key", F.concat(F.lit("summaries/"), F.element_at(F.split("input_file", "/"), -1),
                                               F.lit(".json")))


_SUMMARY_EVENTS_SQL = """ev as (
 select 'documents/claim_' || lpad(cast(o_orderkey as varchar), 8, '0') || '.txt' as input_file,
   cast(o_orderdate as timestamp) + interval 1 day as processed_at from orders
 union all
 select 'archive/claim_' || lpad(cast(o_orderkey as varchar), 8, '0') || '.txt',
   cast(o_orderdate as timestamp) + interval 2 day from orders where o_orderstatus = 'F'),
ek as (select *, 'summaries/' || list_last(string_split(input_file, '/')) || '.json' as output_key from ev),
latest as (select output_key, arg_max(input_file, (processed_at, input_file)) as input_file,
   max(processed_at) as processed_at from ek group by output_key)"""


@query("summary_latest", f"""with {_SUMMARY_EVENTS_SQL}
select output_key, input_file, strftime(processed_at, '%Y-%m-%dT%H:%M:%S') as processed_at from latest""")
def summary_latest(spark, sf_dir):
    """One summary per output key, the last write winning."""
    s = sinks.latest_per_key(_summary_events(spark, sf_dir), "output_key", ("processed_at", "input_file"))
    return s.select("output_key", "input_file",
                    F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"))


LOOKUP_KEY = "summaries/claim_00000001.txt.json"


@query("summary_lookup", f"""with {_SUMMARY_EVENTS_SQL}
select output_key, input_file from latest where output_key = '{LOOKUP_KEY}'""")
def summary_lookup(spark, sf_dir):
    """Point lookup of one summary by key. The key names its order, so
    the look-up is an equality filter that reaches the scan."""
    order_key = int(re.search(r"claim_(\d+)", LOOKUP_KEY)[1])
    s = sinks.latest_per_key(_summary_events(spark, sf_dir, order_key), "output_key", ("processed_at", "input_file"))
    return s.where(F.col("output_key") == LOOKUP_KEY).select("output_key", "input_file")


@query("object_listing", """with o as (select 'documents/' || source || '/' || cast(doc_id as varchar) || '.txt' as key,
   octet_length(encode(coalesce(text, ''))) as size from documents union all
 select 'pages/' || cast(page_id as varchar) || '.html', octet_length(encode(coalesce(html, ''))) from pages)
select split_part(key, '/', 1) as area, count(*) as objects, cast(sum(size) as bigint) as bytes from o group by 1""")
def object_listing(spark, sf_dir):
    """Objects and bytes per landing area, documents and pages listed as objects."""
    d, p = (read_table(spark, sf_dir, t) for t in ("documents", "pages"))
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long").alias("size")
    listing = d.select(F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
                       size("text")).unionByName(
        p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("key"), size("html")))
    return documents.objects_per_area(listing)


@query("pending_documents", views.with_views(
    """select c.claim_id, c.input_key from claims c
where not exists (select 1 from model_results r where r.model_ord = 1 and r.success
  and r.claim_name = 'claim_' || lpad(cast(c.claim_id as varchar), 8, '0'))""", "claims", "model_results"))
def pending_documents(spark, sf_dir):
    """Uploaded claims with no summary yet (summaries exist where the
    default model succeeded); a left anti join on the output key."""
    c = views.claims(spark, sf_dir).select("claim_id", "input_key",
                                           F.concat(F.lit("claim_"), F.lpad(F.col("claim_id").cast("string"), 8, "0"))
                                           .alias("claim_name"))
    done = views.model_results(spark, sf_dir).where((F.col("model_ord") == 1) & F.col("success")).select("claim_name")
    return c.join(done, "claim_name", "left_anti").select("claim_id", "input_key")


# ------------------------------------------------------------------ catalog
@query("model_catalog", views.with_views(
    f"""with cat as ({_values(MODEL_CATALOG, ['family', 'model_id', 'name', 'description', 'cost'])}),
fbm as (select model_id, count(*) as n_feedback from feedback group by model_id)
select model_id, c.family, c.name, c.description, c.cost, coalesce(f.n_feedback, 0) as n_feedback
from cat c full outer join fbm f using (model_id)""", "feedback"))
def model_catalog(spark, sf_dir):
    """Every catalog model with its family and feedback volume, and every
    model with feedback that is not in the catalog (no family)."""
    per = fb.by_model(views.feedback(spark, sf_dir)).select("model_id", F.col("count").alias("n_feedback"))
    return catalog(spark).join(per, "model_id", "full").select(
        "model_id", "family", "name", "description", "cost", F.coalesce("n_feedback", F.lit(0)).alias("n_feedback"))


@query("model_families", views.with_views(
    f"""with cat as ({_values(MODEL_CATALOG, ['family', 'model_id', 'name', 'description', 'cost'])}),
fbm as (select model_id, count(*) as n_feedback from feedback group by model_id)
select family, count(*) as n_models, string_agg(c.name, ', ' order by c.name) as names,
 cast(coalesce(sum(n_feedback), 0) as bigint) as n_feedback from cat c left join fbm using (model_id) group by family""",
    "feedback"))
def model_families(spark, sf_dir):
    """The catalog grouped by family, with the family's feedback volume."""
    per = fb.by_model(views.feedback(spark, sf_dir)).select("model_id", F.col("count").alias("n_feedback"))
    return catalog(spark).join(per, "model_id", "left").groupBy("family").agg(
        F.count(F.lit(1)).alias("n_models"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"),
        F.coalesce(F.sum("n_feedback"), F.lit(0)).cast("bigint").alias("n_feedback"))


# ---------------------------------------------------------------- model I/O
def _models_sql():
    return " union all ".join(f"select {_q(m)} as model_id" for m in LAYOUT_MODELS)


def _request_sql():
    msg = "[{'role': 'user', 'content': text}]"
    return f"""with m as ({_models_sql()})
select conv_id, turn, m.model_id, cast(case
 when starts_with(m.model_id, 'amazon.nova') then to_json({{'messages': [{{'role': 'user', 'content': [{{'text': text}}]}}],
   'inferenceConfig': {{'max_new_tokens': 1000, 'temperature': 0.0::double}}}})
 when starts_with(m.model_id, 'openai.gpt-oss') then to_json({{'model': m.model_id, 'messages': {msg},
   'max_completion_tokens': 1000, 'temperature': 0.0::double}})
 else to_json({{'anthropic_version': '{inference.ANTHROPIC_VERSION}', 'max_tokens': 1000, 'messages': {msg},
   'temperature': 0.0::double}}) end as varchar) as body
from conversations cross join m where role = 'user'"""


def _turns(spark, sf_dir, role):
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return spread(c).select("conv_id", "turn", "text", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_id")) for m in LAYOUT_MODELS])))


@query("model_request", _request_sql())
def model_request(spark, sf_dir):
    """M9: request body per user turn for every request layout."""
    t = _turns(spark, sf_dir, "user")
    return t.select("conv_id", "turn", "model_id", inference.request_body("model_id", "text").alias("body"))


@query("model_response", f"""with m as ({_models_sql()})
select conv_id, turn, m.model_id, text as response_text from conversations cross join m where role = 'assistant'""")
def model_response(spark, sf_dir):
    """Assistant turns wrapped in each provider's response layout and
    parsed back to text."""
    t = _turns(spark, sf_dir, "assistant")
    wrapped = t.withColumn("body", inference.response_body("model_id", "text"))
    return wrapped.select("conv_id", "turn", "model_id",
                          inference.response_text("model_id", "body").alias("response_text"))


@query("process_claims", views.with_views(
    f"select claim_id, true as extract_success, true as summary_success, {_extract_sql('claim_text')} as extracted_info, "
    f"{_summary_sql('claim_text')} as summary from claims", "claims"))
def process_claims(spark, sf_dir):
    """Extract-then-summarise chain through the pluggable batch
    inference (offline client), default model, every claim."""
    c = views.claims(spark, sf_dir).withColumn("model_id", F.lit(views.DEFAULT_MODELS[0]))
    return inference.process_documents(c, "claim_text", "model_id", columns=(
        "claim_id", "extract_success", "summary_success", "extracted_info", "summary"))


@query("model_chain", views.with_views(
    f"""with m as ({_models_sql()})
select claim_id, m.model_id, {_summary_sql('claim_text')} as summary from claims cross join m""", "claims"))
def model_chain(spark, sf_dir):
    """The chain under every provider's request and response layout."""
    c = views.claims(spark, sf_dir, CHAIN_TASK_BYTES).select("claim_id", "claim_text", F.explode(F.array(
        *[F.lit(m) for m in LAYOUT_MODELS])).alias("model_id"))
    return inference.process_documents(c, "claim_text", "model_id", columns=("claim_id", "model_id", "summary"))
