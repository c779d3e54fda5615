"""Claim, feedback and model-result tables derived from the input tables.

The reference processes claim text files, feedback JSON objects and model
comparison results. The test data is a TPC-H-like schema, so these views
derive one claim per order, one feedback entry per event, and one model
result per (order, model). They are plain projections and one join, so
their size grows with the input and Catalyst prunes/pushes into the scans.

Each view also has an ANSI SQL text used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow.sources.parallel import spread, tasks_by_size
from claimflow.sources.tables import read_table

# The default three-model list of the evaluation and
# comparison tools, in their order.
DEFAULT_MODELS = (
    "anthropic.claude-3-sonnet-20240229-v1:0",
    "openai.gpt-oss-120b-1:0",
    "anthropic.claude-3-haiku-20240307-v1:0",
)

_DESCRIPTIONS = (
    "Vehicle collision; police report filed, witness present.",
    "Water damage to the home; cause under review.",
    "Hospital treatment after a fall; diagnosis attached.",
    "Lost luggage on a trip.",
    "Fire next to the car park, driver unhurt.",
)


def _pad(c: Column, n: int, ch: str = "0") -> Column:
    return F.lpad(c.cast("string"), n, ch)


def _line_if(cond: Column, *parts) -> Column:
    return F.when(cond, F.concat(*parts, F.lit("\n"))).otherwise(F.lit(""))


def claims(spark: SparkSession, sf_dir: str, task_bytes: int | None = None) -> DataFrame:
    """One synthetic claim document per order: ``claim_id, input_key, claim_text``.

    With ``task_bytes``, for costly work on each claim, the joined rows are
    dealt evenly over tasks of so many bytes of ``orders`` each, before their
    texts are made."""
    orders = read_table(spark, sf_dir, "orders")
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if task_bytes is None:
        o = spread(o)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    L = F.lit
    desc = F.when((k % 5) == 0, L(_DESCRIPTIONS[0]))
    for i, d in enumerate(_DESCRIPTIONS[1:4], start=1):
        desc = desc.when((k % 5) == i, L(d))
    desc = desc.otherwise(L(_DESCRIPTIONS[4]))
    text = F.concat(
        L("Claimant Name: "), F.col("c_name"), L("\n"),
        L("Policy Number: POL-"), _pad(k, 8), L("\n"),
        L("Incident Date: "), F.col("o_orderdate").cast("date").cast("string"), L("\n"),
        L("Claim Amount: $"), F.floor("o_totalprice").cast("bigint").cast("string"), L("\n"),
        _line_if(k % 3 == 0, L("SSN: "), _pad(ck % 1000, 3), L("-"), _pad(k % 100, 2), L("-"), _pad(k % 10000, 4)),
        _line_if(k % 4 == 1, L("Phone: ("), _pad(200 + ck % 700, 3), L(") 555-"), _pad(k % 10000, 4)),
        _line_if(k % 5 == 2, L("Email: user"), ck.cast("string"), L("@mail.example.com")),
        _line_if(k % 6 == 1, L("DOB: "), (1 + ck % 12).cast("string"), L("/"), (1 + k % 28).cast("string"),
                 L("/"), (1950 + ck % 50).cast("string")),
        _line_if(k % 7 == 3, L("Account: "), _pad(k, 12, "7")),
        _line_if(k % 7 == 4, L("Acct #"), _pad(ck, 10, "8")),
        _line_if(k % 9 == 5, L("Driver's License: D"), _pad(ck, 7)),
        _line_if(k % 8 == 6, L("Card 4111-1111-1111-"), _pad(k % 10000, 4)),
        _line_if(k % 10 == 7, L("VIN 1HGCM82633A"), _pad(k % 1000000, 6)),
        L("Incident Description: "), desc,
    )
    joined = o.join(c, o.o_custkey == c.c_custkey)
    if task_bytes is not None:
        joined = joined.repartition(tasks_by_size(orders, task_bytes))
    return joined.select(
        k.alias("claim_id"),
        F.concat(L("documents/claim_"), _pad(k, 8), L(".txt")).alias("input_key"),
        text.alias("claim_text"),
    )


def _rating(cond_null: Column, value: Column) -> Column:
    return F.when(cond_null, F.lit(None).cast("int")).otherwise(
        (1 + F.floor(value).cast("bigint") % 5).cast("int"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback entry per event, with the reference's entry fields."""
    e = read_table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("value")
    et = F.col("event_type")
    mid = F.col("user_id") % 3
    return e.select(
        _pad(eid, 12).alias("id"),
        F.col("ts").alias("timestamp"),
        _rating(eid % 11 == 0, v).alias("rating"),
        _rating(eid % 7 == 0, v * 3).alias("accuracy_rating"),
        _rating(eid % 13 == 0, v * 5).alias("speed_rating"),
        _rating(eid % 17 == 0, v * 7).alias("quality_rating"),
        F.when(et == "purchase", "positive").when(et == "error", "negative")
        .when(et == "view", "neutral").otherwise("unknown").alias("feedback_type"),
        F.when(mid == 0, DEFAULT_MODELS[0]).when(mid == 1, DEFAULT_MODELS[1])
        .otherwise(DEFAULT_MODELS[2]).alias("model_id"),
        F.when(et.isin("error", "purchase"), F.concat(F.lit("comment "), eid.cast("string")))
        .otherwise(F.lit("")).alias("comment"),
    )


def model_list(models=DEFAULT_MODELS) -> Column:
    """Literal ``array<struct<model_ord,model_id>>``; exploding it fans a row
    out over the models with no join and no shuffle."""
    return F.array(*[
        F.struct(F.lit(i).alias("model_ord"), F.lit(m).alias("model_id"))
        for i, m in enumerate(models, start=1)
    ])


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for one evaluation run: claims x models."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    g = o.select("o_orderkey", F.inline(model_list()))
    k, m = F.col("o_orderkey"), F.col("model_ord")
    ok = (k + m) % 7 != 0
    return g.select(
        F.concat(F.lit("claim_"), _pad(k, 8)).alias("claim_name"),
        m.alias("model_ord"),
        "model_id",
        ok.alias("success"),
        (((k * (m + 3)) % 500).cast("double") / 100).alias("time_seconds"),
        F.when(ok, F.concat(F.lit("Summary of "),
                            F.repeat(F.lit("x"), ((k * 13 + m * 101) % 420).cast("int")))).alias("summary"),
        F.when(~ok, F.lit("throttled")).alias("error"),
    )


# ---------------------------------------------------------------- oracle SQL
CLAIMS_SQL = r"""
select o_orderkey as claim_id,
 'documents/claim_' || lpad(cast(o_orderkey as varchar),8,'0') || '.txt' as input_key,
 'Claimant Name: ' || c_name || chr(10)
 || 'Policy Number: POL-' || lpad(cast(o_orderkey as varchar),8,'0') || chr(10)
 || 'Incident Date: ' || cast(cast(o_orderdate as date) as varchar) || chr(10)
 || 'Claim Amount: $' || cast(cast(floor(o_totalprice) as bigint) as varchar) || chr(10)
 || case when o_orderkey % 3 = 0 then 'SSN: ' || lpad(cast(o_custkey % 1000 as varchar),3,'0') || '-' || lpad(cast(o_orderkey % 100 as varchar),2,'0') || '-' || lpad(cast(o_orderkey % 10000 as varchar),4,'0') || chr(10) else '' end
 || case when o_orderkey % 4 = 1 then 'Phone: (' || lpad(cast(200 + o_custkey % 700 as varchar),3,'0') || ') 555-' || lpad(cast(o_orderkey % 10000 as varchar),4,'0') || chr(10) else '' end
 || case when o_orderkey % 5 = 2 then 'Email: user' || cast(o_custkey as varchar) || '@mail.example.com' || chr(10) else '' end
 || case when o_orderkey % 6 = 1 then 'DOB: ' || cast(1 + o_custkey % 12 as varchar) || '/' || cast(1 + o_orderkey % 28 as varchar) || '/' || cast(1950 + o_custkey % 50 as varchar) || chr(10) else '' end
 || case when o_orderkey % 7 = 3 then 'Account: ' || lpad(cast(o_orderkey as varchar),12,'7') || chr(10) else '' end
 || case when o_orderkey % 7 = 4 then 'Acct #' || lpad(cast(o_custkey as varchar),10,'8') || chr(10) else '' end
 || case when o_orderkey % 9 = 5 then 'Driver''s License: D' || lpad(cast(o_custkey as varchar),7,'0') || chr(10) else '' end
 || case when o_orderkey % 8 = 6 then 'Card 4111-1111-1111-' || lpad(cast(o_orderkey % 10000 as varchar),4,'0') || chr(10) else '' end
 || case when o_orderkey % 10 = 7 then 'VIN 1HGCM82633A' || lpad(cast(o_orderkey % 1000000 as varchar),6,'0') || chr(10) else '' end
 || 'Incident Description: ' || case o_orderkey % 5
      when 0 then 'Vehicle collision; police report filed, witness present.'
      when 1 then 'Water damage to the home; cause under review.'
      when 2 then 'Hospital treatment after a fall; diagnosis attached.'
      when 3 then 'Lost luggage on a trip.'
      else 'Fire next to the car park, driver unhurt.' end as claim_text
from orders join customer on o_custkey = c_custkey
"""

FEEDBACK_SQL = r"""
select lpad(cast(event_id as varchar),12,'0') as id, ts as timestamp,
 case when event_id % 11 = 0 then null else cast(1 + cast(floor(value) as bigint) % 5 as int) end as rating,
 case when event_id % 7 = 0 then null else cast(1 + cast(floor(value * 3) as bigint) % 5 as int) end as accuracy_rating,
 case when event_id % 13 = 0 then null else cast(1 + cast(floor(value * 5) as bigint) % 5 as int) end as speed_rating,
 case when event_id % 17 = 0 then null else cast(1 + cast(floor(value * 7) as bigint) % 5 as int) end as quality_rating,
 case event_type when 'purchase' then 'positive' when 'error' then 'negative' when 'view' then 'neutral' else 'unknown' end as feedback_type,
 case user_id % 3 when 0 then 'anthropic.claude-3-sonnet-20240229-v1:0' when 1 then 'openai.gpt-oss-120b-1:0' else 'anthropic.claude-3-haiku-20240307-v1:0' end as model_id,
 case when event_type in ('error','purchase') then 'comment ' || cast(event_id as varchar) else '' end as comment
from events
"""

MODELS_SQL = r"""
select 1 as model_ord, 'anthropic.claude-3-sonnet-20240229-v1:0' as model_id
union all select 2, 'openai.gpt-oss-120b-1:0'
union all select 3, 'anthropic.claude-3-haiku-20240307-v1:0'
"""

MODEL_RESULTS_SQL = r"""
select 'claim_' || lpad(cast(o_orderkey as varchar),8,'0') as claim_name, m.model_ord, m.model_id,
 (o_orderkey + m.model_ord) % 7 <> 0 as success,
 cast((o_orderkey * (m.model_ord + 3)) % 500 as double) / 100 as time_seconds,
 case when (o_orderkey + m.model_ord) % 7 <> 0 then 'Summary of ' || repeat('x', cast((o_orderkey * 13 + m.model_ord * 101) % 420 as int)) end as summary,
 case when (o_orderkey + m.model_ord) % 7 = 0 then 'throttled' end as error
from orders cross join models m
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named derived views."""
    defs = {
        "claims": CLAIMS_SQL,
        "feedback": FEEDBACK_SQL,
        "models": MODELS_SQL,
        "model_results": MODEL_RESULTS_SQL,
    }
    needed = list(names)
    if "model_results" in needed and "models" not in needed:
        needed.insert(needed.index("model_results"), "models")
    ctes = ",\n".join(f"{n} as ({defs[n].strip()})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
