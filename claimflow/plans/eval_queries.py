"""Registered model-evaluation queries over the ``model_results`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import evaluation as ev
from claimflow.plans.claim_queries import _title_sql
from claimflow.plans.registry import query
from claimflow.sources import views

N_MODELS = len(views.DEFAULT_MODELS)


def _results(spark, sf_dir):
    return views.model_results(spark, sf_dir)


def _models_df(spark):
    return spark.createDataFrame(list(enumerate(views.DEFAULT_MODELS, start=1)), "model_ord int, model_id string")


def _short_sql(x):
    return (f"upper(substr(split_part(list_last(string_split({x}, '.')), '-', 1), 1, 1)) || "
            f"lower(substr(split_part(list_last(string_split({x}, '.')), '-', 1), 2))")


def _provider_sql(x):
    return f"upper(substr(split_part({x}, '.', 1), 1, 1)) || lower(substr(split_part({x}, '.', 1), 2))"


def _tail_sql(x):
    return f"list_last(string_split({x}, '.'))"


@query("eval_totals", views.with_views(
    f"""with per as (select claim_name, count(*) filter (where success) as ok from model_results group by claim_name)
select cast(count(*) as bigint) as claims, cast(count(*) * {N_MODELS} as bigint) as total_tests,
 cast(coalesce(sum(ok), 0) as bigint) as successful,
 cast(count(*) * {N_MODELS} - coalesce(sum(ok), 0) as bigint) as failed,
 case when count(*) > 0 then coalesce(sum(ok), 0) * 100.0 / (count(*) * {N_MODELS}) end as success_rate_pct from per""",
    "model_results"))
def eval_totals(spark, sf_dir):
    """Tests, successes, failures, success rate."""
    return ev.eval_totals(_results(spark, sf_dir), _models_df(spark))


@query("eval_model_timing", views.with_views(
    f"""with st as (select model_id, count(*) filter (where success) as n_success,
  sum(case when success then cast(round(time_seconds * 100) as bigint) end) as sum_centis,
  min(case when success then time_seconds end) as min_time, max(case when success then time_seconds end) as max_time
  from model_results group by model_id)
select m.model_ord, m.model_id, {_short_sql('m.model_id')} as model_short,
 cast(coalesce(n_success, 0) as bigint) as n_success, cast(sum_centis as bigint) as sum_centis,
 case when coalesce(n_success, 0) > 0 then cast(sum_centis as double) / cast(n_success as double) / 100.0 end as avg_time,
 min_time, max_time from models m left join st using (model_id)""", "models", "model_results"))
def eval_model_timing(spark, sf_dir):
    """Per-model timing over successful runs; every model listed."""
    return ev.model_timing(_results(spark, sf_dir), _models_df(spark))


@query("eval_quality", views.with_views(
    "select claim_name, model_ord, case when not success then 'N/A' when length(summary) > 200 then 'Good' "
    "else 'Brief' end as quality from model_results", "model_results"))
def eval_quality(spark, sf_dir):
    """Quality label per result."""
    r = _results(spark, sf_dir)
    return r.select("claim_name", "model_ord",
                    ev.quality_label("success", F.when(F.col("success"), F.length("summary"))).alias("quality"))


def _grid_sql():
    cols = []
    for k in range(1, N_MODELS + 1):
        cols += [
            f"max(case when model_ord = {k} then case when success then 'Success' else 'Failed' end end) as status_{k}",
            f"max(case when model_ord = {k} then time_seconds end) as time_{k}",
            f"max(case when model_ord = {k} and success then cast(length(summary) as bigint) end) as length_{k}",
            f"max(case when model_ord = {k} then case when not success then 'N/A' when length(summary) > 200 "
            f"then 'Good' else 'Brief' end end) as quality_{k}",
        ]
    return views.with_views(f"select claim_name, {', '.join(cols)} from model_results group by claim_name",
                            "model_results")


@query("eval_grid", _grid_sql())
def eval_grid(spark, sf_dir):
    """A10: per-claim result grid (status, time, length, quality per model)."""
    return ev.result_grid(_results(spark, sf_dir), views.DEFAULT_MODELS)


@query("eval_example", views.with_views(
    f"""select claim_name, arg_min(model_ord, model_ord) as model_ord,
 {_short_sql('arg_min(model_id, model_ord)')} as model_short,
 case when length(arg_min(summary, model_ord)) > 300 then substr(arg_min(summary, model_ord), 1, 300) || '...'
      else arg_min(summary, model_ord) end as example_summary
from model_results where success group by claim_name""", "model_results"))
def eval_example(spark, sf_dir):
    """K2 + X2: first successful model's summary per claim, 300-char preview."""
    return ev.first_success(_results(spark, sf_dir))


@query("fastest_model", views.with_views(
    f"""select claim_name, arg_min(model_id, (time_seconds, model_ord)) as model_id,
 {_tail_sql('arg_min(model_id, (time_seconds, model_ord))')} as model_name,
 min(time_seconds) as time_seconds
from model_results where success group by claim_name""", "model_results"))
def fastest_model(spark, sf_dir):
    """K3: fastest successful model per claim (ties: earlier model)."""
    return ev.fastest(_results(spark, sf_dir))


@query("compare_rows", views.with_views(
    "select claim_name, model_ord, model_id, success, round(time_seconds, 2) as time_seconds, "
    "case when success then cast(length(summary) as bigint) end as summary_length, "
    "case when not success then error end as error from model_results", "model_results"))
def compare_rows(spark, sf_dir):
    """Comparison fields per (claim, model)."""
    return ev.comparison_rows(_results(spark, sf_dir))


@query("models_compared", views.with_views(
    "select claim_name, count(*) as models_compared from model_results group by claim_name", "model_results"))
def models_compared(spark, sf_dir):
    """Number of models compared per document."""
    return _results(spark, sf_dir).groupBy("claim_name").agg(F.count(F.lit(1)).alias("models_compared"))


@query("preview_200", views.with_views(
    "select claim_name, model_ord, substr(summary, 1, 200) || '...' as preview from model_results where success",
    "model_results"))
def preview_200(spark, sf_dir):
    """Comparison preview, 200 characters and ``...`` always."""
    r = _results(spark, sf_dir).where("success")
    return r.select("claim_name", "model_ord", ev.preview("summary", 200, True).alias("preview"))


@query("model_names", views.with_views(
    f"select model_id, {_short_sql('model_id')} as model_short, {_provider_sql('model_id')} as provider, "
    "count(*) as n_feedback from feedback group by model_id", "feedback"))
def model_names(spark, sf_dir):
    """Short name and provider of every model that has feedback, with its entries."""
    return (views.feedback(spark, sf_dir).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_feedback"))
            .select("model_id", ev.short_model_name("model_id").alias("model_short"),
                    ev.provider_name("model_id").alias("provider"), "n_feedback"))


@query("quick_compare", views.with_views(
    f"select claim_name, model_ord, {_tail_sql('model_id')} as model_name, "
    "case when success then cast(time_seconds as varchar) else 'FAILED' end as time_text, "
    "case when success then cast(length(summary) as varchar) else '-' end as length_text from model_results",
    "model_results"))
def quick_compare(spark, sf_dir):
    """Quick comparison table rows."""
    return ev.quick_compare(_results(spark, sf_dir))


@query("title_names", views.with_views(
    f"select claim_id, {_title_sql(chr(39) + 'claim_' + chr(39) + ' || lpad(cast(claim_id as varchar), 8, ' + chr(39) + '0' + chr(39) + ')')} "
    "as claim_title from claims", "claims"))
def title_names(spark, sf_dir):
    """Claim name from the document key, title-cased."""
    c = views.claims(spark, sf_dir)
    name = F.regexp_replace(F.element_at(F.split("input_key", "/"), -1), r"\.txt$", "")
    return c.select("claim_id", F.initcap(F.regexp_replace(name, "_", " ")).alias("claim_title"))


@query("doc_model_grid", views.with_views(
    "select c.claim_id, m.model_ord, m.model_id, c.input_key from claims c cross join models m", "claims", "models"))
def doc_model_grid(spark, sf_dir):
    """Every claim with every configured model. The model list is a
    literal array exploded per row: no join, no shuffle."""
    c = views.claims(spark, sf_dir)
    return c.select("claim_id", F.inline(views.model_list()), "input_key")


@query("comparison_report", views.with_views(
    """select claim_name, 'Model Comparison Report' || chr(10) || repeat('=', 50) || chr(10) || chr(10) ||
 string_agg('Model: ' || model_id || chr(10) || 'Status: ' || case when success then 'Success' else 'Failed' end
   || chr(10) || 'Processing Time: ' || cast(time_seconds as varchar) || 's' || chr(10) ||
   case when success then 'Summary Length: ' || cast(length(summary) as varchar) || ' chars' || chr(10) ||
        'Summary: ' || substr(summary, 1, 200) || '...' || chr(10)
   else 'Error: ' || error || chr(10) end || chr(10) || repeat('-', 50) || chr(10) || chr(10), '' order by model_ord)
 as report from model_results group by claim_name""", "model_results"))
def comparison_report(spark, sf_dir):
    """Comparison report text per claim, model blocks in model order."""
    return ev.comparison_report(_results(spark, sf_dir))


@query("parse_models", views.with_views(
    """select id, case when comment = '' then 'anthropic.claude-3-sonnet-20240229-v1:0|openai.gpt-oss-120b-1:0|anthropic.claude-3-haiku-20240307-v1:0'
 else array_to_string(list_transform(string_split(model_id || ' , ' || feedback_type, ','), lambda m: trim(m)), '|') end as models
from feedback""", "feedback"))
def parse_models(spark, sf_dir):
    """Requested-model strings parsed to trimmed lists; empty -> defaults.
    The request string is the entry's model plus its feedback type, empty
    when the entry has no comment."""
    f = views.feedback(spark, sf_dir)
    s = F.when(F.col("comment") == "", F.lit("")).otherwise(F.concat_ws(" , ", "model_id", "feedback_type"))
    return f.select("id", F.array_join(ev.parse_model_list(s, views.DEFAULT_MODELS), "|").alias("models"))


def _report_lines_sql():
    title = "array_to_string(list_transform(string_split(claim_name, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    nul = "cast(null as varchar)"

    def fixed(section, *texts):
        k = ev.SECTIONS.index(section)
        return [f"select {k} as section_ord, '{section}' as section, {nul} as claim_name, {o} as ord, {t} as line from tot"
                for o, t in enumerate(texts, start=1)]
    two = "printf('%.2f', {})".format
    parts = [
        *fixed("header", f"'{ev.REPORT_TITLE}'", f"'**Models Evaluated:** ' || {N_MODELS}", "'**Claims Tested:** ' || claims"),
        *fixed("summary", "'## Executive Summary'", "'- **Total Tests Run:** ' || tests", "'- **Successful:** ' || ok",
               "'- **Failed:** ' || (tests - ok)", "'- **Success Rate:** ' || printf('%.1f', ok * 100.0 / tests) || '%'"),
        f"select 2, 'models', {nul}, model_ord * 2, model_ord || '. **' || {_short_sql('model_id')} || '** (' || "
        f"{_provider_sql('model_id')} || ')' from models",
        f"select 2, 'models', {nul}, model_ord * 2 + 1, '   - Model ID: `' || model_id || '`' from models",
        f"select 3, 'claims', claim_name, 1, '### ' || {title} from c",
        *[f"select 3, 'claims', claim_name, {o}, '{t}' from c" for o, t in enumerate(ev.CLAIM_TABLE, start=2)],
        f"""select 3, 'claims', claim_name, model_ord + 10, '| ' || {_short_sql('model_id')} || ' | ' ||
 case when success then 'Success' else 'Failed' end || ' | ' || cast(time_seconds as varchar) || ' | ' ||
 case when success then length(summary) || ' chars' else 'N/A' end || ' | ' ||
 case when not success then 'N/A' when length(summary) > 200 then 'Good' else 'Brief' end || ' |' from model_results""",
        f"select 3, 'claims', claim_name, 1000000, '**Example Summary (' || {_short_sql('model_id')} || '):**' from ex",
        "select 3, 'claims', claim_name, 1000001, '> ' || case when length(summary) > 300 then substr(summary, 1, 300) || '...' "
        "else summary end from ex",
        *fixed("timing", "'## Performance Comparison'", *[f"'{t}'" for t in ev.TIMING_TABLE]),
        f"select 4, 'timing', {nul}, model_ord + 10, '| ' || {_short_sql('model_id')} || ' | ' || "
        f"{two('sum_centis / n / 100.0')} || ' | ' || {two('lo')} || ' | ' || {two('hi')} || ' | ' || n || ' |' from st",
    ]
    return views.with_views(
        f"""with c as (select distinct claim_name from model_results),
tot as (select (select count(*) from c) as claims, (select count(*) from c) * {N_MODELS} as tests,
  (select count(*) from model_results where success) as ok),
ex as (select claim_name, arg_min(model_id, model_ord) as model_id, arg_min(summary, model_ord) as summary
  from model_results where success group by claim_name),
st as (select model_ord, model_id, count(*) as n, cast(sum(cast(round(time_seconds * 100) as bigint)) as double) as sum_centis,
  min(time_seconds) as lo, max(time_seconds) as hi from model_results where success group by model_ord, model_id)
""" + " union all ".join(parts), "models", "model_results")


@query("eval_report_lines", _report_lines_sql())
def eval_report_lines(spark, sf_dir):
    """Every line of the evaluation report with its place in it."""
    return ev.report_lines(_results(spark, sf_dir), _models_df(spark))


@query("eval_nested", views.with_views(
    """select claim_name, '{' || string_agg('"' || model_id || '":' || case when success then
  '{"success":true,"time_seconds":' || cast(time_seconds as varchar) || ',"summary":"' || summary || '","summary_length":' || length(summary) || '}'
 else '{"success":false,"time_seconds":' || cast(time_seconds as varchar) || ',"error":"' || error || '"}' end, ',' order by model_id)
 || '}' as json from model_results group by claim_name""", "model_results"))
def eval_nested(spark, sf_dir):
    """The nested results (claim, model, result) as one JSON document per claim."""
    from claimflow.sources import sinks
    return sinks.nest_results(_results(spark, sf_dir))
