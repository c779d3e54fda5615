"""Registered feedback-analytics queries over the ``feedback`` view."""

from __future__ import annotations

from claimflow.operators import feedback as fb
from claimflow.plans.registry import query
from claimflow.sources import views


def _fb(spark, sf_dir):
    return views.feedback(spark, sf_dir)


def _truthy(c):
    return f"case when {c} <> 0 then {c} end"


def _mean_sql(s, n):
    return f"coalesce(cast({s} as double) / cast(case when {n} > 0 then {n} end as double), 0.0)"


def _shown_sql(s, n):
    return f"round_even({_mean_sql(s, n)}, 2)"


@query("feedback_stats", views.with_views(
    f"""select count(*) as total, count({_truthy('rating')}) as n_ratings,
 cast(coalesce(sum({_truthy('rating')}), 0) as bigint) as rating_sum,
 {_mean_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_rating,
 {_shown_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_shown from feedback""",
    "feedback"))
def feedback_stats(spark, sf_dir):
    """A1: total, rating count/sum and mean of truthy ratings."""
    return fb.feedback_stats(_fb(spark, sf_dir))


@query("feedback_by_type", views.with_views(
    "select feedback_type, count(*) as n_feedback from feedback group by feedback_type", "feedback"))
def feedback_by_type(spark, sf_dir):
    """A2: entries per feedback type."""
    return fb.by_type(_fb(spark, sf_dir))


@query("feedback_report_overall", views.with_views(
    f"""select {_mean_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_rating,
 {_shown_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_shown,
 count({_truthy('rating')}) as total_ratings, cast(coalesce(sum({_truthy('rating')}), 0) as bigint) as rating_sum
from feedback""", "feedback"))
def feedback_report_overall(spark, sf_dir):
    """A3: overall block of the feedback report."""
    return fb.report_overall(_fb(spark, sf_dir))


def _dims_sql():
    parts = []
    for i, (name, col) in enumerate(fb.DIMENSIONS, start=1):
        t = _truthy(col)
        parts.append(f"select '{name}' as dimension, {i} as dim_ord, count({t}) as count, "
                     f"cast(coalesce(sum({t}), 0) as bigint) as rating_sum, "
                     f"{_mean_sql(f'sum({t})', f'count({t})')} as average, "
                     f"{_shown_sql(f'sum({t})', f'count({t})')} as average_shown from feedback")
    return views.with_views(" union all ".join(parts), "feedback")


@query("feedback_dimensions", _dims_sql())
def feedback_dimensions(spark, sf_dir):
    """A4: accuracy / speed / quality means and counts."""
    return fb.dimensions(_fb(spark, sf_dir))


@query("feedback_by_model", views.with_views(
    f"""select model_id, count(*) as count, count({_truthy('rating')}) as n_ratings,
 cast(coalesce(sum({_truthy('rating')}), 0) as bigint) as rating_sum,
 {_mean_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_rating,
 {_shown_sql(f"sum({_truthy('rating')})", f"count({_truthy('rating')})")} as average_shown
from feedback group by model_id""", "feedback"))
def feedback_by_model(spark, sf_dir):
    """A5: per-model entry count and mean rating."""
    return fb.by_model(_fb(spark, sf_dir))


@query("recent_comments", views.with_views(
    """select id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, comment, rating
from feedback where coalesce(comment, '') <> '' order by timestamp desc, id asc limit 10""", "feedback"))
def recent_comments(spark, sf_dir):
    """K1: the 10 newest commented entries."""
    from pyspark.sql import functions as F
    r = fb.recent_comments(_fb(spark, sf_dir))
    return r.select("id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                    "comment", "rating")


@query("feedback_stamp", views.with_views(
    """select strftime(timestamp, '%Y%m%d_%H%M%S_%f') as id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') as timestamp,
 rating, feedback_type, model_id, coalesce(comment, '') as comment from feedback""", "feedback"))
def feedback_stamp(spark, sf_dir):
    """Submit-time id and ISO timestamp, default empty comment."""
    f = _fb(spark, sf_dir).select("timestamp", "rating", "feedback_type", "model_id", "comment")
    return fb.stamp_feedback(f)


def _report_sql():
    t = _truthy("rating")
    none = "cast(null as bigint), cast(null as double), cast(null as double), cast(null as varchar)"

    def mean(c):
        return f"{_mean_sql(f'sum({c})', f'count({c})')}, {_shown_sql(f'sum({c})', f'count({c})')}, cast(null as varchar)"
    blocks = [
        "select 'total' as section, case when count(*) = 0 then 'No feedback data available' end as key, "
        "count(*) as n, cast(null as bigint) as rating_sum, cast(null as double) as average, "
        "cast(null as double) as shown, cast(null as varchar) as comment from feedback",
        f"select 'overall', cast(null as varchar), count({t}), cast(coalesce(sum({t}), 0) as bigint), {mean(t)} from feedback",
    ]
    for name, col in fb.DIMENSIONS:
        d = _truthy(col)
        blocks.append(f"select 'detailed', '{name}', count({d}), cast(coalesce(sum({d}), 0) as bigint), {mean(d)} from feedback")
    blocks.append(f"select 'by_type', feedback_type, count(*), {none} from feedback group by feedback_type")
    blocks.append(f"select 'by_model', model_id, count(*), cast(coalesce(sum({t}), 0) as bigint), {mean(t)} "
                  "from feedback group by model_id")
    blocks.append(f"select 'recent_comments', id, row_number() over (order by timestamp desc, id), "
                  "cast(null as bigint), cast(null as double), cast(null as double), comment from (select * from feedback "
                  "where coalesce(comment, '') <> '' order by timestamp desc, id limit 10)")
    return views.with_views(" union all ".join(blocks), "feedback")


@query("feedback_report", _report_sql())
def feedback_report(spark, sf_dir):
    """The full feedback report in long form, recent comments included."""
    return fb.full_report(_fb(spark, sf_dir))
