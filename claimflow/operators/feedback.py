"""User-feedback analytics.

Input rows have the entry fields ``id, timestamp, rating, accuracy_rating,
speed_rating, quality_rating, feedback_type, model_id, comment``. Means use
only *truthy* ratings (null and 0 excluded) while totals count every entry;
``sum`` and ``count`` are kept next to each mean so reports can round for
display without losing the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = (("accuracy", "accuracy_rating"), ("speed", "speed_rating"), ("quality", "quality_rating"))
RECENT_COMMENTS = 10


def _truthy(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def _mean(sum_col: Column, n_col: Column) -> Column:
    return F.coalesce(sum_col.cast("double") / F.when(n_col > 0, n_col).cast("double"), F.lit(0.0))


def _shown(mean: Column) -> Column:
    """A mean as reports show it: two decimals, exact halves to the even digit."""
    return F.bround(mean, 2)


def stamp_feedback(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Id ``yyyyMMdd_HHmmss_ffffff`` from the submit time, ISO timestamp
    string, empty comment when none was given."""
    return df.select(
        F.date_format(ts_col, "yyyyMMdd_HHmmss_SSSSSS").alias("id"),
        F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        *[c for c in df.columns if c not in ("id", "timestamp", "comment")],
        F.coalesce(F.col("comment"), F.lit("")).alias("comment"),
    )


def feedback_stats(df: DataFrame) -> DataFrame:
    """A1: total entries, truthy-rating count and sum, mean (0 when none)."""
    r = _truthy("rating")
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count(r).alias("n_ratings"),
                 F.sum(r).cast("bigint").alias("rating_sum"))
    mean = _mean(F.col("rating_sum"), F.col("n_ratings"))
    return agg.select("total", "n_ratings", F.coalesce("rating_sum", F.lit(0)).cast("bigint").alias("rating_sum"),
                      mean.alias("average_rating"), _shown(mean).alias("average_shown"))


def by_type(df: DataFrame) -> DataFrame:
    """A2: entries per feedback type."""
    return df.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n_feedback"))


def report_overall(df: DataFrame) -> DataFrame:
    """A3: overall mean rating and number of ratings."""
    r = _truthy("rating")
    agg = df.agg(F.count(r).alias("total_ratings"), F.sum(r).cast("bigint").alias("rating_sum"))
    mean = _mean(F.col("rating_sum"), F.col("total_ratings"))
    return agg.select(mean.alias("average_rating"), _shown(mean).alias("average_shown"), "total_ratings", F.coalesce("rating_sum", F.lit(0)).cast("bigint").alias("rating_sum"))


def dimensions(df: DataFrame) -> DataFrame:
    """A4: accuracy / speed / quality means with their own counts, one pass
    of conditional aggregates, then ``stack`` to long form."""
    aggs = []
    for name, col in DIMENSIONS:
        aggs += [F.count(_truthy(col)).alias(f"n_{name}"), F.sum(_truthy(col)).cast("bigint").alias(f"s_{name}")]
    wide = df.agg(*aggs)
    stacked = ", ".join(f"'{n}', {i}, n_{n}, s_{n}" for i, (n, _c) in enumerate(DIMENSIONS, start=1))
    long = wide.selectExpr(f"stack({len(DIMENSIONS)}, {stacked}) as (dimension, dim_ord, n, s)")
    return long.select("dimension", F.col("dim_ord").cast("int").alias("dim_ord"),
                       F.col("n").cast("bigint").alias("count"),
                       F.coalesce("s", F.lit(0)).cast("bigint").alias("rating_sum"),
                       _mean(F.col("s"), F.col("n")).alias("average"),
                       _shown(_mean(F.col("s"), F.col("n"))).alias("average_shown"))


def by_model(df: DataFrame) -> DataFrame:
    """A5: per model, all entries and the mean of its truthy ratings."""
    r = _truthy("rating")
    agg = df.groupBy("model_id").agg(F.count(F.lit(1)).alias("count"), F.count(r).alias("n_ratings"),
                                     F.sum(r).cast("bigint").alias("rating_sum"))
    return agg.select("model_id", "count", "n_ratings",
                      F.coalesce("rating_sum", F.lit(0)).cast("bigint").alias("rating_sum"),
                      _mean(F.col("rating_sum"), F.col("n_ratings")).alias("average_rating"),
                      _shown(_mean(F.col("rating_sum"), F.col("n_ratings"))).alias("average_shown"))


def recent_comments(df: DataFrame, n: int = RECENT_COMMENTS) -> DataFrame:
    """K1: newest ``n`` entries with a non-empty comment; ties by id. A
    top-k (TakeOrderedAndProject): each partition keeps its best ``n``."""
    return (df.where(F.coalesce(F.col("comment"), F.lit("")) != "")
              .orderBy(F.col("timestamp").desc(), F.col("id").asc())
              .limit(n))


def full_report(df: DataFrame) -> DataFrame:
    """The whole report in long form, one row per (section, key):
    ``total``, ``overall``, ``detailed`` (per dimension), ``by_type``,
    ``by_model`` and ``recent_comments`` (key: the entry's id, n: its rank,
    comment: its text). The counts take one scan and one shuffle: ``GROUPING
    SETS`` over ``(feedback_type)``, ``(model_id)`` and ``()``, then the global
    row is unpivoted into its sections. Means also come with two decimals
    (``shown``). An empty input yields the ``total`` row with 0 and the
    message."""
    r = _truthy("rating")
    aggs = [F.count(F.lit(1)).alias("n_all"), F.count(r).alias("n_r"), F.sum(r).cast("bigint").alias("s_r")]
    for name, col in DIMENSIONS:
        aggs += [F.count(_truthy(col)).alias(f"n_{name}"), F.sum(_truthy(col)).cast("bigint").alias(f"s_{name}")]
    g = df.groupingSets([["feedback_type"], ["model_id"], []], "feedback_type", "model_id") \
        .agg(*aggs, F.grouping_id().alias("gid"))
    # gid bits: feedback_type is the high bit, model_id the low bit.
    def entry(section, key, n, s=None, n_rated=None):
        n_rated = n if n_rated is None else n_rated
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("bigint").alias("n"),
                        (F.coalesce(s, F.lit(0)) if s is not None else F.lit(None)).cast("bigint").alias("rating_sum"),
                        (_mean(s, n_rated) if s is not None else F.lit(None)).cast("double").alias("average"),
                        (_shown(_mean(s, n_rated)) if s is not None else F.lit(None)).cast("double").alias("shown"),
                        F.lit(None).cast("string").alias("comment"))
    total = F.array(
        entry("total", F.when(F.col("n_all") == 0, F.lit("No feedback data available")), F.col("n_all")),
        entry("overall", F.lit(None), F.col("n_r"), F.col("s_r")),
        *[entry("detailed", F.lit(name), F.col(f"n_{name}"), F.col(f"s_{name}")) for name, _c in DIMENSIONS])
    rows = (F.when(F.col("gid") == 3, total)
             .when(F.col("gid") == 1, F.array(entry("by_type", F.col("feedback_type"), F.col("n_all"))))
             .otherwise(F.array(entry("by_model", F.col("model_id"), F.col("n_all"), F.col("s_r"), F.col("n_r")))))
    ranked = recent_comments(df).withColumn(
        "n", F.row_number().over(Window.orderBy(F.col("timestamp").desc(), F.col("id"))))  # ten rows
    comments = ranked.select(
        F.lit("recent_comments").alias("section"), F.col("id").cast("string").alias("key"), F.col("n").cast("bigint").alias("n"),
        F.lit(None).cast("bigint").alias("rating_sum"), F.lit(None).cast("double").alias("average"),
        F.lit(None).cast("double").alias("shown"), "comment")
    return g.select(F.inline(rows)).unionByName(comments)


def report_record(df: DataFrame) -> DataFrame:
    """A6 as one nested record: the sections of :func:`full_report` by name,
    each a list of its entries in key order (comments: newest first)."""
    rows = full_report(df).select("section", F.struct(
        F.when(F.col("section") == "recent_comments", F.col("n")).alias("rank"), "key", "n",
        F.col("shown").alias("average"), "comment").alias("entry"))
    per = rows.groupBy("section").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return per.select("section", F.to_json("entries").alias("entries"))
