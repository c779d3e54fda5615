"""Model-evaluation analytics over a long results table.

Input: one row per (claim, model) with ``claim_name, model_ord, model_id,
success, time_seconds, summary, error``. All reports are single-level hash
aggregations (partial aggregation before the shuffle) or projections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.sources.staging import staged


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_model_name(model_id) -> Column:
    """The first dash-separated word behind the last dot, capitalised (e.g. ``Claude``)."""
    tail = F.element_at(F.split(_c(model_id), r"\."), -1)
    return F.initcap(F.element_at(F.split(tail, "-"), 1))


def provider_name(model_id) -> Column:
    """What stands before the first dot, capitalised (e.g. ``Anthropic``)."""
    return F.initcap(F.element_at(F.split(_c(model_id), r"\."), 1))


def model_tail(model_id) -> Column:
    """What stands behind the last dot, as the quick comparison table prints it."""
    return F.element_at(F.split(_c(model_id), r"\."), -1)


def quality_label(success, summary_length) -> Column:
    """``Good`` above 200 characters, else ``Brief``; failures ``N/A``."""
    return (F.when(~_c(success), F.lit("N/A"))
             .when(_c(summary_length) > 200, F.lit("Good"))
             .otherwise(F.lit("Brief")))


def preview(text, n: int, always_ellipsis: bool) -> Column:
    """X1 (first 200 + ``...`` always) and X2 (``...`` only when cut)."""
    t = _c(text)
    head = F.substring(t, 1, n)
    if always_ellipsis:
        return F.concat(head, F.lit("..."))
    return F.when(F.length(t) > n, F.concat(head, F.lit("..."))).otherwise(t)


def comparison_rows(results: DataFrame) -> DataFrame:
    """Per (claim, model) the reported fields of a comparison."""
    return results.select(
        "claim_name", "model_ord", "model_id", "success",
        F.round("time_seconds", 2).alias("time_seconds"),
        F.when(F.col("success"), F.length("summary")).cast("bigint").alias("summary_length"),
        F.when(~F.col("success"), F.col("error")).alias("error"),
    )


def eval_totals(results: DataFrame, models: DataFrame) -> DataFrame:
    """tests = claims x models, successes, failures, success rate.

    A (claim, model) pair counts once, by its last result, and only models of
    ``models`` (``model_ord, model_id``) count. A claim that failed as a whole
    (a row without a model) is a claim without successes. An empty run yields
    a null rate instead of dividing by zero."""
    listed = models.select("model_id", F.lit(True).alias("listed"))
    pairs = one_per_model(results.select("claim_name", "model_id", "success"), ("claim_name", "model_id"))
    per_claim = pairs.join(F.broadcast(listed), "model_id", "left").groupBy("claim_name").agg(
        F.count_if(F.col("success") & F.coalesce("listed", F.lit(False))).alias("ok"))
    agg = per_claim.agg(F.count(F.lit(1)).alias("claims"), F.sum("ok").alias("ok"))
    tests = F.col("claims") * models.agg(F.count(F.lit(1))).scalar()
    ok = F.coalesce(F.col("ok"), F.lit(0)).cast("bigint")
    return agg.select(
        F.col("claims").cast("bigint").alias("claims"),
        tests.cast("bigint").alias("total_tests"),
        ok.alias("successful"),
        (tests - ok).cast("bigint").alias("failed"),
        F.when(tests > 0, ok * 100.0 / tests).alias("success_rate_pct"),
    )


def model_timing(results: DataFrame, models: DataFrame) -> DataFrame:
    """avg/min/max/count of successful times per model; every model of
    ``models`` (``model_ord, model_id``) is listed, with nulls and 0 when it
    never succeeded. ``sum_centis`` is exact, ``avg_time`` is derived from it."""
    ok = F.col("success")
    t = F.col("time_seconds")
    stats = results.groupBy("model_id").agg(
        F.count_if(ok).cast("bigint").alias("n_success"),
        F.sum(F.when(ok, F.round(t * 100).cast("bigint"))).alias("sum_centis"),
        F.min(F.when(ok, t)).alias("min_time"),
        F.max(F.when(ok, t)).alias("max_time"),
    )
    # The model list is driver-sized (one row per configured model).
    out = F.broadcast(models).join(stats, "model_id", "left")
    n = F.coalesce(F.col("n_success"), F.lit(0)).cast("bigint")
    return out.select(
        "model_ord", "model_id", short_model_name("model_id").alias("model_short"),
        n.alias("n_success"),
        F.col("sum_centis").cast("bigint").alias("sum_centis"),
        F.when(n > 0, F.col("sum_centis").cast("double") / n.cast("double") / 100.0).alias("avg_time"),
        "min_time", "max_time",
    )


def result_grid(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """A10: one row per claim, status/time/length/quality for each configured
    model (a pivot written as conditional aggregates: one shuffle on the
    claim). A result of a model that is not configured is an error, so no
    column is lost without notice."""
    ok = F.col("success")
    length = F.when(ok, F.length("summary")).cast("bigint")
    unknown = F.raise_error(F.concat(F.lit("result of a model that is not configured: "), F.col("model_ord").cast("string")))
    ordinal = F.when(F.col("model_ord").between(1, len(models)), F.col("model_ord")).otherwise(unknown.cast("int"))
    aggs = []
    for k in range(1, len(models) + 1):
        is_k = F.col("model_ord") == k
        aggs += [
            F.max(F.when(is_k, F.when(ok, "Success").otherwise("Failed"))).alias(f"status_{k}"),
            F.max(F.when(is_k, F.col("time_seconds"))).alias(f"time_{k}"),
            F.max(F.when(is_k, length)).alias(f"length_{k}"),
            F.max(F.when(is_k, quality_label(ok, length))).alias(f"quality_{k}"),
        ]
    return results.withColumn("model_ord", ordinal).groupBy("claim_name").agg(*aggs)


def first_success(results: DataFrame, preview_chars: int = 300) -> DataFrame:
    """K2 + X2: per claim the example summary of the first successful model
    (model order). ``min_by`` aggregates partially before the shuffle, so only
    one candidate per claim and partition crosses the network."""
    best = (results.where("success")
            .groupBy("claim_name")
            .agg(F.min_by(F.struct("model_ord", "model_id", "summary"), F.col("model_ord")).alias("b")))
    return best.select("claim_name", F.col("b.model_ord").alias("model_ord"),
                       short_model_name("b.model_id").alias("model_short"),
                       preview("b.summary", preview_chars, False).alias("example_summary"))


def fastest(results: DataFrame) -> DataFrame:
    """K3: fastest successful model per claim; ties go to the earlier model."""
    best = (results.where("success")
            .groupBy("claim_name")
            .agg(F.min_by(F.struct("model_ord", "model_id", "time_seconds"),
                          F.struct("time_seconds", "model_ord")).alias("b")))
    return best.select("claim_name", F.col("b.model_id").alias("model_id"),
                       model_tail("b.model_id").alias("model_name"),
                       F.col("b.time_seconds").alias("time_seconds"))


def quick_compare(results: DataFrame) -> DataFrame:
    """Model / time / length, or FAILED and ``-``."""
    ok = F.col("success")
    return results.select(
        "claim_name", "model_ord", model_tail("model_id").alias("model_name"),
        F.when(ok, F.col("time_seconds").cast("string")).otherwise(F.lit("FAILED")).alias("time_text"),
        F.when(ok, F.length("summary").cast("string")).otherwise(F.lit("-")).alias("length_text"),
    )


def comparison_report(results: DataFrame) -> DataFrame:
    """The comparison report text per claim, model blocks in model order.
    The blocks of one claim are bounded by the model list."""
    # The wording of the report.
    ok = F.col("success")
    block = F.concat(
        F.lit("Model: "), F.col("model_id"), F.lit("\n"),
        F.lit("Status: "), F.when(ok, "Success").otherwise("Failed"), F.lit("\n"),
        F.lit("Processing Time: "), F.col("time_seconds").cast("string"), F.lit("s\n"),
        F.when(ok, F.concat(F.lit("Summary Length: "), F.length("summary").cast("string"), F.lit(" chars\n"),
                            F.lit("Summary: "), preview("summary", 200, True), F.lit("\n")))
        .otherwise(F.concat(F.lit("Error: "), F.col("error"), F.lit("\n"))),
        F.lit("\n" + "-" * 50 + "\n\n"),
    )
    per = one_per_model(results.select("claim_name", "model_ord", block.alias("block"))) \
        .groupBy("claim_name").agg(F.array_sort(F.collect_list(F.struct("model_ord", "block"))).alias("blocks"))
    return per.select("claim_name", F.concat(
        F.lit("Model Comparison Report\n" + "=" * 50 + "\n\n"),
        F.array_join(F.transform("blocks", lambda b: b["block"]), "")).alias("report"))


def one_per_model(results: DataFrame, key=("claim_name", "model_ord"), order: str | None = None) -> DataFrame:
    """The last row of each (claim, model): the greatest ``order``, and of
    equals (or without an order column) the greatest row. The aggregation is
    partial (map-side), so duplicates of a hot claim collapse before the
    shuffle, and a claim's rows are bounded by the model list."""
    payload = [c for c in results.columns if c not in key]
    last = F.struct(*([order] if order else []), *[c for c in payload if c != order])
    best = results.groupBy(*key).agg(F.max(last).alias("__last"))
    return best.select(*key, *[F.col("__last")[c].alias(c) for c in payload])


def compare_pairs(results: DataFrame) -> DataFrame:
    """Every pair of successful results of one claim, the earlier model
    first. One shuffle: a claim's results become a list in model order (its
    length is the number of models), which is exploded to pairs."""
    item = F.struct("model_ord", "model_id", "summary")
    per = results.where("success").groupBy("claim_name").agg(F.array_sort(F.collect_list(item)).alias("all"))
    # Of several results of a model the last in order stays.
    per = per.select("claim_name", F.filter("all", lambda r, i: F.coalesce(
        F.get(F.col("all"), i + 1)["model_ord"] != r["model_ord"], F.lit(True))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(
        F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select("claim_name", F.explode(pairs).alias("p")).select(
        "claim_name", F.col("p.a.model_ord").alias("ord1"), F.col("p.a.model_id").alias("model1"),
        F.col("p.a.summary").alias("summary1"), F.col("p.b.model_ord").alias("ord2"),
        F.col("p.b.model_id").alias("model2"), F.col("p.b.summary").alias("summary2"))


# The wording of the evaluation report.
REPORT_TITLE = "# Insurance Claim Processing - Model Evaluation Report"
CLAIM_TABLE = ("| Model | Status | Time (s) | Summary Length | Quality |", "|-------|--------|----------|----------------|----------|")
TIMING_TABLE = ("| Model | Avg Time (s) | Min Time (s) | Max Time (s) | Tests |", "|-------|--------------|--------------|--------------|-------|")
SECTIONS = ("header", "summary", "models", "claims", "timing")


def report_lines(results: DataFrame, models: DataFrame) -> DataFrame:
    """The evaluation report as rows (section, claim_name, ord, line).

    Reading the rows by section number, claim and ord gives the report:
    header counts, summary totals, the models with their ids, for each claim
    its heading, a table row per result and the example summary (or the
    claim's error), and the timing table. Sections are projections and small
    aggregates over the results, which are written once and read by each;
    nothing is sorted or gathered here."""
    results = staged(results.select("claim_name", "model_ord", "model_id", "success", "time_seconds", "summary", "error"), "eval-results")

    def lines(df, section, claim, order, line):
        return df.select(F.lit(SECTIONS.index(section)).alias("section_ord"), F.lit(section).alias("section"),
                         claim.cast("string").alias("claim_name"), order.cast("int").alias("ord"), line.alias("line"))

    def listed(df, section, *texts):
        items = F.array(*[F.struct(F.lit(k).alias("o"), t.alias("l")) for k, t in enumerate(texts, start=1)])
        return lines(df.select(F.inline(items)), section, F.lit(None), F.col("o"), F.col("l"))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    total = eval_totals(results, models)
    n_models = models.agg(F.count(F.lit(1))).scalar()
    parts = [
        listed(total, "header", text(REPORT_TITLE), text("**Models Evaluated:** ", n_models),
               text("**Claims Tested:** ", F.col("claims"))),
        listed(total, "summary", text("## Executive Summary"), text("- **Total Tests Run:** ", F.col("total_tests")),
               text("- **Successful:** ", F.col("successful")), text("- **Failed:** ", F.col("failed")),
               text("- **Success Rate:** ", F.coalesce(F.format_string("%.1f", F.col("success_rate_pct")), F.lit("0.0")), "%")),
        lines(models.select("model_ord", F.posexplode(F.array(
            text(F.col("model_ord"), ". **", short_model_name("model_id"), "** (", provider_name("model_id"), ")"),
            text("   - Model ID: `", F.col("model_id"), "`"))).alias("at", "l")),
            "models", F.lit(None), F.col("model_ord") * 2 + F.col("at"), F.col("l")),
    ]
    ok = F.col("success")
    length = F.when(ok, F.length("summary"))
    rows = results.where(F.col("model_ord").isNotNull())
    claims = results.groupBy("claim_name").agg(F.max(F.when(F.col("model_ord").isNull(), F.col("error"))).alias("error"))
    heading = text("### ", F.initcap(F.regexp_replace("claim_name", "_", " ")))
    parts.append(lines(claims.select("claim_name", F.posexplode(F.when(F.col("error").isNull(), F.array(
        heading, F.lit(CLAIM_TABLE[0]), F.lit(CLAIM_TABLE[1]))).otherwise(F.array(
            heading, text("**Error:** ", F.col("error"))))).alias("at", "l")),
        "claims", F.col("claim_name"), F.col("at") + 1, F.col("l")))
    parts.append(lines(rows, "claims", F.col("claim_name"), F.col("model_ord") + 10, text(
        "| ", F.concat_ws(" | ", short_model_name("model_id"), F.when(ok, "Success").otherwise("Failed"),
                          F.coalesce(F.col("time_seconds").cast("string"), F.lit("N/A")),
                          F.when(ok, F.concat(length.cast("string"), F.lit(" chars"))).otherwise("N/A"),
                          quality_label(ok, length)), " |")))
    example = first_success(rows)
    parts.append(lines(example.select("claim_name", F.posexplode(F.array(
        text("**Example Summary (", F.col("model_short"), "):**"), text("> ", F.col("example_summary")))).alias("at", "l")),
        "claims", F.col("claim_name"), F.lit(1_000_000) + F.col("at"), F.col("l")))
    fmt = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)), F.lit("N/A"))
    timing = model_timing(rows, models)
    parts.append(listed(total, "timing", text("## Performance Comparison"), text(TIMING_TABLE[0]), text(TIMING_TABLE[1])))
    parts.append(lines(timing, "timing", F.lit(None), F.col("model_ord") + 10, text(
        "| ", F.concat_ws(" | ", "model_short", fmt("avg_time"), fmt("min_time"), fmt("max_time"),
                          F.col("n_success").cast("string")), " |")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_model_list(s, default: Sequence[str]) -> Column:
    """``"a, b"`` -> trimmed array; empty or null -> the default list."""
    c = _c(s)
    parsed = F.transform(F.split(c, ","), lambda m: F.trim(m))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(*[F.lit(m) for m in default])).otherwise(parsed)
