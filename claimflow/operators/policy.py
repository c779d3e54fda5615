"""Claim classification, policy lookup and completeness validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.functions.arrays import let

# Keyword groups tested in this order on the lower-cased text
# (substring tests, first group with a hit wins), and the default type.
CLAIM_TYPE_KEYWORDS = (
    ("auto_accident", ("vehicle", "car", "accident", "collision", "driver")),
    ("property_damage", ("property", "home", "house", "building", "fire", "water")),
    ("medical", ("medical", "injury", "hospital", "treatment", "doctor")),
)
DEFAULT_CLAIM_TYPE = "general"

# The built-in policy knowledge, one row per claim type:
# (claim_type, coverage_types, required_info, typical_deductible,
#  processing_time, documentation). Unknown types use the auto_accident row.
POLICY_KNOWLEDGE = (
    ("auto_accident", ["Collision", "Comprehensive", "Liability"],
     ["Police report number", "Other driver information", "Witness statements"],
     "$500-$1000", "7-14 business days", "Photos of damage, repair estimates, police report"),
    ("property_damage", ["Homeowners", "Renters", "Property"],
     ["Date of incident", "Cause of damage", "Extent of damage"],
     "$1000-$2500", "10-21 business days", "Photos, repair estimates, receipts for damaged items"),
    ("medical", ["Medical Payments", "Personal Injury Protection"],
     ["Medical provider information", "Treatment dates", "Diagnosis"],
     "$0-$500", "14-30 business days", "Medical bills, treatment records, prescription receipts"),
)
FALLBACK_POLICY = "auto_accident"

POLICY_SCHEMA = T.StructType([
    T.StructField("claim_type", T.StringType(), False),
    T.StructField("coverage_types", T.ArrayType(T.StringType()), False),
    T.StructField("required_info", T.ArrayType(T.StringType()), False),
    T.StructField("typical_deductible", T.StringType(), False),
    T.StructField("processing_time", T.StringType(), False),
    T.StructField("documentation", T.StringType(), False),
])
POLICY_FIELDS = [f.name for f in POLICY_SCHEMA.fields[1:]]

# Fixed value: how results name the knowledge base as their source.
KB_SOURCE = "bedrock_kb"


def classify_claim(text) -> Column:
    """Claim type from lower-cased substring keyword tests."""
    def typed(low):
        expr = F
        for ctype, words in CLAIM_TYPE_KEYWORDS:
            expr = expr.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(ctype))
        return expr.otherwise(F.lit(DEFAULT_CLAIM_TYPE))

    return let(F.lower(F.col(text) if isinstance(text, str) else text), typed)


def policy_table(spark: SparkSession) -> DataFrame:
    """The built-in 3-row policy dimension."""
    return spark.createDataFrame([tuple(r) for r in POLICY_KNOWLEDGE], POLICY_SCHEMA)


def _policy_struct(row) -> Column:
    ct, cov, req, ded, pt, doc = row
    return F.struct(
        F.array(*[F.lit(x) for x in cov]).cast("array<string>").alias("coverage_types"),
        F.array(*[F.lit(x) for x in req]).cast("array<string>").alias("required_info"),
        F.lit(ded).alias("typical_deductible"), F.lit(pt).alias("processing_time"),
        F.lit(doc).alias("documentation"))


def policy_lookup(df: DataFrame, type_col: str = "claim_type", policies: DataFrame | None = None,
                  fallback: str = FALLBACK_POLICY, prefix: str = "policy_") -> DataFrame:
    """Attach policy fields; a type without a row gets the fallback row
    while ``type_col`` keeps its value.

    The built-in policies are three fixed rows, so they are a literal map
    indexed by the claim type: a pure projection that stays in whole-stage
    codegen. A user's table is joined, whatever its size: one row per type
    (of several, the largest by its fields in order), then a left join on the
    type and one on the fallback for the types it lacks. Spark broadcasts it
    where it is small.
    """
    if policies is not None:
        return _policy_join(df, type_col, policies, fallback, prefix)
    lookup = F.create_map(*[x for r in POLICY_KNOWLEDGE for x in (F.lit(r[0]), _policy_struct(r))])
    hit = F.try_element_at(lookup, F.col(type_col))
    hit = F.coalesce(hit, *[_policy_struct(r) for r in POLICY_KNOWLEDGE if r[0] == fallback])
    tmp = "__policy"
    out = df.withColumn(tmp, hit)
    return out.withColumns({prefix + c: F.col(tmp)[c] for c in POLICY_FIELDS}).drop(tmp)


def _policy_join(df: DataFrame, type_col: str, policies: DataFrame, fallback: str, prefix: str) -> DataFrame:
    one = policies.groupBy("claim_type").agg(F.max(F.struct(*POLICY_FIELDS)).alias("__policy"))
    main = one.select(F.col("claim_type").alias("__type"), "__policy")
    other = one.where(F.col("claim_type") == fallback).select(
        F.col("claim_type").alias("__fallback"), F.col("__policy").alias("__other"))
    # Only the rows without a policy meet the fallback.
    out = df.join(main, F.col(type_col) == F.col("__type"), "left")
    out = out.join(other, F.when(F.col("__type").isNull(), F.lit(fallback)) == F.col("__fallback"), "left")
    policy = F.coalesce("__policy", "__other")
    return out.withColumns({prefix + c: policy[c] for c in POLICY_FIELDS}).drop(
        "__type", "__policy", "__fallback", "__other")


def _keywords(field: Column) -> Column:
    return F.filter(F.split(F.lower(field), r"\s+"), lambda k: k != "")


def validate_completeness(df: DataFrame, extracted_col: str, required_col: str = "policy_required_info",
                          out_col: str = "validation") -> DataFrame:
    """A required field is present when any of its lower-cased
    whitespace-separated keywords is a substring of the lower-cased extracted
    text. Lists keep policy order; score = present / required (1.0 when none
    are required); complete = nothing missing."""
    req = F.col(required_col)

    def where_hit(wanted: bool) -> Column:
        def fields(low):
            def hit(f):
                return F.exists(_keywords(f), lambda k: low.contains(k))
            return F.filter(req, hit if wanted else lambda f: ~hit(f))
        return let(F.lower(F.col(extracted_col)), fields)

    cur = df.withColumns({"__present": where_hit(True), "__missing": where_hit(False)})
    n_req = F.size(req)
    score = F.when(n_req == 0, F.lit(1.0)).otherwise(F.size("__present") / n_req)
    return cur.withColumn(out_col, F.struct(
        (F.size("__missing") == 0).alias("is_complete"),
        F.col("__present").alias("present_fields"),
        F.col("__missing").alias("missing_fields"),
        score.cast("double").alias("completeness_score"),
        F.lit("fallback").alias("source"),
    )).drop("__present", "__missing")


def kb_validation(df: DataFrame, results_col: str = "kb_results", out_col: str = "validation") -> DataFrame:
    """Retrieval-mode validation is always complete and carries the results."""
    return df.withColumn(out_col, F.struct(
        F.lit(True).alias("is_complete"),
        F.array().cast("array<string>").alias("present_fields"),
        F.array().cast("array<string>").alias("missing_fields"),
        F.lit(1.0).alias("completeness_score"),
        F.lit(KB_SOURCE).alias("source"),
        F.col(results_col).alias("kb_results"),
    ))


def completeness_pct(score) -> Column:
    """Score as a whole percent (half away from zero, like ``toFixed``)."""
    return F.round(F.col(score) * 100 if isinstance(score, str) else score * 100, 0).cast("int")


def title_words(c) -> Column:
    """``_`` to space, then capitalise each word."""
    return F.initcap(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "_", " "))
