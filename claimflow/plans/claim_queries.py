"""Registered classification, policy, prompt, extraction and analysis queries."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from claimflow.operators import evaluation, extract, policy, prompts
from claimflow.plans import analyze
from claimflow.plans.pii_queries import RULES, _q, _staged_sql
from claimflow.plans.registry import query
from claimflow.sources import views

TEMPLATES = dict(prompts.BUILTIN_TEMPLATES)


# ------------------------------------------------------------ SQL helpers
def _classify_sql(text: str) -> str:
    low = f"lower({text})"
    whens = " ".join(
        f"when {' or '.join(f'contains({low}, {_q(w)})' for w in words)} then {_q(ct)}"
        for ct, words in policy.CLAIM_TYPE_KEYWORDS)
    return f"case {whens} else {_q(policy.DEFAULT_CLAIM_TYPE)} end"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


POLICIES_SQL = "select * from (values " + ", ".join(
    f"({_q(ct)}, {_list(cov)}, {_list(req)}, {_q(ded)}, {_q(pt)}, {_q(doc)})"
    for ct, cov, req, ded, pt, doc in policy.POLICY_KNOWLEDGE
) + ") p(claim_type, coverage_types, required_info, typical_deductible, processing_time, documentation)"

_KNOWN = "(" + ", ".join(_q(r[0]) for r in policy.POLICY_KNOWLEDGE) + ")"


def _policy_join_sql(src: str, type_col: str = "claim_type") -> str:
    return (f"select s.*, p.coverage_types, p.required_info, p.typical_deductible, p.processing_time, "
            f"p.documentation from {src} s left join policies p on p.claim_type = case when s.{type_col} in "
            f"{_KNOWN} then s.{type_col} else {_q(policy.FALLBACK_POLICY)} end")


def _title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, '_'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _render_sql(template: str, **values) -> str:
    out = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        if lit:
            out.append(_q(lit))
        if field is not None:
            out.append(f"cast({values[field]} as varchar)")
    return " || ".join(out)


def _extract_sql(text: str) -> str:
    fields = ", ".join(f"{_q(f)}: regexp_extract({text}, {_q(f + ': ([^' + chr(92) + 'n]*)')}, 1)"
                       for f in extract.CLAIM_FIELDS)
    return f"cast(to_json({{{fields}}}) as varchar)"


def _summary_sql(text: str) -> str:
    def fv(label):
        return f"regexp_extract({text}, {_q(label + ': ([^' + chr(92) + 'n]*)')}, 1)"
    return (f"'Claim by ' || {fv('Claimant Name')} || ' under policy ' || {fv('Policy Number')} || ' for ' || "
            f"{fv('Claim Amount')} || ', incident on ' || {fv('Incident Date')} || ': ' || {fv('Incident Description')}")


def _present_sql(req: str, extracted: str, negate: bool = False) -> str:
    cond = (f"len(list_filter(string_split_regex(lower(f), '\\s+'), "
            f"lambda k: k <> '' and contains(lower({extracted}), k))) > 0")
    if negate:
        cond = f"not ({cond})"
    return f"list_filter({req}, lambda f: {cond})"


def _context_sql() -> str:
    return (f"chr(10) || 'POLICY CONTEXT:' || chr(10) || '- Claim Type: ' || {_title_sql('claim_type')} || "
            "chr(10) || '- Coverage Types: ' || array_to_string(coverage_types, ', ') || "
            "chr(10) || '- Required Information: ' || array_to_string(required_info, ', ') || "
            "chr(10) || '- Typical Deductible: ' || typical_deductible || "
            "chr(10) || '- Expected Processing Time: ' || processing_time || "
            "chr(10) || '- Required Documentation: ' || documentation || chr(10) || chr(10)")


def _analysis_sql(final_select: str) -> str:
    n = len(RULES)
    staged = _staged_sql(RULES, "claims", "claim_id", "claim_text", "c")
    total = " + ".join(f"c{k}" for k in range(1, n + 1))
    body = f"""with {staged},
policies as ({POLICIES_SQL}),
a as (select claim_id, t{n} as masked, cast({total} as bigint) as detections from s{n}),
b as (select *, {_classify_sql('masked')} as claim_type from a),
c as ({_policy_join_sql('b')}),
d as (select *, {_render_sql(TEMPLATES['extract_info'], document_text='masked')} as base_prompt,
        {_extract_sql('masked')} as extracted_info, {_summary_sql('masked')} as summary from c),
e as (select *, {_context_sql()} || base_prompt as enriched_prompt,
        {_present_sql('required_info', 'extracted_info')} as present,
        {_present_sql('required_info', 'extracted_info', True)} as missing from d)
{final_select}"""
    return views.with_views(body, "claims")


# ----------------------------------------------------------------- queries
def _claims(spark, sf_dir):
    return views.claims(spark, sf_dir)


def _analysis(spark, sf_dir, with_spans=False):
    return analyze.analyze_claims(_claims(spark, sf_dir), with_spans=with_spans)


ANALYZE_SELECT = """select claim_id, claim_type, detections, extracted_info, summary,
 len(missing) = 0 as is_complete, array_to_string(present, '|') as present_fields,
 array_to_string(missing, '|') as missing_fields,
 case when len(required_info) = 0 then 1.0 else len(present) / len(required_info) end as completeness_score,
 cast(length(base_prompt) as bigint) as base_length, cast(length(enriched_prompt) as bigint) as enriched_length,
 cast(length(enriched_prompt) - length(base_prompt) as bigint) as context_added,
 md5(enriched_prompt) as prompt_md5 from e"""


@query("analyze_claims", _analysis_sql(ANALYZE_SELECT))
def analyze_claims(spark, sf_dir):
    """M15 flagship: mask -> classify -> policy -> prompt -> extract -> validate."""
    return analyze.analysis_record(_analysis(spark, sf_dir))


@query("prompt_enriched", _analysis_sql("select claim_id, enriched_prompt from e"))
def prompt_enriched(spark, sf_dir):
    """M6: policy context block + base prompt (masked text)."""
    return _analysis(spark, sf_dir).select("claim_id", "enriched_prompt")


@query("enrichment_stats", _analysis_sql(
    "select claim_id, cast(length(base_prompt) as bigint) as base_length, "
    "cast(length(enriched_prompt) as bigint) as enriched_length, "
    "cast(length(enriched_prompt) - length(base_prompt) as bigint) as context_added from e"))
def enrichment_stats(spark, sf_dir):
    """M8: base / enriched / added prompt lengths."""
    s = F.col("enrichment_stats")
    return _analysis(spark, sf_dir).select(
        "claim_id", s["base_length"].cast("bigint").alias("base_length"),
        s["enriched_length"].cast("bigint").alias("enriched_length"),
        s["context_added"].cast("bigint").alias("context_added"))


@query("claim_type", views.with_views(f"select claim_id, {_classify_sql('claim_text')} as claim_type from claims",
                                      "claims"))
def claim_type(spark, sf_dir):
    """Keyword classification of the claim text."""
    return _claims(spark, sf_dir).select("claim_id", policy.classify_claim("claim_text").alias("claim_type"))


@query("claim_type_counts", views.with_views(
    f"select claim_type, count(*) as n_claims from (select {_classify_sql('claim_text')} as claim_type from claims) "
    "group by claim_type", "claims"))
def claim_type_counts(spark, sf_dir):
    """Claim-type distribution (partial + final hash aggregation)."""
    return (_claims(spark, sf_dir).select(policy.classify_claim("claim_text").alias("claim_type"))
            .groupBy("claim_type").agg(F.count(F.lit(1)).alias("n_claims")))


_POLICY_OUT = """select claim_id, claim_type, array_to_string(coverage_types, ', ') as coverage_types,
 array_to_string(required_info, ', ') as required_info, typical_deductible, processing_time, documentation from c"""


@query("policy_lookup", views.with_views(
    f"with policies as ({POLICIES_SQL}), b as (select claim_id, {_classify_sql('claim_text')} as claim_type from claims), "
    f"c as ({_policy_join_sql('b')})\n{_POLICY_OUT}", "claims"))
def policy_lookup(spark, sf_dir):
    """Broadcast policy join; ``general`` gets the fallback policy."""
    c = _claims(spark, sf_dir).select("claim_id", policy.classify_claim("claim_text").alias("claim_type"))
    p = policy.policy_lookup(c, "claim_type")
    return p.select("claim_id", "claim_type",
                    F.array_join("policy_coverage_types", ", ").alias("coverage_types"),
                    F.array_join("policy_required_info", ", ").alias("required_info"),
                    F.col("policy_typical_deductible").alias("typical_deductible"),
                    F.col("policy_processing_time").alias("processing_time"),
                    F.col("policy_documentation").alias("documentation"))


def _raw_completeness_sql(final_select):
    return views.with_views(f"""with policies as ({POLICIES_SQL}),
b as (select claim_id, {_classify_sql('claim_text')} as claim_type, {_extract_sql('claim_text')} as extracted_info from claims),
c as ({_policy_join_sql('b')}),
e as (select *, {_present_sql('required_info', 'extracted_info')} as present,
        {_present_sql('required_info', 'extracted_info', True)} as missing from c)
{final_select}""", "claims")


def _raw_completeness(spark, sf_dir):
    c = _claims(spark, sf_dir).withColumn("claim_type", policy.classify_claim("claim_text"))
    c = extract.extract_fields(c, "claim_text")
    c = policy.policy_lookup(c, "claim_type")
    return policy.validate_completeness(c, "extracted_info")


@query("completeness", _raw_completeness_sql(
    "select claim_id, claim_type, len(missing) = 0 as is_complete, array_to_string(present, '|') as present_fields, "
    "array_to_string(missing, '|') as missing_fields, cast(len(present) as bigint) as n_present, "
    "cast(len(required_info) as bigint) as n_required from e"))
def completeness(spark, sf_dir):
    """Completeness of the extracted fields against policy requirements."""
    v = F.col("validation")
    return _raw_completeness(spark, sf_dir).select(
        "claim_id", "claim_type", v["is_complete"].alias("is_complete"),
        F.array_join(v["present_fields"], "|").alias("present_fields"),
        F.array_join(v["missing_fields"], "|").alias("missing_fields"),
        F.size(v["present_fields"]).cast("bigint").alias("n_present"),
        F.size("policy_required_info").cast("bigint").alias("n_required"))


@query("completeness_pct", _raw_completeness_sql(
    "select claim_id, cast(round(case when len(required_info) = 0 then 1.0 else len(present) / len(required_info) end "
    "* 100) as int) as completeness_pct from e"))
def completeness_pct(spark, sf_dir):
    """Completeness score as a whole percent."""
    return _raw_completeness(spark, sf_dir).select(
        "claim_id", policy.completeness_pct(F.col("validation")["completeness_score"]).alias("completeness_pct"))


@query("missing_field_counts", _raw_completeness_sql(
    "select claim_type, field, count(*) as n_claims from (select claim_type, unnest(missing) as field from e) "
    "group by claim_type, field"))
def missing_field_counts(spark, sf_dir):
    """How often each required field is missing, per claim type. The outer
    generator keeps the whole chain out of a filter below it; the row that it
    makes of a complete claim goes."""
    return (_raw_completeness(spark, sf_dir)
            .select("claim_type", F.explode_outer("validation.missing_fields").alias("field")).where("field is not null")
            .groupBy("claim_type", "field").agg(F.count(F.lit(1)).alias("n_claims")))


@query("prompt_extract", views.with_views(
    f"select claim_id, {_render_sql(TEMPLATES['extract_info'], document_text='claim_text')} as prompt from claims",
    "claims"))
def prompt_extract(spark, sf_dir):
    """M1/M2: extract_info template over every claim."""
    return _claims(spark, sf_dir).select(
        "claim_id", prompts.DEFAULT_TEMPLATES.render("extract_info", document_text="claim_text").alias("prompt"))


@query("extract_fields", views.with_views(
    f"select claim_id, {_extract_sql('claim_text')} as extracted_info from claims", "claims"))
def extract_fields(spark, sf_dir):
    """Five labelled claim fields as JSON."""
    return extract.extract_fields(_claims(spark, sf_dir), "claim_text").select("claim_id", "extracted_info")


@query("prompt_summary", views.with_views(
    f"select claim_id, {_render_sql(TEMPLATES['generate_summary'], extracted_info=_extract_sql('claim_text'))} "
    "as prompt from claims", "claims"))
def prompt_summary(spark, sf_dir):
    """M3: generate_summary template over the extracted fields."""
    e = extract.extract_fields(_claims(spark, sf_dir), "claim_text")
    return e.select("claim_id", prompts.DEFAULT_TEMPLATES.render(
        "generate_summary", extracted_info="extracted_info").alias("prompt"))


@query("claim_summary", views.with_views(f"select claim_id, {_summary_sql('claim_text')} as summary from claims",
                                         "claims"))
def claim_summary(spark, sf_dir):
    """Offline one-sentence claim summary."""
    return extract.claim_summary(_claims(spark, sf_dir), "claim_text").select("claim_id", "summary")


@query("prompt_compare_pairs", views.with_views(
    "select a.claim_name, a.model_ord as ord1, b.model_ord as ord2, "
    + _render_sql(TEMPLATES["compare_summary"], model1="a.model_id", summary1="a.summary",
                  model2="b.model_id", summary2="b.summary")
    + " as prompt from model_results a join model_results b on a.claim_name = b.claim_name "
      "and a.model_ord < b.model_ord where a.success and b.success", "model_results"))
def prompt_compare_pairs(spark, sf_dir):
    """M4: compare_summary prompt for every pair of successful model results."""
    pairs = evaluation.compare_pairs(views.model_results(spark, sf_dir))
    return pairs.select("claim_name", "ord1", "ord2", prompts.DEFAULT_TEMPLATES.render(
        "compare_summary", model1="model1", summary1="summary1", model2="model2", summary2="summary2"
    ).alias("prompt"))


@query("prompt_by_template", views.with_views(
    f"""with c as (select claim_id, claim_text, case when {_classify_sql('claim_text')} = 'general' then 'generate_summary'
  else 'extract_info' end as template from claims)
select claim_id, template, case template when 'extract_info' then {_render_sql(TEMPLATES['extract_info'], document_text='claim_text')}
  else {_render_sql(TEMPLATES['generate_summary'], extracted_info='claim_text')} end as prompt from c""", "claims"))
def prompt_by_template(spark, sf_dir):
    """M5: every claim carries the name of its template: general claims are
    summarised directly, the others extracted first."""
    c = _claims(spark, sf_dir).withColumn("template", F.when(
        policy.classify_claim("claim_text") == "general", "generate_summary").otherwise("extract_info"))
    prompt = prompts.DEFAULT_TEMPLATES.render_each(F.col("template"), document_text="claim_text", extracted_info="claim_text")
    return c.select("claim_id", "template", prompt.alias("prompt"))
