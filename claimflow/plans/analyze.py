"""Full claim analysis as one lazy plan.

mask (F1) -> classify the masked text (C1) -> policy lookup (C2, broadcast
3-row dimension) -> base + enriched prompt (M1/M6/M8) -> field extraction
and summary of the masked text (M13/M14) -> completeness validation
(C4/C5). Classification is computed once and shared by enrichment and
validation. Every step is a projection or a broadcast join: no shuffle of
the claim corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.operators import extract, pii, policy, prompts


def analyze_claims(df: DataFrame, text_col: str = "claim_text", apply_filtering: bool = True,
                   reference_compat: bool = False, with_spans: bool = True,
                   templates: prompts.PromptTemplates = prompts.DEFAULT_TEMPLATES) -> DataFrame:
    """Analysis record per claim.

    ``reference_compat`` builds the base prompt from the unmasked text, as
    the reference does; the default uses the masked text so no personal
    data reaches the prompt.
    """
    out = pii.apply_filtering(df, apply_filtering, text_col, with_spans=with_spans)
    out = out.withColumn("claim_type", policy.classify_claim("filtered_text"))
    out = policy.policy_lookup(out, "claim_type")
    prompt_src = text_col if reference_compat else "filtered_text"
    out = out.withColumn("base_prompt", templates.render("extract_info", document_text=prompt_src))
    out = prompts.enrich_prompt(out, "base_prompt", prompts.policy_context_block())
    out = extract.extract_fields(out, "filtered_text", fields_col="fields")
    out = extract.claim_summary(out, "filtered_text", fields_col="fields")
    out = policy.validate_completeness(out, "extracted_info", "policy_required_info")
    return out


def analysis_record(df: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """Flat, typed view of the analysis for reports and comparisons."""
    v = F.col("validation")
    s = F.col("enrichment_stats")
    return df.select(
        id_col,
        "claim_type",
        F.col("total_detections").cast("bigint").alias("detections"),
        "extracted_info",
        "summary",
        v["is_complete"].alias("is_complete"),
        F.array_join(v["present_fields"], "|").alias("present_fields"),
        F.array_join(v["missing_fields"], "|").alias("missing_fields"),
        v["completeness_score"].alias("completeness_score"),
        s["base_length"].cast("bigint").alias("base_length"),
        s["enriched_length"].cast("bigint").alias("enriched_length"),
        s["context_added"].cast("bigint").alias("context_added"),
        F.md5("enriched_prompt").alias("prompt_md5"),
    )
