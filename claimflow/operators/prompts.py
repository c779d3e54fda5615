"""Prompt templates, rendering and policy-context enrichment.

Templates use ``str.format`` placeholders. Rendering splits the template once
on the driver (with the standard library's format parser) and emits a single
``concat`` of literals and columns, so values are inserted verbatim and never
re-scanned for placeholders.
"""

from __future__ import annotations

import string
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.operators.policy import title_words

# The three built-in prompt templates, verbatim.
BUILTIN_TEMPLATES = (
    ("extract_info", """Extract the following information from this document:
- Claimant Name
- Policy Number
- Incident Date
- Claim Amount
- Incident Description

Document:
{document_text}

Return the information in JSON format."""),
    ("generate_summary", """Based on this extracted information:
{extracted_info}

Generate a concise summary of the claim in 2-3 sentences."""),
    ("compare_summary", """Compare these two summaries and identify key differences:

Summary 1 (Model: {model1}):
{summary1}

Summary 2 (Model: {model2}):
{summary2}

Provide a brief comparison."""),
)


class PromptTemplates:
    """M5: template registry (add / list / render, one template or one per row)."""

    def __init__(self, templates=BUILTIN_TEMPLATES):
        self._t: "OrderedDict[str, str]" = OrderedDict(templates)

    def add_template(self, name: str, template: str) -> "PromptTemplates":
        placeholders(template)  # validate now, not at render time
        self._t[name] = template
        return self

    def list_templates(self) -> list[str]:
        return list(self._t)

    def get(self, name: str) -> str:
        if name not in self._t:
            raise ValueError(f"Template {name} not found")
        return self._t[name]

    def render(self, name: str, **values) -> Column:
        return render_template(self.get(name), **values)

    def render_each(self, name: Column, **values) -> Column:
        """The template that each row names. A name that is not registered, or
        whose template has a placeholder without a value, fails the row's job
        like an unknown template does on the driver."""
        out = None
        for known, template in self._t.items():
            missing = [p for p in placeholders(template) if p not in values]
            text = (F.raise_error(F.lit(f"Template {known} lacks a value for {', '.join(missing)}")).cast("string")
                    if missing else render_template(template, **values))
            out = F.when(name == known, text) if out is None else out.when(name == known, text)
        unknown = F.raise_error(F.concat(F.lit("Template "), F.coalesce(name, F.lit("null")), F.lit(" not found")))
        return unknown.cast("string") if out is None else out.otherwise(unknown.cast("string"))


DEFAULT_TEMPLATES = PromptTemplates()


def placeholders(template: str) -> list[str]:
    """Field names in ``template``; format specs and conversions are refused."""
    names = []
    for _lit, field, spec, conv in string.Formatter().parse(template):
        if field is None:
            continue
        if field == "" or spec or conv:
            raise ValueError(f"unsupported placeholder {{{field}{'!' + conv if conv else ''}"
                             f"{':' + spec if spec else ''}}}")
        names.append(field)
    return names


def render_template(template: str, **values) -> Column:
    """M1: template with named placeholders filled from columns (or literals).

    A missing value raises ``KeyError`` on the driver, like ``str.format``.
    ``{{`` and ``}}`` are literal braces.
    """
    pieces = []
    for lit_text, field, spec, conv in string.Formatter().parse(template):
        if lit_text:
            pieces.append(F.lit(lit_text))
        if field is None:
            continue
        if field == "" or spec or conv:
            raise ValueError("only plain named placeholders are supported")
        if field not in values:
            raise KeyError(field)
        v = values[field]
        pieces.append((F.col(v) if isinstance(v, str) else v).cast("string"))
    return F.concat(*pieces) if pieces else F.lit("")


def policy_context_block(prefix: str = "policy_") -> Column:
    """M6 context block for lookup mode (8 lines, arrays joined with ``, ``)."""
    return F.concat(
        F.lit("\nPOLICY CONTEXT:\n- Claim Type: "), title_words("claim_type"),
        F.lit("\n- Coverage Types: "), F.array_join(F.col(prefix + "coverage_types"), ", "),
        F.lit("\n- Required Information: "), F.array_join(F.col(prefix + "required_info"), ", "),
        F.lit("\n- Typical Deductible: "), F.col(prefix + "typical_deductible"),
        F.lit("\n- Expected Processing Time: "), F.col(prefix + "processing_time"),
        F.lit("\n- Required Documentation: "), F.col(prefix + "documentation"),
        F.lit("\n\n"),
    )


def kb_context_block(results_col: str = "kb_results", top: int = 3) -> Column:
    """M7 context block for retrieval mode: the best ``top`` chunks, numbered."""
    items = F.transform(F.slice(F.col(results_col), 1, top),
                        lambda r, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "),
                                              r["content"], F.lit("\n")))
    return F.concat(F.lit("\nPOLICY CONTEXT FROM KNOWLEDGE BASE:\n"), F.array_join(items, ""))


def enrich_prompt(df: DataFrame, base_col: str, context: Column, out_col: str = "enriched_prompt") -> DataFrame:
    """M6/M8: context block before the base prompt, plus length statistics."""
    out = df.withColumn(out_col, F.concat(context, F.col(base_col)))
    return out.withColumn("enrichment_stats", F.struct(
        F.length(base_col).alias("base_length"),
        F.length(out_col).alias("enriched_length"),
        (F.length(out_col) - F.length(base_col)).alias("context_added"),
    ))
