"""Claim field extraction and the offline summary sentence.

The reference asks a language model for these fields; offline they are read
from the labelled lines of the claim text with ``regexp_extract``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five fields the extraction prompt asks for, in order.
CLAIM_FIELDS = ("Claimant Name", "Policy Number", "Incident Date", "Claim Amount", "Incident Description")


def field_value(text: Column, label: str) -> Column:
    """Rest of the line after ``label: `` (empty when the label is absent)."""
    return F.regexp_extract(text, label + r": ([^\n]*)", 1)


def fields_struct(text: Column) -> Column:
    """The five labelled fields as a struct (one regex pass per field)."""
    return F.struct(*[field_value(text, f).alias(f) for f in CLAIM_FIELDS])


def extract_fields(df: DataFrame, text_col: str, out_col: str = "extracted_info",
                   fields_col: str | None = None) -> DataFrame:
    """The five fields as a JSON object string (keys are the labels).
    With ``fields_col`` the struct is also kept for later use (e.g. the
    summary) so the fields are extracted only once."""
    if fields_col:
        out = df.withColumn(fields_col, fields_struct(F.col(text_col)))
        return out.withColumn(out_col, F.to_json(F.col(fields_col)))
    return df.withColumn(out_col, F.to_json(fields_struct(F.col(text_col))))


def extract_fields_typed(df: DataFrame, text_col: str) -> DataFrame:
    """M13 typed variant: date and amount parsed with ``try_`` functions
    (null when malformed instead of failing the job)."""
    text = F.col(text_col)
    return df.select(
        "*",
        field_value(text, "Claimant Name").alias("claimant_name"),
        field_value(text, "Policy Number").alias("policy_number"),
        F.expr("try_to_date(" + _sql_field(text_col, "Incident Date") + ")").alias("incident_date"),
        F.expr("try_cast(regexp_replace(" + _sql_field(text_col, "Claim Amount")
               + ", '[$,]', '') as decimal(18,2))").alias("claim_amount"),
        field_value(text, "Incident Description").alias("incident_description"),
    )


def _sql_field(text_col: str, label: str) -> str:
    return f"regexp_extract(`{text_col}`, '{label}: ([^\\\\n]*)', 1)"


def summary_sentence(fields: Column) -> Column:
    """M14 offline summary from a fields struct."""
    return F.concat(
        F.lit("Claim by "), fields["Claimant Name"],
        F.lit(" under policy "), fields["Policy Number"],
        F.lit(" for "), fields["Claim Amount"],
        F.lit(", incident on "), fields["Incident Date"],
        F.lit(": "), fields["Incident Description"],
    )


def claim_summary(df: DataFrame, text_col: str, out_col: str = "summary", fields_col: str | None = None) -> DataFrame:
    """M14 offline summary: one sentence assembled from the extracted fields
    (read from ``fields_col`` when the fields were already extracted)."""
    fields = F.col(fields_col) if fields_col else fields_struct(F.col(text_col))
    return df.withColumn(out_col, summary_sentence(fields))
