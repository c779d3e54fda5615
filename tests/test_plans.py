"""Plan regression guards for every registered query."""

import re

import pytest

from claimflow.plans import registry
from tests.conftest import SF_SMALL
from tools.plan_audit import audit

registry.load_all()
QUERIES = registry.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pair_joins_or_row_udfs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    r = audit(df)
    assert r["nested_loop_or_cartesian"] == 0, r
    assert "BatchEvalPython" not in r["python"], r  # no row-at-a-time Python UDF


def test_document_path_has_no_regex_duplication(spark):
    df = QUERIES["pii_detect"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 8
    df = QUERIES["analyze_claims"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # masking, classification, policy lookup, extraction, validation: no shuffle
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("regexp_replace(") <= 9


@pytest.mark.parametrize("name", ["kb_new_docs", "kb_ingest_stats", "latest_ingestion"])
def test_no_text_crosses_a_shuffle(spark, name):
    """With broadcast off, no exchange carries a document's text."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution()
        plan = spark._jvm.PythonSQLUtils.explainString(run, "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert moved and not any("text#" in columns for columns in moved)


def test_quick_mask_runs_each_rule_once(spark):
    plan = QUERIES["pii_quick_mask"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 8


def test_missing_fields_are_extracted_once(spark):
    """No filter below the generator repeats the extraction, and a claim's text is made lower case once for all words."""
    plan = QUERIES["missing_field_counts"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 5
    assert plan.count("lower(claim_text") == 1


def test_requests_and_prompts_stay_with_the_call(spark):
    """A call's rows come back without its request, no prompt is carried on, and a reply is checked once."""
    plan = QUERIES["model_chain"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(r"MapInArrow call\(([^)]*)\)#\d+, \[([^\]]*)\]", plan)
    assert len(calls) == 2
    for sent, back in calls:
        assert "__req" in sent and "__req" not in back and "__p" not in sent
    assert plan.count("jsonObjectKeys(") == 2


def test_the_chain_carries_what_is_asked_for(spark, monkeypatch):
    """Texts, and the first call's columns that nobody wants, pass through no call; the claims are dealt by the size of their table."""
    from claimflow.plans import source_queries
    monkeypatch.setattr(source_queries, "CHAIN_TASK_BYTES", 1000)
    plan = QUERIES["model_chain"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(r"MapInArrow call\(([^)]*)\)#\d+, \[([^\]]*)\]", plan)
    assert [re.sub(r"#\d+L?", "", sent) for sent, _ in calls] == ["claim_id, model_id, __req, __model"] * 2
    deals = [int(n) for n in re.findall(r"Repartition (\d+), true", plan)]
    assert len(deals) == 1 and deals[0] > spark.sparkContext.defaultParallelism
    assert plan.index("claim_text") < plan.index("Repartition") < plan.index("Join Inner")  # the plan is printed from its end
