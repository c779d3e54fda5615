"""Plan guards for the training-data queries and the pipeline, their written stages included."""

import sys

import pytest

import corpus_pipeline
from claimflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.plan_audit import audit

RUNS = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_plan_has_no_pair_joins_or_row_udfs(spark, monkeypatch, name):
    plans = []
    for module in [m for k, m in sys.modules.items() if k.startswith("claimflow.llm.") or k == "corpus_pipeline"]:
        if (write := getattr(module, "materialise", None)) is not None:
            monkeypatch.setattr(module, "materialise", lambda df, label, write=write: plans.append((label, audit(df))) or write(df, label))
    plans.append(("result", audit(RUNS[name](spark, SF_SMALL))))
    for label, r in plans:
        assert r["nested_loop_or_cartesian"] == 0, (label, r)
        assert "BatchEvalPython" not in r["python"], (label, r)
    if name == "pipeline":
        assert len(plans) >= len(corpus_pipeline.STAGES)
