"""Every registered query against its DuckDB oracle at sf0.001; queries
without an oracle must at least run."""

import pytest

import __spark_entry__ as entry
from claimflow.plans import registry
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, duck_connect

registry.load_all()
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "claim_type" in df.columns


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators(tmpdir_path):
    """Also where only a module that they need is missing."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for module in ("public_tokenizers", "claimflow.llm", "corpus_pipeline"):
        code = (f"import sys; sys.modules[{module!r}] = None; sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
                "q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q))")
        out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=tmpdir_path, timeout=120)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"], out.stderr
