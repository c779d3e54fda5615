"""Exact scans and the inverted-file index against brute force."""

import numpy as np
import pytest

from claimflow.operators import kb, knn
from claimflow.plans.registry import QUERIES, load_all
from tests.conftest import SF_SMALL
from tools.plan_audit import audit


def clusters(seed=1, n=600, width=12):
    """Clusters of different density, a third of the rows one vector, ids not in order."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, width)) * 4
    x = centres[rng.integers(0, 15, n)] + rng.normal(size=(n, width)) * rng.choice([0.1, 0.5, 1.5], (n, 1))
    x[: n // 3] = centres[0]
    return rng.permutation(n), x


def brute(ids, x, queries, k):
    out = {}
    for q, v in enumerate(queries):
        d2 = ((x - v) ** 2).sum(axis=1)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, d2))[:k]]
    return out


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.rank, r.vec_id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


@pytest.fixture(scope="module")
def data(spark):
    ids, x = clusters()
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id int, embedding array<double>")
    queries = np.concatenate((x[::40], np.random.default_rng(2).normal(size=(8, x.shape[1])) * 4))
    asked = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(queries)], "qid int, qvec array<double>")
    return ids, x, corpus, queries, asked


def test_scan_equals_brute_force_with_ties(data):
    ids, x, corpus, queries, asked = data
    assert listed(kb.knn_topk(corpus.repartition(7), asked, k=6)) == brute(ids, x, queries, 6)


def test_scan_shuffles_no_vectors(spark):
    """The only exchange is that of the few best rows, by query."""
    load_all()
    plan = QUERIES["knn_top5"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("MapInArrow", "")
    after = plan[:plan.index("MapInArrow")]
    assert after.count("Exchange") <= 1 and "Exchange" not in plan[plan.index("MapInArrow"):]
    assert audit(QUERIES["knn_top5"](spark, SF_SMALL))["nested_loop_or_cartesian"] == 0


@pytest.mark.parametrize("segment, block", [(65_536, 4096), (50, 5)])
def test_index_probing_all_lists_is_exact(spark, data, tmpdir_path, monkeypatch, segment, block):
    """Whole and split lists, one and several blocks of queries; more neighbours than the nearest list has."""
    monkeypatch.setattr(knn, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", block)
    ids, x, corpus, queries, asked = data
    index = knn.IvfIndex.build(corpus, f"{tmpdir_path}/index", lists=20)
    assert index.vectors.count() == len(ids)
    assert (index.vectors.select("segment").distinct().count() > 1) == (segment < 100)
    for k in (1, 6, 300):
        assert listed(index.search(asked, k=k)) == brute(ids, x, queries, k)
    again = knn.IvfIndex(spark, f"{tmpdir_path}/index")
    assert listed(again.search(asked, k=3, probes=len(again.numbers))) == brute(ids, x, queries, 3)


def test_pruned_rows_are_not_compared(spark, data, tmpdir_path, monkeypatch):
    """Lists beyond the bound are not scanned at all."""
    _, _, corpus, _, asked = data
    index = knn.IvfIndex.build(corpus, f"{tmpdir_path}/index", lists=20)
    pairs = []
    monkeypatch.setattr(knn.IvfIndex, "_scan", lambda self, b, base, away, wanted, *a, f=knn.IvfIndex._scan:
                        pairs.append(wanted.sum()) or f(self, b, base, away, wanted, *a))
    index.search(asked.where("qid < 15"), k=3).collect()
    assert sum(pairs) < 0.5 * 15 * len(index.numbers)


def test_fitted_probes_reach_the_recall(spark, tmpdir_path):
    """Recall@5 against the exact scan, for the queries of ``knn_approx``: every row whose id 50 divides."""
    load_all()
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        e = spark.read.parquet(f"{sf}/embeddings.parquet")
        asked = e.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "embedding as qvec")
        want = listed(kb.knn_topk(e, asked, k=5))
        got = listed(QUERIES["knn_approx"](spark, sf))
        hits = sum(len(set(got[q]) & set(v)) for q, v in want.items())
        assert hits >= 0.9 * sum(map(len, want.values())), (sf, hits)


def test_few_probes_scan_few_lists(spark, data, tmpdir_path):
    ids, x, corpus, queries, asked = data
    index = knn.IvfIndex.build(corpus, f"{tmpdir_path}/index", lists=20)
    probes = index.probes_for_recall(asked, k=5, target=0.95)
    assert 1 <= probes < len(index.numbers)
    got, want = listed(index.search(asked, k=5, probes=probes)), brute(ids, x, queries, 5)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want) - 1


def test_index_hard_rows(spark, tmpdir_path):
    few = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)], "vec_id string, embedding array<float>")
    index = knn.IvfIndex.build(few, f"{tmpdir_path}/few")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "qid string, qvec array<float>")
    assert listed(index.search(asked, k=5)) == {"q": ["a", "b"]}
    assert index.search(asked.limit(0), k=5).collect() == []
    with pytest.raises(ValueError):
        knn.IvfIndex.build(few.limit(0), f"{tmpdir_path}/none")
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="differ in width"):
        kb.knn_topk(mixed, mixed.selectExpr("vec_id as qid", "embedding as qvec").limit(1), k=1).collect()
