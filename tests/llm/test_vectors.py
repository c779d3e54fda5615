"""Hard negatives and vector codes against brute force, hard rows, and the pruning itself."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.llm import hard_negatives, vector_codes
from claimflow.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, duck_connect

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    """The contract of op11 over (id, label, integer vector) rows with distinct ids."""
    out = set()
    for a, la, va in rows:
        if a % 50:
            continue
        scored = sorted((-int(np.dot(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va))
        for ps, p, _ in [x for x in scored if x[2] == la][:5]:
            fit = [(n, -s) for s, n, lab in scored if lab != la and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out |= {(a, p, k, n, -ps, s) for k, (n, s) in enumerate(fit, 1)}
    return out


def brute_codes(rows, parts=16, entries=64):
    """The contract of op12 over (id, label, integer vector) rows of one width, ids distinct."""
    rows = sorted(rows)
    whole = np.array([r[2] for r in rows], np.int64)
    bounds = vector_codes.part_bounds(whole.shape[1], parts)
    books = [whole[:entries, a:b].copy() for a, b in bounds]
    for step in range(3):
        found = [((whole[:, None, a:b] - book[None]) ** 2).sum(axis=2) for (a, b), book in zip(bounds, books)]
        codes = [d.argmin(axis=1) for d in found]
        for j, (a, b) in enumerate(bounds):
            for e in range(len(books[j])) if step < 2 else ():
                if (mine := codes[j] == e).any():
                    books[j][e] = whole[mine, a:b].sum(axis=0) // mine.sum()
    errors = sum(d.min(axis=1) for d in found)
    by_label = {}
    for r, e in zip(rows, errors.tolist()):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return {(r[0], "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by_label[r[1]], digest) for k, r in enumerate(rows)}


def floored(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_query_equals_sql(spark, name):
    assert compare(spark, duck_connect(SF_SMALL), name, QUERIES[name], ORACLE[name], SF_SMALL)["status"] == "ok"


@pytest.mark.parametrize("sizes", [(2048, 16_384, 1024), (16, 40, 3)])
def test_negatives_in_blocks_of_any_size(spark, monkeypatch, sizes):
    """Vectors of all lengths in few dimensions, where ranges do prune; many ties; zero vectors; a hot label and vector."""
    for name, size in zip(("BUCKET", "GROUP_ROWS", "ANCHOR_SET"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 1, rng.integers(-40, 60, 4) * int(rng.integers(1, 6))) for i in range(400)]
    rows += [(400 + i, i % 2, np.array([9, 9, 9, 9])) for i in range(200)] + [(600, 1, np.zeros(4, int)), (650, 0, -np.ones(4, int))]
    df = spark.createDataFrame([(i, lab, v.tolist()) for i, lab, v in rows], "vec_id long, label int, v array<long>")
    got = {tuple(r) for r in hard_negatives.mine_hard_negatives(df, "vec_id", "label", "v").collect()}
    assert got == brute_negatives(rows)
    assert got


def test_negatives_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.6, 0.3], 1), (2, [0.7, 0.3], 2), (2, [0.7, 0.3], 2), (3, None, 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (8, [0.5, 0.5], None), (None, [1.0, 1.0], 1), (9, [1.0], 1), (10, [], 1),
            (0, [0.5, 0.5], 9), (50, [0.5, 0.5, 0.5], 1), (100, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("place", F.lit(1))
    got = {tuple(r) for r in hard_negatives.hard_negative_digest(df).collect()}
    score = lambda a, b: int(np.dot(floored(a), floored(b)))
    # Id 0 has label 1 + 1 or 9 + 1, as 7 divides it; its rows are no partners, and the rows of id 2 are one.
    assert got == {(0, 2, 1, 1, score([1.0, 0.5], [0.7, 0.3]), score([1.0, 0.5], [0.6, 0.3]))}
    assert hard_negatives.hard_negative_digest(df.limit(0)).collect() == []


def test_ranges_keep_every_row_that_reaches_the_score():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-100, 100, (500, 6)), np.zeros((3, 6), int)])
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(503)), pa.array([0] * 503), pa.array(vectors.tolist())], ["id", "label", "values"])
    bucket = hard_negatives._Bucket(next(hard_negatives._pack(iter([batch]))).to_pylist()[0])
    pruned = 0
    for _ in range(100):
        anchor = hard_negatives._Anchor({"id": 0, "uid": 0, "label": 0, "values": rng.integers(-100, 100, 6).tolist(), "positives": None})
        every = vectors @ anchor.vector
        for least in (-np.inf, int(every.min()), 0, int(np.median(every)), int(np.sort(every)[-5]), int(every.max()), int(every.max()) + 1):
            rows = bucket.candidates(anchor, least)
            assert set(np.flatnonzero(every >= least)) <= set(rows.tolist())
            assert (bucket.scores(anchor, rows) == every[rows]).all()
            pruned += 503 - len(rows)
    assert pruned > 100 * 503


def test_pivot_bounds_prune_and_decide_exactly():
    rng = np.random.default_rng(2)
    entries = rng.integers(-300, 300, (64, 4))
    entries[40] = entries[7]  # a tie: the lower index wins
    values = np.concatenate([rng.integers(-300, 300, (3000, 4)), entries])
    pivots = vector_codes.choose_pivots(entries)
    code, error, evaluations = vector_codes.nearest(
        values, vector_codes._distances(values, pivots), entries, vector_codes._distances(entries, pivots))
    every = ((values[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
    assert evaluations < 0.25 * every.size


@pytest.mark.parametrize("count, width", [(300, 64), (40, 16), (100, 20), (70, 3)])
def test_codes_equal_brute_force(spark, count, width):
    """Fewer rows than entries; parts of unequal and of no width; a hot label; nulls are one label."""
    rng = np.random.default_rng(count)
    rows = [(i * 3 - 50, [1, 1, None, int(i) % 5][i % 4], rng.integers(-200, 200, width).tolist()) for i in range(count)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").withColumn("known", F.lit("clash"))
    got = vector_codes.compress(df.repartition(5), "vec_id", "label", "v").select("id", "code", "error", "label_error", "codebooks_sha256")
    assert {tuple(r) for r in got.collect()} == brute_codes(rows)


def test_codes_hard_rows(spark):
    rows = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, [0.25] * 16, None), (3, None, 1), (4, [float("nan")] + [0.0] * 15, 1),
            (5, [None] + [0.0] * 15, 2), (None, [-0.5] * 16, 2), (6, [1.0] * 3, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("id", F.lit(0))
    got = vector_codes.vector_code_digest(df).collect()
    assert sorted(map(str, (r.vec_id for r in got))) == ["1", "1", "2", "6", "None"]
    by_id = {r.vec_id: r for r in got}
    assert by_id[6].code is None and by_id[6].error is None
    assert all(len(r.code) == 32 for r in got if r.vec_id != 6)
    assert by_id[2].label_error == by_id[2].error == 0
    empty = vector_codes.vector_code_digest(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
