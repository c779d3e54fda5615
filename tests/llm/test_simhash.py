import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.llm import simhash
from claimflow.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm import brute


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute.simhash_rows([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows(simhash.simhash_digest(docs)) == want


def test_hard_rows(spark):
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (6, "one two"),
            (7, "É é É"), (8, "word " * 30_000), (9, "WORD " * 20_000), (10, "a\x0bb\x0cc\rd")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.simhash_digest(docs).collect()
    assert len(got) == len(data)
    assert {tuple(r) for r in got} == brute.simhash_rows(data)
    assert simhash.simhash_digest(docs.limit(0)).collect() == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z y x w")], "doc_id long, text string")
    got = simhash.simhash_digest(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 5), (5, 5), (None, None)}


def test_dedup_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (2, "q r s t u", "z")], "doc_id long, text string, a string")
    assert sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect()) == [1, 2]
    assert simhash.simhash_dedup(docs).columns == docs.columns


@pytest.mark.parametrize("block", [40, 20_000])
def test_crowded_cells_lose_no_link(spark, block):
    """Hundreds of fingerprints a few bits apart, whole and split cells."""
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(300):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    prints |= {rng.getrandbits(64) for _ in range(500)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = simhash.near_links(spark.createDataFrame(signed, "fp long"), cell_block=block)
    edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def classes(pairs):
        up = {p: p for p in prints}

        def root(p):
            while up[p] != p:
                p = up[p]
            return p
        for a, b in pairs:
            up[root(a)] = root(b)
        out = {}
        for p in prints:
            out.setdefault(root(p), set()).add(p)
        return {frozenset(x) for x in out.values()}
    listed = sorted(prints)
    want = [(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if (a ^ b).bit_count() <= 3]
    assert classes(edges) == classes(want)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a ^ rng.integers(0, 2**64, 2000, dtype=np.uint64) & rng.integers(0, 2**64, 2000, dtype=np.uint64)
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)).astype(int) for k in range(32)])
    apart = np.abs(count(a) - count(b)).sum(axis=0)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == apart).all()
    assert (apart <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
