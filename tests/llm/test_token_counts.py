from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from claimflow.llm import token_counts
from claimflow.llm.common import shared_dir
from tests.conftest import SF_SMALL

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_totals_equal_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet").collect()
    toxic = {r.doc_id for r in read("labels") if r.toxic == 1}
    lib, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n_docs, n_tokens = Counter(), Counter()
    for r in read("documents"):
        if r.doc_id not in toxic:
            for name, n in (("byte_bpe_50k", len(lib.encode(r.text, add_special_tokens=False).ids)),
                            ("piece_bpe_32k", len(pieces.encode(r.text)))):
                n_docs[r.source, r.lang, name] += 1
                n_tokens[r.source, r.lang, name] += n
    got = entry.queries()["op9_token_counts"](spark, SF_SMALL).collect()
    assert {tuple(r) for r in got} == {(*k, n_docs[k], n_tokens[k]) for k in n_docs}


def rollup(spark):
    return token_counts.TokenRollup(spark, shared_dir(spark, "test-rollup"))


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), token_counts.CHANGES)


def test_batches_count_once_and_any_order(spark):
    a = ("a", "1", changes(spark, ("s", "en", "v1", "insert", 10, None), ("s", None, "v1", "insert", None, None),
                           (None, "en", "v1", "insert", 5, None)))
    b = ("b", "2", changes(spark, ("s", "en", "v1", "revise", 12, 10), (None, "en", "v1", "delete", 5, None)))
    want = {("s", "en", "v1", 1, 12), ("s", None, "v1", 1, 0)}
    for order in ((a, b), (b, a), (a, a, b, a, b)):
        r = rollup(spark)
        applied = [r.commit(name, rows) for name, _, rows in order]
        assert sum(applied) == 2
        assert {tuple(x) for x in r.totals().collect()} == want
        r.compact()
        assert not r.commit("a", a[2]) and not r.commit("b", b[2])
        r.commit("c", changes(spark, ("s", "en", "v2", "insert", 7, None)))
        assert {tuple(x) for x in r.totals().collect()} == want | {("s", "en", "v2", 1, 7)}


def test_simultaneous_commits_of_a_batch_count_once(spark):
    r = rollup(spark)
    for _ in range(2):  # both found no commit
        r._record("same", spark.createDataFrame([("s", "en", "v", 1, 3)], "source string, lang string, tokenizer string, n_docs long, n_tokens long"), [])
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 1, 3)]


def test_empty_and_wrong_batches(spark):
    r = rollup(spark)
    assert r.totals().count() == 0
    r.compact()
    assert r.commit("none", changes(spark)) and not r.commit("none", changes(spark))
    assert r.totals().count() == 0
    with pytest.raises(Exception, match="unknown change"):
        r.commit("bad", changes(spark, ("s", "en", "v", "replace", 1, None)))
    assert r.commit("bad", changes(spark))  # a failed batch is not committed


def test_hard_rows(spark):
    rows = [(1, None, "s", "en"), (2, "", "s", "en"), (3, "word " * 30_000, "s", None), (3, "a b", "s", None), (None, "a", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokenizer", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (1, 0)], "doc_id long, toxic int")
    tok = {"v": ("pieces", PIECES)}
    got = {tuple(r) for r in token_counts.corpus_token_totals(docs, labels, tok).collect()}
    assert got == {("s", "en", "v", 2, 0), (None, "en", "v", 1, 1)}
    assert token_counts.corpus_token_totals(docs.limit(0), labels, tok).count() == 0


def test_compactions_at_the_same_time_count_once(spark, tmpdir_path):
    rollup, other = (token_counts.TokenRollup(spark, f"{tmpdir_path}/same-time") for _ in range(2))
    change = lambda n: spark.createDataFrame([("s", "en", "t", "insert", n, None)], token_counts.CHANGES)
    rollup.commit("a", change(20))
    rollup.commit("b", change(5))
    seen = spark.createDataFrame(rollup.commits().collect(), rollup.commits().schema)
    rollup.commit("c", change(7))
    rollup.compact()
    other.commits = lambda: seen  # it had read the commits before the other's compaction
    other.compact()
    want = [("s", "en", "t", 3, 32)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.commit("d", change(1))
    rollup.compact()
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 4, 33)]
    assert not rollup.commit("c", change(7))


def test_which_deltas_count():
    f = lambda *covers: frozenset(covers)
    batches = [("a", "pa", f()), ("b", "pb", f()), ("c", "pc", f())]
    assert sorted(token_counts.counted_paths(batches)) == ["pa", "pb", "pc"]
    one, two = ("x", "p1", f("a", "b")), ("y", "p2", f("b", "c"))
    assert sorted(token_counts.counted_paths([*batches, one, two])) == ["p1", "pc"]
    both = ("z", "p0", f("a", "b", "c", "x", "y"))
    assert token_counts.counted_paths([*batches, one, two, both]) == ["p0"]
    # The outer fold loses to another; the fold inside it still stands for its own.
    inner, outer, rival = ("x", "p3", f("a")), ("y", "p2", f("x", "a", "b")), ("w", "p1", f("b", "c"))
    assert sorted(token_counts.counted_paths([*batches, inner, outer, rival])) == ["p1", "p3"]
    assert token_counts.counted_paths([]) == []
