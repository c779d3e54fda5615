"""The pipeline against a plain Python version of its five stages."""

import hashlib
import itertools
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from claimflow.llm.quality_rules import RULES, Measures
from tests.conftest import SF_SMALL
from tests.llm import brute

SPACE = " \t\n\x0b\x0c\r"


def line_dedup(docs):
    holders = {}
    key = lambda line: brute.ascii_lower(line.strip(SPACE))
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i) for i, t in docs.items()}


def leaked(text, items):
    """Whether 12 tokens of an item stand in the text at one alignment, in a run as the operator defines it."""
    words = re.split(r"[^\w]+|_+", text.lower())
    for item in items:
        for shift in range(-len(item), len(words)):
            score = run = 0
            for q, token in enumerate(item):
                if not 0 <= q + shift < len(words):
                    continue
                score, run = (score + 1, run + 1) if words[q + shift] == token else (score - 2, run)
                if score < 0:
                    score = run = 0
                if run >= 12:
                    return True
    return False


def test_pipeline_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    docs = {i: t for i, t in docs.items() if not any(rule(Measures(t)) for _, rule in RULES)}
    assert all(not brute.quality(t)[-1] for t in docs.values())
    docs = line_dedup(docs)
    docs = {i: docs[i] for i, _, root in brute.simhash_rows(list(docs.items())) if i == root}
    items = [[w for w in re.split(r"[^\w]+|_+", r.text.lower()) if w] for r in read("benchmark").collect()]
    common = [set(itertools.chain(*items))]
    docs = {i: t for i, t in docs.items()
            if len(common[0] & set(re.split(r"[^\w]+", t.lower()))) < 5 or not leaked(t, items)}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: r.text for r in got} == docs
    assert all(r.token_ids == lib.encode(r.text) + [2] and r.n_tokens == len(r.token_ids) for r in got)
    assert all(r.n_chars == len(r.text) for r in got)


def test_last_stage_decodes_what_it_encoded(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    hard = ["", "a\nb  c", "\u2581x \U0001f600 \ufb01 e\u0301", " lead"]
    docs = docs.union(docs.limit(len(hard)).withColumn("text", F.element_at(F.array(*map(F.lit, hard)), F.pmod("doc_id", F.lit(4)).cast("int") + 1)))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert len(got) > 10
    for r in got:
        assert r.token_ids == lib.encode(r.text) + [2]
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(r.token_ids).encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_SMALL).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name


CLASHES = ("token_ids", "n_tokens", "decoded_sha256", "id", "version", "fp", "words", "pos", "item", "__id", "__version",
           "__dropped", "__gone", "__bad", "__decoded", "__line_dedup", "component_id", "line", "key", "seed")


def test_hard_rows_and_clashing_columns(spark, tmpdir_path):
    """Null and empty texts, null and repeated ids, repeated rows, nulls in every column, and columns with the stages' own names."""
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    clean = corpus_pipeline.run(spark, SF_SMALL).select("doc_id").limit(12)
    good = base.join(clean, "doc_id", "left_semi").select(base.columns)
    none = base.limit(3).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
                                *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns[2:]])
    empty = base.limit(1).withColumn("doc_id", F.lit(-2).cast("long")).withColumn("text", F.lit(""))
    lost = good.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    docs = good.unionByName(good.limit(4)).unionByName(none).unionByName(empty).unionByName(lost)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    for part, path in ((docs, "documents"), (spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"), "benchmark")):
        part.write.parquet(f"{tmpdir_path}/{path}.parquet")
    out = corpus_pipeline.run(spark, tmpdir_path)
    rows = out.collect()
    assert {-1, -2}.isdisjoint({r.doc_id for r in rows})  # without words the quality rules reject them
    kept = [r.doc_id for r in rows if r.doc_id is not None]
    assert set(kept) <= {r.doc_id for r in good.collect()} and len(kept) >= len(set(kept)) > 4
    assert all(isinstance(r.token_ids, list) and r.n_tokens == len(r.token_ids) and len(r.decoded_sha256) == 64 for r in rows)
    own = [c for c in CLASHES if c not in ("token_ids", "n_tokens", "decoded_sha256")]
    assert all(r[c] == f"own {c}" for r in rows for c in own)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmpdir_path}/documents.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path).count() == 0
