import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimflow.llm import piece_codec, queries, token_shards
from claimflow.llm.common import shared_dir
from tests.conftest import SF_SMALL

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", " ", "\n", "\n", "a", "the", "word", "é", "▁", "\t", "\r", "漢", "🙂", "<s>", "</s>", "<0x0A>", "\x00", "‍",
         "1", "!!", "\xa0", "\x85", "\x1c", "   ", "<|endoftext|>", ",", ".", "'s", "ﬁ", "ª"]
HARD = [None, "", " ", "\n", "\n\n\n", "  a", "a  ", "word " * 20_000, "x" * 30_000, "\n".join("ab" * k for k in range(300))]


def fuzz(n=4000):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("most", [50, 100_000])
def test_pieces_equal_the_library(most):
    codec, lib = piece_codec.PieceCodec(PIECES, max_chunks=most), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.by_chunk
    for text in fuzz() + [t or "" for t in HARD]:
        (ids, decimal), = codec.encode([text])
        assert ids == lib.encode(text) + [2]
        assert decimal == " ".join(map(str, ids))


@pytest.mark.parametrize("most", [50, 100_000])
def test_byte_ids_equal_the_library(most):
    bpe, lib = token_shards.ByteBpe(BYTES, max_chunks=most), Tokenizer.from_file(BYTES)
    assert bpe.by_chunk
    texts = fuzz() + [t or "" for t in HARD]
    for text, got in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_op7_equals_brute_force(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, t in docs:
        ids = lib.encode(t or "") + [lib.eos_id()]
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert {tuple(r) for r in queries.op7_sentencepiece(spark, SF_SMALL).collect()} == want


def test_op7_hard_rows_and_round_trip(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, "a"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    assert piece_codec.piece_digest(docs, PIECES).count() == len(rows)
    assert piece_codec.piece_digest(docs.limit(0), PIECES).count() == 0
    back = piece_codec.piece_decode(piece_codec.piece_encode(docs, PIECES), PIECES)
    assert back.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


def brute_shards(rows):
    lib = Tokenizer.from_file(BYTES)
    out, start = set(), 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        out.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op3_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in queries.op3_token_id_output(spark, SF_SMALL).collect()} == brute_shards([tuple(r) for r in docs])


def test_op3_hard_rows(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, "null key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    assert {tuple(r) for r in token_shards.token_shard_digest(docs, BYTES).collect()} == brute_shards(rows)
    again = token_shards.token_shard_digest(docs.union(docs), BYTES).collect()
    assert len(again) == 2 * len(rows) and len({r.start for r in again}) == 2 * len(rows)
    assert token_shards.token_shard_digest(docs.limit(0), BYTES).count() == 0


def test_keyed_access_finds_only_what_was_written(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = shared_dir(spark, "test-shards")
    token_shards.write_shards(docs, path, BYTES)
    keys = spark.range(0, 10_000, 7).select(F.col("id").alias("key"), F.lit(0).alias("occurrence"))
    assert {r.key for r in token_shards.locate(spark, path, keys).collect()} == set(range(0, 5000, 7))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 2500])
def test_perfect_hash_is_a_bijection(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    pilots, slots = token_shards.perfect_hash(h1, h2)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards._places(h1, h2, pilots[token_shards._groups(h1, len(pilots))], n) == slots).all()


def test_wide_ids_are_written_and_read_as_such(spark, tmpdir_path):
    """A vocabulary above 65,536: the shards say how wide their ids are."""
    import json
    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]["vocab"]
    words = sorted(model, key=model.get)[-200:]
    free = 70_000
    for k in range(free - len(model)):
        model[f"Āunused{k}"] = len(model)
    # The words in use get the highest ids, the others the rest in their order.
    others = sorted(set(model) - set(words), key=model.get)
    model.update({w: k for k, w in enumerate([*others, *words])})
    path = f"{tmpdir_path}/wide.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    lib = Tokenizer.from_file(path)
    assert lib.get_vocab_size() > 1 << 16
    texts = [(k, w.replace("Ġ", " ")) for k, w in enumerate(words) if w.replace("Ġ", " ").isascii()] + [(900, "plain words and more"), (901, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in token_shards.token_shard_digest(docs, path).collect()}
    want, wide = {}, 0
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        wide += max(ids) > 0xFFFF
        want[i] = zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got == want and wide > 10


def test_frequent_pieces_are_segmented_once():
    """A full table keeps what is met again, in ids and in counts."""
    codec, lib = piece_codec.PieceCodec(PIECES, max_chunks=60), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    asked, real = [], codec.segment
    codec.segment = lambda new: asked.extend(new) or real(new)
    texts = [" ".join(["often", "seen", *(f"w{k}x{i}" for i in range(15))]) for k in range(40)]
    for t in texts:
        assert [ids for ids, _ in codec.encode([t])] == [[*lib.encode(t), codec.end]]
    assert asked.count("often") == asked.count("seen") == 1 and len(codec.ids) + len(codec.old_ids) <= 60
    asked.clear()
    assert [codec.count([t]) for t in texts] == [[len(lib.encode(t))] for t in texts]
    assert asked.count("often") == 1 and len(codec.lengths) + len(codec.old_lengths) <= 60


class Counted:
    """A model that notes the texts it is asked for."""

    def __init__(self, model):
        self.model, self.texts = model, []

    def encode(self, texts, **options):
        self.texts += texts
        return self.model.encode(texts, **options)


def test_new_chunks_share_texts_and_the_table_holds_a_tasks_words():
    """A text for each chunk cost three times as much, and a small table segmented words of a task again."""
    codec, lib = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec.model = Counted(codec.model)
    words = [f"w{k}x\n{k}" for k in range(50_000)]
    texts = [" ".join(words[at:at + 5000]) for at in range(0, len(words), 5000)]
    for text in texts + texts[:1]:
        flat, bounds = codec.encode_flat([text, "", text])
        want = [*lib.encode(text), codec.end]
        assert piece_codec.lists(flat, bounds) == [want, [codec.end], want]
    assert len(codec.model.texts) <= 2 * len(words) // 32


def test_counts_share_texts_too():
    codec, lib = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec.model = Counted(codec.model)
    words = [f"w{k}x\n{k}" for k in range(50_000)]
    texts = [" ".join(words[at:at + 5000]) for at in range(0, len(words), 5000)]
    for text in texts + texts[:1]:
        assert codec.count([text, "", "\n"]) == [len(lib.encode(text)), 0, len(lib.encode("\n"))]
    assert len(codec.model.texts) <= 2 * len(words) // 32
