import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimflow.llm import suffix_dedup
from claimflow.llm.suffix_array import b_types, repeated, suffix_array
from tests.conftest import SF_SMALL


def brute(docs):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by counting every string of 400 bytes."""
    bodies = [(i, (t or "").encode()) for i, t in docs]
    digest = lambda b, k: hashlib.blake2b(b[k:k + 400], digest_size=12).digest()
    count = Counter(digest(b, k) for _, b in bodies for k in range(len(b) - 399))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if count[digest(b, k)] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digest(docs):
    return Counter(tuple(r) for r in suffix_dedup.suffix_digest(docs).collect())


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array_equals_sorted_suffixes(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 9, 60, 700):
        text = rng.integers(0, letters, n).astype(np.uint8)
        raw = text.tobytes()
        want = sorted(range(n), key=lambda i: raw[i:])
        assert suffix_array(text, n + 8).tolist() == want
        assert b_types(text).tolist() == [raw[i:] < raw[i + 1:] for i in range(n)]


def test_repeated_equals_counting():
    rng = random.Random(4)
    for letters in ("ab", "abcdefgh"):
        raw = "".join(rng.choice(letters) for _ in range(400))
        raw = (raw + raw[50:90] + raw[10:60] + "a" * 40).encode()
        for depth in (8, 11, 16):
            starts = np.array([i for i in range(len(raw) - depth - 8) if rng.random() < 0.7])
            count = Counter(raw[i:i + depth] for i in starts.tolist())
            want = [i for i in starts.tolist() if count[raw[i:i + depth]] > 1]
            assert repeated(np.frombuffer(raw, np.uint8), starts, depth).tolist() == want


def test_regions_cover_every_start_once():
    rng = random.Random(6)
    for data in (rng.randbytes(3000), b"ab" * 2000, rng.randbytes(700) * 4, b"x" * 5000, rng.randbytes(400), rng.randbytes(399)):
        for piece in (1 << 18, 700):
            found = list(suffix_dedup.regions(data, piece=piece))
            starts = [k for _, _, first, n, _ in found for k in range(first, first + n)]
            assert starts == list(range(max(0, len(data) - 399)))
            names = {}
            for name, _, first, n, twice in found:
                for k in range(first, first + n):
                    assert names.setdefault(data[k:k + 400], name) == name  # equal strings, equal names
                inside = [data[k:k + 400] for k in range(first, first + n)]
                assert twice or len(set(inside)) == len(inside)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = Counter(tuple(r) for r in entry.queries()["op2_suffix_array_dedup"](spark, SF_SMALL).collect())
    assert got == brute([tuple(r) for r in docs.collect()])


def hard_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short, long = prose(120), prose(50), prose(3000)
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 401), (5, "ab" * 600), (6, long), (7, long[:9000] + "!" + long[9000:]),
            (8, prose(80) + shared + prose(80)), (9, prose(90) + shared + shared[:500]), (10, prose(300)), (10, prose(300)),
            (None, prose(200)), (11, prose(100) * 2), (12, "\x00" * 900)]
    rows += [(10, rows[9][1]), (None, rows[11][1])]
    rows += [(100 + k, prose(70) + short + prose(70)) for k in range(40)]  # under 400 bytes in common
    rows += [(200 + k, prose(30) + shared + prose(30)) for k in range(40)]
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_REGIONS, 5])
def test_hard_rows(spark, hot):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("clash"))
    got = suffix_dedup.suffix_dedup(docs, hot_regions=hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    if hot == 5:
        assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_names_with_many_bytes_are_not_sorted_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(120)) + "\n"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    # Regions of one name: few, but of 2.3 MB, with different lengths and neighbours.
    rows = [(k, word() + line * (700 + k) + word()) for k in range(27)] + [(50, word() + "x" * 5000 + word()), (51, "x" * 3000)]
    rows += [rows[3], (60, line * 3 + word()), (61, word() * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    hot_marks = suffix_dedup._hot_marks
    monkeypatch.setattr(suffix_dedup, "_hot_marks", lambda bodies: seen.append(
        bodies.agg(F.count_distinct("name"), F.max(F.octet_length("body"))).first()) or hot_marks(bodies))
    assert digest(docs) == brute(rows)
    assert [tuple(r) for r in seen] == [(1, suffix_dedup.SLICE + 399)]
    got = suffix_dedup.suffix_dedup(docs, hot_bytes=1000).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_long_equal_stretches_are_not_sorted_again(monkeypatch):
    """Groups that agree on the next bytes are left as they are: sorting them in every round took most of op2's time."""
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 900).astype(np.uint8)
    text = np.concatenate([part for _ in range(60) for part in (passage, rng.integers(97, 123, 100).astype(np.uint8))])
    asked, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: asked.append(len(keys[0])) or real(keys))
    raw, order = text.tobytes(), suffix_array(text, 400)
    assert all(raw[a:a + 400] <= raw[b:b + 400] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))
    assert sorted(order.tolist()) == list(range(len(text)))
    assert sum(asked) < 2 * len(text)
