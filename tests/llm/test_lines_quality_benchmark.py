import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimflow.llm import decontamination, line_dedup, quality_rules
from claimflow.llm.quality_rules import BASE_RULES, RULES, Cascade, Measures
from tests.conftest import SF_SMALL
from tests.llm import brute
from tools.check_oracle import compare, duck_connect

LONG = "This line is shared by many documents."


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op4_quality_rules", "op8_line_dedup"])
def test_query_equals_sql(spark, name):
    r = compare(spark, duck_connect(SF_SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SF_SMALL)
    assert r["status"] == "ok", r


def test_line_dedup_hard_rows(spark):
    rows = [(1, f"{LONG}\nown line one\n{LONG}"), (2, f"  {LONG.upper()}\t\n"), (3, f"x\n{LONG}\n{LONG}\ny"), (4, None),
            (5, ""), (6, "\n\n"), (7, LONG + " " + "long " * 40_000), (None, LONG), (2, f"  {LONG.upper()}\t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digest(docs).collect()}
    assert got == {
        (1, 3, 2, sha("own line one")), (2, 2, 1, sha("")), (3, 4, 0, sha(f"x\n{LONG}\n{LONG}\ny")), (4, 1, 0, sha("")),
        (5, 1, 0, sha("")), (6, 3, 0, sha("\n\n")), (7, 1, 0, sha(rows[6][1])), (None, 1, 1, sha(""))}
    kept = line_dedup.line_dedup(docs, out_col="n_lines")
    assert kept.count() == len(rows) and kept.columns == ["doc_id", "text", "n_lines"]
    assert line_dedup.line_dedup_digest(docs.limit(0)).count() == 0


def test_two_holders_keep_their_lines(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (2, LONG)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.line_dedup_digest(docs).collect()] == [0, 0, 0]


def test_quality_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: brute.quality(r.text) for r in docs.where("n_chars < 6000").collect()}
    got = {r.doc_id: r for r in entry.queries()["op4_quality_rules"](spark, SF_SMALL).collect()}
    assert len(got) == docs.count()
    for i, row in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == row
        assert not (r.kept and r.base_failed)


def test_quality_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "\x0b \x0c"), (None, "a b"), (5, "w x y z v " * 3000), (5, "w x y z v " * 3000),
            (6, "é\x85ü\xa0ß one two three four five six seven eight nine ten"), (7, "#$% " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = quality_rules.quality_verdicts(docs).collect()
    assert sorted(map(str, [(r.doc_id, *r[1:7]) for r in got])) == sorted(
        map(str, [(i, *(brute.quality(t) if i != 5 else (15000, 15000, 0, 0, 15000, True))) for i, t in rows]))
    assert [r.doc_id for r in got if r.kept] == [6]
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [6]


def test_order_of_rules_does_not_change_the_verdict():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "A", "##", "|", "word", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    forward, backward = Cascade(RULES, 50), Cascade(RULES[::-1], 0)
    for t in texts:
        assert (forward.verdict(Measures(t)) is None) == (backward.verdict(Measures(t)) is None)
    assert len(forward.order) == len(RULES) and forward.left == 0


def test_cascade_orders_by_rejection_per_cost():
    dear = ("dear", lambda m: sum(range(20_000)) > 0)
    cheap = ("cheap", lambda m: True)
    never = ("never", lambda m: False)
    cascade = Cascade([never, dear, cheap], 20)
    assert {cascade.verdict(Measures("x")) for _ in range(20)} == {"dear"}
    assert [name for name, _ in cascade.order] == ["cheap", "dear", "never"]
    assert cascade.verdict(Measures("x")) == "cheap"
    assert {name for name, _ in BASE_RULES} <= {name for name, _ in RULES}


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"


def test_decontamination_tolerates_substitutions(spark):
    words = ITEM.split()
    changed = [w if k not in (3, 8, 13) else "zulu" for k, w in enumerate(words)]
    rows = [(1, "Before: " + ITEM.upper().replace(" ", ", ") + " after"), (2, "x " * 50 + " ".join(changed)),
            (3, " ".join(words[:9])), (4, None), (5, ""), (6, "y " * 100_000 + ITEM), (6, "y " * 100_000 + ITEM), (None, ITEM),
            (7, " ".join(reversed(words))), (8, "alpha " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit("clash"))
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (2, ITEM), (3, None), (4, ""), (5, "too short"), (None, "q " * 300)],
                                  "item_id long, text string")
    for block in (decontamination.BLOCK_SEEDS, 300):
        got = {tuple(r) for r in decontamination.overlaps(docs, bench, block_seeds=block).collect()}
        assert got == {(i, k, 13 if i == 2 else 16, 16) for i in (1, 2, 6, None) for k in (1, 2)}
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 8] and kept.columns == docs.columns
    assert decontamination.overlaps(docs.limit(0), bench).count() == 0
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_long_items_are_found_in_tiles(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    docs = spark.createDataFrame([(1, " ".join(words[400:430])), (2, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.n_matched for r in decontamination.overlaps(docs, bench).collect()}
    assert got[1] == 30 and got[2] >= 96


def test_long_items_are_matched_whole(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    far = [w if not 300 <= k < 440 else "zulu" for k, w in enumerate(words)]  # 140 substitutions after 300 matches
    broken = [w if not 300 <= k < 455 else "zulu" for k, w in enumerate(words)]  # one run of 300, one of 445
    rows = [(1, " ".join(words)), (1, "other text under the same id"), (None, "x " * 40 + " ".join(words[100:])), (3, " ".join(far)),
            (4, " ".join(broken)), (5, " ".join(words[:200])), (6, " ".join(words[50:62])), (7, ITEM), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit("clash"))
    bench = spark.createDataFrame([(9, " ".join(words)), (10, ITEM), (11, " ".join(words[:110]))], "item_id long, text string")
    want = {(1, 9, 900, 900), (None, 9, 800, 900), (3, 9, 760, 900), (4, 9, 445, 900), (5, 9, 200, 900), (6, 9, 12, 900), (7, 10, 16, 16),
            *((i, 11, 110, 110) for i in (1, 3, 4, 5)), (6, 11, 12, 110)}
    for block in (decontamination.BLOCK_SEEDS, 1000):
        assert {tuple(r) for r in decontamination.overlaps(docs, bench, block_seeds=block).collect()} == want
    kept = decontamination.decontaminate(docs, bench, min_match=500)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]


def test_native_operators_run_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    for df in (line_dedup.line_dedup_digest(docs), decontamination.overlaps(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
