"""Unit tests for classification, prompts, KB, evaluation, feedback,
sources, inference and the array helpers."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimflow.functions.arrays import exclusive_prefix_sums
from claimflow.operators import evaluation as ev
from claimflow.operators import feedback as fb
from claimflow.operators import inference, kb, policy, prompts
from claimflow.sources import documents, sinks
from tests.conftest import SF_SMALL


def test_prefix_sums(spark):
    arrays = [[], [5], [1, 2, 3], list(range(1, 101)), [7] * 37]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    got = [r.p for r in df.select(exclusive_prefix_sums(F.col("a")).alias("p")).collect()]
    for a, p in zip(arrays, got):
        assert p == [sum(a[:i]) for i in range(len(a))]


def test_classification_and_policy(spark):
    df = spark.createDataFrame([("My Card was stolen",), ("water in the house",), ("hospital stay",), ("lost",)], "t string")
    out = policy.policy_lookup(df.withColumn("claim_type", policy.classify_claim("t")), "claim_type").collect()
    assert [r.claim_type for r in out] == ["auto_accident", "property_damage", "medical", "general"]
    assert out[3].policy_typical_deductible == "$500-$1000"  # general -> auto policy


def test_policy_lookup_join_path(spark):
    pol = policy.policy_table(spark)
    pol = pol.union(pol)  # a repeated type gives one row
    df = spark.createDataFrame([("medical",), ("other",)], "claim_type string")
    rows = policy.policy_lookup(df, "claim_type", policies=pol).collect()
    assert len(rows) == 2
    out = {r.claim_type: r for r in rows}
    assert out["medical"].policy_typical_deductible == "$0-$500"
    assert out["other"].policy_typical_deductible == "$500-$1000"


def test_completeness(spark):
    df = spark.createDataFrame([
        ("police report filed, the other driver left", ["Police report number", "Other driver information", "Witness statements"]),
        ("nothing", []),
    ], "x string, req array<string>")
    v = [r.validation for r in policy.validate_completeness(df, "x", "req").collect()]
    assert v[0].present_fields == ["Police report number", "Other driver information"]
    assert v[0].missing_fields == ["Witness statements"] and not v[0].is_complete
    assert abs(v[0].completeness_score - 2 / 3) < 1e-12
    assert v[1].completeness_score == 1.0 and v[1].is_complete


def test_template_render(spark):
    df = spark.createDataFrame([("{not a field} $1 \\0",)], "t string")
    r = df.select(prompts.render_template("A {x} B {{lit}}", x="t").alias("p")).collect()[0].p
    assert r == "A {not a field} $1 \\0 B {lit}"
    with pytest.raises(KeyError):
        prompts.render_template("{missing}")
    with pytest.raises(ValueError):
        prompts.DEFAULT_TEMPLATES.get("nope")
    t = prompts.PromptTemplates().add_template("short", "Hi {name}")
    assert "short" in t.list_templates()


def test_chunking_edges(spark):
    def txt(n):
        return " ".join(f"w{i}" for i in range(n))
    sizes = [0, 1, 300, 301, 540, 541]
    df = spark.createDataFrame([(i, txt(n)) for i, n in enumerate(sizes)], "doc_id int, text string")
    got = {}
    for r in kb.chunk_documents(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert 0 not in got
    assert [len(got[i]) for i in range(1, 6)] == [1, 1, 2, 2, 3]
    c = sorted(got[4], key=lambda r: r.chunk_no)
    assert c[1].chunk_text.split()[0] == "w240" and c[1].n_words == 300


def test_knn_matches_brute_force(spark, monkeypatch):
    from claimflow.operators import knn
    from claimflow.sources.tables import read_table
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 3)
    e = read_table(spark, SF_SMALL, "embeddings")
    rows = e.collect()
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    Q = X[:7] + 0.01
    qdf = spark.createDataFrame([(int(i), [float(v) for v in q]) for i, q in enumerate(Q)], "qid long, qvec array<double>")
    got = kb.knn_topk(e, qdf, k=5).collect()
    for qi in range(len(Q)):
        d = ((X - Q[qi]) ** 2).sum(1)
        order = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:5]
        mine = [r.vec_id for r in sorted([r for r in got if r.qid == qi], key=lambda r: r.rank)]
        assert mine == [int(ids[j]) for j in order]


def test_new_documents_and_stats(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (9, "c")], "doc_id int, text string")
    hashed = kb.hashed_documents(docs, spark.createDataFrame([(9,), (9,)], "doc_id int"))
    new = kb.new_documents(hashed).collect()
    assert sorted(r.doc_id for r in new) == [1, 2]
    s = kb.ingest_stats(hashed.where("doc_id <> 9").union(hashed.where("doc_id = 9"))).collect()[0]
    assert (s.documents_scanned, s.new_documents_indexed, s.documents_skipped) == (5, 2, 3)
    assert (s.documents_failed, s.failure_reasons, s.status) == (0, [], "COMPLETE")
    bad = spark.createDataFrame([("unreadable file",), ("unreadable file",)], "reason string")
    s = kb.ingest_stats(hashed.limit(0), bad).collect()[0]
    assert (s.documents_scanned, s.documents_failed, s.failure_reasons, s.status) == (2, 2, ["unreadable file"], "FAILED")


def test_context_with_fallback(spark):
    df = spark.createDataFrame([(1, [("c", 0.5)]), (2, [])], "id int, r array<struct<content:string,score:double>>")
    out = {x.id: x for x in kb.context_with_fallback(df, "r", {"claim_type": F.lit("general")}).collect()}
    assert out[1].source == "bedrock_kb" and out[1].claim_type is None
    assert out[2].source == "fallback" and out[2].claim_type == "general"


def test_evaluation_helpers(spark):
    df = spark.createDataFrame([("anthropic.claude-3-haiku-20240307-v1:0",), ("openai.gpt-oss-120b-1:0",)], "m string")
    r = df.select(ev.short_model_name("m").alias("s"), ev.provider_name("m").alias("p")).collect()
    assert [(x.s, x.p) for x in r] == [("Claude", "Anthropic"), ("Gpt", "Openai")]
    e = spark.createDataFrame([("",), (" a , b",), (None,)], "s string")
    parsed = [x.l for x in e.select(ev.parse_model_list("s", ["d1", "d2"]).alias("l")).collect()]
    assert parsed == [["d1", "d2"], ["a", "b"], ["d1", "d2"]]


def test_eval_totals_empty_is_null_rate(spark):
    empty = spark.createDataFrame([], "claim_name string, model_id string, success boolean")
    models = spark.createDataFrame([(1, "m1"), (2, "m2"), (3, "m3")], "model_ord int, model_id string")
    r = ev.eval_totals(empty, models).collect()[0]
    assert r.total_tests == 0 and r.success_rate_pct is None
    # repeated results of a pair count once, a claim-level failure is a claim
    rows = [("a", "m1", True), ("a", "m1", True), ("a", "m2", False), ("b", None, False)]
    r = ev.eval_totals(spark.createDataFrame(rows, empty.schema), models).collect()[0]
    assert (r.claims, r.total_tests, r.successful, r.failed) == (2, 6, 1, 5)


def test_any_number_of_models(spark):
    rows = [("a", k, f"m{k}", True, float(k), f"s{k}", None) for k in (1, 2, 3, 4)] + [("a", 2, "m2", True, 9.0, "again", None)]
    r = spark.createDataFrame(rows, "claim_name string, model_ord int, model_id string, success boolean, "
                                    "time_seconds double, summary string, error string")
    pairs = {(p.ord1, p.ord2) for p in ev.compare_pairs(r).collect()}
    assert len(ev.compare_pairs(r).collect()) == 6 and pairs == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert {c for c in ev.result_grid(r, ["m1", "m2", "m3", "m4"]).columns} >= {f"status_{k}" for k in (1, 2, 3, 4)}
    with pytest.raises(Exception, match="not configured"):
        ev.result_grid(r, ["m1", "m2", "m3"]).collect()
    last = {x.model_ord: x.time_seconds for x in ev.one_per_model(r, order="time_seconds").collect()}
    assert last[2] == 9.0 and len(last) == 4


def test_feedback_truthy_means(spark):
    df = spark.createDataFrame([("1", 5, None), ("2", 0, 3), ("3", None, 0), ("4", 4, 4)],
                               "id string, rating int, accuracy_rating int")
    s = fb.feedback_stats(df).collect()[0]
    assert (s.total, s.n_ratings, s.rating_sum) == (4, 2, 9) and s.average_rating == 4.5
    assert fb.feedback_stats(df.limit(0)).collect()[0].average_rating == 0.0


def test_feedback_tolerant_scan(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "feedback")
    os.makedirs(d)
    files = {"a.json": json.dumps({"id": "1", "rating": 5}, indent=2),
             "b.json": json.dumps({"id": "2", "feedback_type": None}, indent=2),
             "c.json": "bad{"}
    for n, body in files.items():
        with open(os.path.join(d, n), "w") as f:
            f.write(body)
    good, bad = sinks.read_feedback_json(spark, d)
    g = {r.id: r for r in good.collect()}
    assert g["1"].feedback_type == "unknown" and g["1"].rating == 5
    assert g["2"].feedback_type is None
    assert bad.count() == 1


def test_document_scans_and_landing(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "bucket")
    for rel, body in {"documents/a.txt": "hello\nworld", "policies/p1.txt": "policy one",
                      "policies/skip.md": "no", "documents/sub/b.txt": "b"}.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    docs = {r.input_key: r for r in documents.read_documents(spark, root).collect()}
    assert docs["documents/a.txt"].text == "hello\nworld" and docs["documents/a.txt"].name == "a"
    assert "policies/skip.md" not in docs
    pol = documents.read_documents(spark, root, prefix="policies/").collect()
    assert [r.input_key for r in pol] == ["policies/p1.txt"]
    assert documents.read_documents(spark, root, prefix="nowhere/").count() == 0
    lost = documents.unreadable_documents(spark, root, documents.read_documents(spark, root, prefix="policies"))
    assert sorted(r.key for r in lost.collect()) == ["documents/a.txt", "documents/sub/b.txt"]
    listing = documents.list_objects(spark, root)
    areas = {r.area: r.objects for r in documents.objects_per_area(listing).collect()}
    assert areas == {"documents": 2, "policies": 2}
    up = spark.createDataFrame([("../My Claim (1).txt", 10), ("", 1), ("big.txt", 17 * 1024 * 1024)],
                               "name string, size long").withColumn("ts", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    landed = documents.land_documents(up, "name", "size", "ts").collect()
    assert landed[0].input_key == "documents/20240506_070809_My_Claim_1.txt"
    assert landed[1].reason == "No file selected" and landed[2].reason == "File too large"
    names = ["résumé.txt", "a\\b.txt", "Ünïcode 漢.txt", "a/b c.txt", "...", "ﬁx.txt"]
    safe = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k")
    assert [r.s for r in safe.select(documents.safe_filename("n").alias("s")).collect()] == [
        "resume.txt", "ab.txt", "Unicode_.txt", "a_b_c.txt", "", "x.txt"]


class FlakyClient:
    def invoke(self, model_id, body):
        if "fail" in body:
            raise RuntimeError("throttled")
        return json.dumps({"choices": [{"message": {"content": "ok"}}]})


def test_batch_inference_isolates_failures(spark):
    df = spark.createDataFrame([("openai.gpt-oss-120b-1:0", "fine"), ("openai.gpt-oss-120b-1:0", "please fail")],
                               "m string, p string")
    out = {r.p: r for r in inference.run_model(df, "m", "p", FlakyClient).collect()}
    assert out["fine"].success and out["fine"].text == "ok"
    assert not out["please fail"].success and out["please fail"].error == "throttled"


class BrokenClient:
    def invoke(self, model_id, body):
        prompt = json.loads(body)["messages"][0]["content"]
        return {"text": "not json", "empty": '{"content": [{"type": "text"}]}', "old": '{"completion": "c"}'}[prompt]


def test_unparsable_replies_fail(spark):
    df = spark.createDataFrame([("anthropic.x", p) for p in ("text", "empty", "old")], "m string, p string")
    out = {r.p: r for r in inference.run_model(df, "m", "p", BrokenClient).collect()}
    assert not out["text"].success and out["text"].error == "response is not a JSON object" and out["text"].text is None
    assert not out["empty"].success and out["empty"].error == "response has no text"
    assert out["old"].success and out["old"].text == "c" and out["old"].error is None


def test_chain_reads_the_whole_document(spark):
    long = "x" * 5000
    text = f"Policy Number: P-1\nClaimant Name: A \"B\"\nIncident Description: {long}"
    df = spark.createDataFrame([(m, text) for m in ("amazon.nova-x", "openai.gpt-oss-x", "anthropic.x")], "m string, t string")
    for r in inference.process_documents(df, "t", "m").collect():
        fields = json.loads(r.extracted_info)
        assert fields["Claimant Name"] == 'A "B"' and fields["Incident Description"] == long and fields["Claim Amount"] == ""
        assert r.summary.startswith('Claim by A "B" under policy P-1 for ') and r.summary.endswith(long)


def test_template_per_row(spark):
    t = prompts.PromptTemplates([("a", "A {x}"), ("b", "B {y}")])
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, v string")
    assert [r.p for r in df.select(t.render_each(F.col("name"), x="v", y="v").alias("p")).collect()] == ["A 1", "B 2"]
    with pytest.raises(Exception, match="not found"):
        df.select(t.render_each(F.lit("c"), x="v", y="v").alias("p")).collect()
    with pytest.raises(Exception, match="lacks a value for y"):
        df.select(t.render_each(F.col("name"), x="v").alias("p")).collect()


def test_summary_store_lookup_and_evaluation_runs(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "summaries")
    rows = [(f"summaries/{k}.json", f"documents/{k}", "2024-01-01 00:00:00") for k in range(50)]
    rows.append(("summaries/7.json", "archive/7", "2024-02-01 00:00:00"))
    df = spark.createDataFrame(rows, "output_key string, input_file string, t string").select(
        "output_key", "input_file", F.to_timestamp("t").alias("processed_at"))
    sinks.write_summaries(df, path)
    got = sinks.read_summary(spark, path, "summaries/7.json")
    assert [r.input_file for r in got.collect()] == ["archive/7"]
    assert "EqualTo(output_key,summaries/7.json)" in got._jdf.queryExecution().executedPlan().toString()
    runs = os.path.join(tmpdir_path, "runs")
    for run in ("20240101_000000", "20240102_000000", "20240101_000000"):
        sinks.write_evaluation(df.limit(2), runs, run)
    assert spark.read.parquet(runs).groupBy("run_id").count().count() == 2


def test_span_cost_follows_the_matches(spark):
    """The offsets of thousands of matches are those of the plain sums."""
    from claimflow.functions.arrays import exclusive_prefix_sums
    sizes = [0, 1, 2, 7, 8, 1000, 4097]
    df = spark.createDataFrame([(n, [k % 11 for k in range(n)]) for n in sizes], "n int, a array<int>")
    for r in df.select("a", exclusive_prefix_sums(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))]


def test_request_and_response_layouts(spark):
    df = spark.createDataFrame([("amazon.nova-lite-v1:0",), ("openai.gpt-oss-120b-1:0",), ("anthropic.x",)], "m string")
    rows = df.select("m", inference.request_body("m", F.lit("hi")).alias("b"),
                     inference.response_text("m", inference.response_body("m", F.lit("yo"))).alias("t")).collect()
    reqs = {r.m: json.loads(r.b) for r in rows}
    assert reqs["amazon.nova-lite-v1:0"]["inferenceConfig"]["max_new_tokens"] == 1000
    assert reqs["openai.gpt-oss-120b-1:0"]["max_completion_tokens"] == 1000
    assert reqs["anthropic.x"]["anthropic_version"] == inference.ANTHROPIC_VERSION
    assert all(r.t == "yo" for r in rows)
    c = spark.createDataFrame([("x", '{"completion": "c"}'), ("x", "{}")], "m string, b string")
    assert [r.t for r in c.select(inference.response_text("m", "b").alias("t")).collect()] == ["c", ""]


def test_latest_ingestion_and_nesting(spark):
    a = spark.createDataFrame([("kb", "2024-01-01 00:00:00", 3), ("kb", "2024-02-01 00:00:00", 5),
                               ("other", "2024-01-05 00:00:00", 1)], "source string, started_at string, n int") \
        .withColumn("started_at", F.to_timestamp("started_at"))
    got = {r.source: r.n for r in sinks.latest_run_per_source(a).collect()}
    assert got == {"kb": 5, "other": 1}
    res = spark.createDataFrame([("c1", "m1", True, 1.0, "s", None), ("c1", "m1", True, 1.0, "s", None),
                                 ("c1", "m2", False, 2.0, None, "x")],
                                "claim_name string, model_id string, success boolean, time_seconds double, "
                                "summary string, error string")
    doc = json.loads(sinks.nest_results(res).collect()[0].json)
    assert set(doc) == {"m1", "m2"} and doc["m2"]["error"] == "x"


def test_report_lines(spark):
    from claimflow.sources import views
    r = views.model_results(spark, SF_SMALL)
    models = spark.createDataFrame(list(enumerate(views.DEFAULT_MODELS, start=1)), "model_ord int, model_id string")
    lines = ev.report_lines(r, models)
    summ = [x.line for x in lines.where("section = 'summary'").orderBy("ord").collect()]
    assert summ[1].startswith("- **Total Tests Run:** ") and summ[4].endswith("%")
    assert lines.where("section = 'timing' and ord > 10").count() == 3
    assert lines.where("section = 'claims' and ord between 11 and 999999").count() == r.count()
    failed = r.limit(1).select(F.lit("lost_claim").alias("claim_name"), F.lit(None).cast("int").alias("model_ord"),
                               F.lit(None).cast("string").alias("model_id"), F.lit(False).alias("success"),
                               F.lit(None).cast("double").alias("time_seconds"), F.lit(None).cast("string").alias("summary"),
                               F.lit("no such file").alias("error"))
    got = [x.line for x in ev.report_lines(failed, models).where("section = 'claims'").orderBy("ord").collect()]
    assert got == ["### Lost Claim", "**Error:** no such file"]


def test_knn_is_exact_far_from_the_origin(spark):
    c = spark.createDataFrame([(1, [1e8, 0.0]), (2, [1e8 + 0.3, 0.0]), (3, [1e8 + 0.6, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1e8 + 0.55, 0.0]), (7, [1e8 + 0.55, 0.0])], "qid long, qvec array<double>")
    got = kb.knn_topk(c, q, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 2, 1] and [r.rank for r in got] == [1, 2, 3]
    assert abs(got[0].d2 - 0.0025) < 1e-6
    assert kb.knn_topk(c, q.limit(0), k=3).count() == 0


def test_embedding_is_pluggable(spark):
    c = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, chunk_text string")
    got = kb.embed_chunks(c, dim=3, embed=lambda texts, dim: np.full((len(texts), dim), 2.0)).orderBy("doc_id").collect()
    assert [r.vector for r in got] == [[2.0, 2.0, 2.0], None]


def test_knn_two_level_merge_on_many_partitions(spark):
    from claimflow.sources.tables import read_table
    e = read_table(spark, SF_SMALL, "embeddings")
    rows = e.collect()
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    Q = X[10:14] * 0.5
    qdf = spark.createDataFrame([(int(i), [float(v) for v in q]) for i, q in enumerate(Q)], "qid long, qvec array<double>")
    got = kb.knn_topk(e.repartition(16), qdf, k=7).collect()
    for qi in range(len(Q)):
        d = ((X - Q[qi]) ** 2).sum(1)
        order = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:7]
        mine = [r.vec_id for r in sorted([r for r in got if r.qid == qi], key=lambda r: r.rank)]
        assert mine == [int(ids[j]) for j in order]


def test_build_index_lifecycle(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "index")
    c = spark.createDataFrame([(1, 0, "a b"), (2, 0, "c d e")], "doc_id int, chunk_no int, chunk_text string")
    e8 = kb.embed_chunks(c, dim=8)
    assert kb.build_index(e8, path, 8)[0] == "created"
    assert kb.build_index(e8, path, 8)[0] == "appended" and kb.read_index(spark, path).count() == 2
    more = spark.createDataFrame([(2, 1, "new chunk"), (1, 0, "a b")], c.schema)
    assert kb.build_index(kb.embed_chunks(more, dim=8), path, 8)[0] == "appended"
    assert kb.read_index(spark, path).count() == 3
    status, bad = kb.build_index(kb.embed_chunks(c, dim=16), path, 16)
    assert status == "rebuilt" and bad.count() == 0
    assert kb.read_index(spark, path).select(F.size("vector")).first()[0] == 16


def test_spread_only_widens_small_inputs(spark):
    from claimflow.sources.parallel import spread
    small = spark.range(10).coalesce(1)
    assert spread(small, 4).rdd.getNumPartitions() == 4
    wide = spark.range(100).repartition(6)
    assert spread(wide, 4) is wide  # enough splits: no extra shuffle


def test_scan_deals_files_by_size_and_keeps_unreadable_ones(spark, tmpdir_path):
    from claimflow.sources import documents
    root = os.path.join(tmpdir_path, "landing")
    os.makedirs(os.path.join(root, "policies/deep"))
    for k in range(120):
        with open(os.path.join(root, "policies", f"p{k}.txt"), "w", encoding="utf-8") as f:
            f.write("é" * (30_000 if k % 40 == 0 else 500))
    with open(os.path.join(root, "policies/deep/broken.txt"), "wb") as f:
        f.write(b"abc\xff")
    open(os.path.join(root, "policies/deep/empty.txt"), "w").close()
    with open(os.path.join(root, "other.txt"), "w") as f:
        f.write("not a policy")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 64_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 100)
        scan = documents.scan_documents(spark, root, prefix="policies/")
        tasks = scan.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("size")).collect()
        rows = {r.input_key: r for r in scan.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 3 <= len(tasks) < 20 and max(r["size"] for r in tasks) <= 64_000
    assert len(rows) == 121 and "other.txt" not in rows
    broken = rows["policies/deep/broken.txt"]
    assert (broken.text, broken.reason, broken.name) == (None, "not UTF-8 text", "broken")
    assert "policies/deep/empty.txt" not in rows and rows["policies/p1.txt"].text == "é" * 500
    assert [k for k, r in rows.items() if r.reason] == ["policies/deep/broken.txt"]
    assert documents.scan_documents(spark, root, prefix="nothing/").collect() == []


def test_completeness_of_null_and_complete_claims(spark):
    df = spark.createDataFrame([(1, "Police WITNESS other", ["Police report", "Witness"]), (2, None, ["Police report"]),
                                (3, "police", []), (4, "x", None), (5, "report", ["Police report", "Witness"])],
                               "k int, e string, policy_required_info array<string>")
    got = {r.k: r.validation for r in policy.validate_completeness(df, "e").collect()}
    assert (got[1].present_fields, got[1].missing_fields, got[1].is_complete) == (["Police report", "Witness"], [], True)
    assert (got[2].present_fields, got[2].missing_fields, got[2].completeness_score) == ([], [], 0.0)
    assert (got[3].is_complete, got[3].completeness_score) == (True, 1.0)
    assert got[4].present_fields is None and got[4].missing_fields is None
    assert (got[5].present_fields, got[5].missing_fields, got[5].completeness_score) == (["Police report"], ["Witness"], 0.5)
