"""Streaming jobs give the batch result."""

import json
import os


from claimflow.operators import feedback, inference, kb
from claimflow.sources import sinks
from claimflow.sources.commits import CommittedTable
from claimflow.streaming import jobs


def _write(root, rel, body):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(body)


def test_process_on_arrival_equals_batch(spark, tmpdir_path):
    inp = os.path.join(tmpdir_path, "in")
    _write(inp, "documents/c1.txt", "Claimant Name: A\nIncident Description: car crash")
    _write(inp, "documents/c2.txt", "Claimant Name: B\nIncident Description: water")
    out, quar, ck = (os.path.join(tmpdir_path, x) for x in ("out", "quarantine", "ck"))
    model = "anthropic.claude-3-sonnet-20240229-v1:0"
    q = jobs.process_on_arrival(spark, inp, out, quar, ck, model)
    q.awaitTermination()
    # a re-upload under another folder with the same basename overwrites the summary
    _write(inp, "archive/c1.txt", "Claimant Name: A2\nIncident Description: car crash again")
    q = jobs.process_on_arrival(spark, inp, out, quar, ck, model)
    q.awaitTermination()
    latest = {r.output_key: r for r in jobs.read_latest_summaries(spark, out).collect()}
    assert set(latest) == {"summaries/c1.txt.json", "summaries/c2.txt.json"}
    assert latest["summaries/c1.txt.json"].input_file == "archive/c1.txt"
    # batch result for the same document
    b = spark.createDataFrame([("documents/c2.txt", "Claimant Name: B\nIncident Description: water", model)],
                              "input_key string, text string, model_id string")
    expect = inference.process_documents(b, "text", "model_id").collect()[0]
    assert latest["summaries/c2.txt.json"].summary == expect.summary
    assert latest["summaries/c2.txt.json"].extracted_info == expect.extracted_info
    assert "Claim by B " in expect.summary and "Claim by A2 " in latest["summaries/c1.txt.json"].summary


def test_running_feedback_equals_batch(spark, tmpdir_path):
    root, out, ck = (os.path.join(tmpdir_path, x) for x in ("fb", "fb_out", "fb_ck"))
    entries = [{"id": "0", "feedback_type": "positive", "rating": 5, "model_id": "m1", "speed_rating": 2},
               {"id": "1", "feedback_type": "positive", "rating": 0, "model_id": "m2"}, {"id": "2", "rating": 3},
               {"id": "3", "feedback_type": None, "rating": 4, "model_id": "m1"}]
    _write(root, "feedback/bad.json", "bad{")
    for e in entries[:2]:
        _write(root, f"feedback/{e['id']}.json", json.dumps(e, indent=2))
    jobs.running_feedback(spark, root, out, ck).awaitTermination()
    for e in entries[2:]:
        _write(root, f"feedback/{e['id']}.json", json.dumps(e, indent=2))
    jobs.running_feedback(spark, root, out, ck).awaitTermination()
    good, bad = sinks.read_feedback_json(spark, root)
    assert bad.count() == 1
    total = jobs.read_running_feedback(spark, out).first()
    stats = feedback.feedback_stats(good).first()
    assert (total.entries, total.n_rating, total.sum_rating, total.average_rating) == (
        stats.total, stats.n_ratings, stats.rating_sum, stats.average_rating) == (4, 3, 12, 4.0)
    by_type = {r.feedback_type: r.entries for r in jobs.read_running_feedback(spark, out, ("feedback_type",)).collect()}
    assert by_type == {r.feedback_type: r.n_feedback for r in feedback.by_type(good).collect()} == {
        "positive": 2, "unknown": 1, None: 1}
    by_model = {r.model_id: (r.entries, r.sum_rating) for r in jobs.read_running_feedback(spark, out, ("model_id",)).collect()}
    assert by_model == {r.model_id: (r["count"], r.rating_sum) for r in feedback.by_model(good).collect()}
    dims = {r.dimension: r.rating_sum for r in feedback.dimensions(good).collect()}
    assert total.sum_speed_rating == dims["speed"] == 2


def test_kb_sync_appends_new_texts(spark, tmpdir_path):
    root, index, ck = (os.path.join(tmpdir_path, x) for x in ("kb", "index", "kbck"))
    _write(root, "policies/auto.txt", " ".join(f"w{i}" for i in range(500)))
    _write(root, "other/x.txt", "not a policy")
    jobs.kb_sync(spark, root, index, ck, dim=16).awaitTermination()
    rows = kb.read_index(spark, index).orderBy("chunk_no").collect()
    assert [r.input_key for r in rows] == ["policies/auto.txt"] * 2
    assert rows[1].n_words == 260 and len(rows[0].vector) == 16
    _write(root, "policies/copy.txt", " ".join(f"w{i}" for i in range(500)))
    _write(root, "policies/new.txt", "a new policy")
    jobs.kb_sync(spark, root, index, ck, dim=16).awaitTermination()
    got = sorted(r.input_key for r in kb.read_index(spark, index).collect())
    assert got == ["policies/auto.txt", "policies/auto.txt", "policies/new.txt"]


class _FailOnBadClient(inference.OfflineClient):
    def invoke(self, model_id, body):
        if "CORRUPT" in body:
            raise RuntimeError("model error")
        return super().invoke(model_id, body)


def test_error_isolation_goes_to_quarantine(spark, tmpdir_path):
    inp = os.path.join(tmpdir_path, "in2")
    _write(inp, "documents/ok.txt", "Claimant Name: A\nIncident Description: car")
    _write(inp, "documents/bad.txt", "CORRUPT document")
    out, quar, ck = (os.path.join(tmpdir_path, x) for x in ("out2", "quar2", "ck2"))
    q = jobs.process_on_arrival(spark, inp, out, quar, ck, "anthropic.claude-3-haiku-20240307-v1:0",
                                     client_factory=_FailOnBadClient)
    q.awaitTermination()
    assert [r.input_file for r in CommittedTable(spark, out).read().collect()] == ["documents/ok.txt"]
    bad = CommittedTable(spark, quar).read().collect()
    assert [(r.input_key, r.error) for r in bad] == [("documents/bad.txt", "model error")]
