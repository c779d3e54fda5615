"""Streams, stores and model calls that fail on the way end with the result of an undisturbed run."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from claimflow.operators import inference, kb
from claimflow.plans import stream_queries
from claimflow.sources import sinks, views
from claimflow.sources.commits import CommittedTable
from claimflow.sources.staging import shared_path
from claimflow.streaming import jobs

MODEL = views.DEFAULT_MODELS[0]


def _deliver(spark, root, rows):
    spark.createDataFrame(rows, "input_key string, text string, modified timestamp_ntz").withColumn(
        "modified", F.col("modified").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/landing")


def _row(k, text, day):
    import datetime as dt
    return f"documents/c{k}.txt", f"Claimant Name: {text}\nIncident Description: car", dt.datetime(2024, 1, day)


def _run(spark, root, client_factory=inference.OfflineClient):
    schema = "input_key string, text string, modified timestamp"
    deliveries = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    return jobs.process_deliveries(deliveries, f"{root}/out", f"{root}/bad", f"{root}/ck", MODEL, client_factory)


def _summaries(spark, root):
    return {r.output_key: r.summary for r in sinks.read_summaries(spark, f"{root}/out").collect()}


@pytest.mark.parametrize("broken", ["write_summaries", "quarantine"])
def test_arrivals_restart_in_the_middle(spark, tmpdir_path, monkeypatch, broken):
    """The second epoch dies in one of its sinks, after the model was called; the restart calls no model again for it."""
    root = f"{tmpdir_path}/arrivals"
    _deliver(spark, root, [_row(1, "A", 1), _row(2, "B", 1)])
    _deliver(spark, root, [_row(1, "A", 1), _row(2, "B2", 3), _row(3, "C", 1)])
    _deliver(spark, root, [_row(2, "B", 1), _row(2, "B1", 2)])
    calls = spark.sparkContext.accumulator(0)

    class Counting(inference.OfflineClient):
        def invoke(self, model_id, body):
            calls.add(1)
            return super().invoke(model_id, body)

    fails = {"left": 1}
    if broken == "write_summaries":
        real = sinks.write_summaries

        def failing(df, path, stream=None):
            if stream[1] == 1 and fails["left"]:
                fails["left"] = 0
                raise RuntimeError("lost")
            return real(df, path, stream)
        monkeypatch.setattr(sinks, "write_summaries", failing)
    else:
        real = CommittedTable.append

        def failing(self, df, application=None, transaction=None, **noted):
            if self.path.endswith("/bad") and transaction == 1 and fails["left"]:
                fails["left"] = 0
                raise RuntimeError("lost")
            return real(self, df, application, transaction, **noted)
        monkeypatch.setattr(CommittedTable, "append", failing)
    with pytest.raises(Exception, match="lost"):
        _run(spark, root, Counting).awaitTermination()
    _run(spark, root, Counting).awaitTermination()
    got = _summaries(spark, root)
    assert sorted(got) == [f"summaries/c{k}.txt.json" for k in (1, 2, 3)]
    assert "Claim by B2 " in got["summaries/c2.txt.json"]  # the latest version, though an older one came last
    # Versions: A, B, B2, C, B1; two calls each, and none for a repeated delivery or the repeated epoch.
    assert calls.value == 10
    assert CommittedTable(spark, f"{root}/out").read().count() == 5
    assert CommittedTable(spark, f"{root}/ck/_staging").read() is None


def test_running_feedback_counts_a_replayed_epoch_once(spark, tmpdir_path, monkeypatch):
    """An epoch is summed and committed, then the stream dies before it knows; parts are merged on the way."""
    sf = "/root/testdata/sf0.001"
    want = {(r.feedback_type, r.model_id): (r.entries, r.sum_rating)
            for r in stream_queries.feedback_running(spark, sf).collect()}
    real, fails = CommittedTable.merge_levels, {"left": 1}

    def dying(self, merge, parts=3):
        if self.version().number == 3 and fails["left"]:
            fails["left"] = 0
            raise RuntimeError("lost")
        return real(self, merge, 3)
    monkeypatch.setattr(CommittedTable, "merge_levels", dying)
    root = shared_path(spark, "feedback-replay")
    stream_queries._feedback_texts(spark, sf).select("value").repartition(9).write.text(f"{root}/landing")
    args = (spark, f"{root}/landing", f"{root}/sums", f"{root}/ck")
    with pytest.raises(Exception, match="lost"):
        jobs.running_feedback(*args, whole_files=False, max_files_per_trigger=1).awaitTermination()
    jobs.running_feedback(*args, whole_files=False, max_files_per_trigger=1).awaitTermination()
    got = {(r.feedback_type, r.model_id): (r.entries, r.sum_rating)
           for r in jobs.read_running_feedback(spark, f"{root}/sums", ("feedback_type", "model_id")).collect()}
    assert got == want
    table = CommittedTable(spark, f"{root}/sums")
    assert len(table.version().parts) <= 4
    # Sums hold a row per group and part, not the entries.
    assert table.read().count() <= 4 * len(want)


def _chunks(spark, *rows, dim=8):
    df = spark.createDataFrame(list(rows), "doc_id int, chunk_no int, chunk_text string")
    return kb.embed_chunks(df, dim=dim)


def test_a_failing_writer_leaves_the_index_as_it_was(spark, tmpdir_path):
    path = f"{tmpdir_path}/index"
    kb.build_index(_chunks(spark, (1, 0, "a"), (2, 0, "b")), path, 8)
    boom = _chunks(spark, (3, 0, "c"), dim=16).withColumn("vector", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("vector")))
    for dim in (8, 16):  # an append, and a rebuild
        with pytest.raises(Exception, match="lost"):
            kb.build_index(boom, path, dim)
        assert sorted(r.doc_id for r in kb.read_index(spark, path).collect()) == [1, 2]
    assert kb.build_index(_chunks(spark, (3, 0, "c"), dim=16), path, 16)[0] == "rebuilt"
    assert [r.doc_id for r in kb.read_index(spark, path).collect()] == [3]


def test_two_writers_repeat_and_lose_no_chunk(spark, tmpdir_path):
    """Both have read the same index before either commits."""
    path, errors = f"{tmpdir_path}/index", []
    kb.build_index(_chunks(spark, (0, 0, "zero")), path, 8)
    meet = threading.Barrier(2, timeout=60)
    real, first = CommittedTable.write_part, {"a": True, "b": True}

    def work(name, *rows):
        def together(self, df, **noted):
            part = real(self, df, **noted)
            if first[threading.current_thread().name]:
                first[threading.current_thread().name] = False
                meet.wait()
            return part
        try:
            CommittedTable.write_part = together
            kb.build_index(_chunks(spark, *rows), path, 8)
        except Exception as e:  # shown by the assertion below
            errors.append(e)
    threads = [threading.Thread(target=work, name="a", args=("a", (1, 0, "one"), (2, 0, "two"))),
               threading.Thread(target=work, name="b", args=("b", (2, 0, "two"), (3, 0, "three")))]
    try:
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        CommittedTable.write_part = real
    assert errors == []
    assert sorted(r.doc_id for r in kb.read_index(spark, path).collect()) == [0, 1, 2, 3]
    kb.compact_index(spark, path)
    assert sorted(r.doc_id for r in kb.read_index(spark, path).collect()) == [0, 1, 2, 3]
    assert len(CommittedTable(spark, path).version().parts) == 1


def test_the_summary_store_stays_small(spark, tmpdir_path):
    """Forty writes of the same keys leave a few parts, and a look-up filters each of them by key."""
    path = f"{tmpdir_path}/store"
    for n in range(40):
        sinks.write_summaries(spark.range(20).select(
            F.format_string("summaries/%02d.json", "id").alias("output_key"), F.lit(f"upload {n}").alias("input_file"),
            F.timestamp_seconds(F.lit(n)).alias("processed_at")).coalesce(1), path)
    table = CommittedTable(spark, path)
    assert len(table.version().parts) < 2 * sinks.MERGE_PARTS
    assert table.read().count() < 20 * 2 * sinks.MERGE_PARTS
    assert [r.input_file for r in sinks.read_summary(spark, path, "summaries/07.json").collect()] == ["upload 39"]
    table.remove_unnamed()
    assert sinks.read_summaries(spark, path).where("input_file = 'upload 39'").count() == 20


# --- model calls ---

def test_equal_requests_are_called_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(inference.OfflineClient):
        def invoke(self, model_id, body):
            calls.add(1)
            return super().invoke(model_id, body)

    rows = [(k, MODEL if k % 2 else "amazon.nova-pro", ["same", "other", None, ""][k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, m string, p string").repartition(7)
    out = inference.run_model(df, "m", "p", Counting, once=True).collect()
    assert len(out) == 400 and calls.value == 3  # (nova, same), (nova, null) without a call, (default, other), (default, "")
    assert all(r.text == r.p for r in out if r.p is not None)
    assert {(r.success, r.error) for r in out if r.p is None} == {(False, "no model or prompt")}
    assert len({r.request_id for r in out}) == 4


def test_calls_run_side_by_side_and_time_out(spark):
    class Slow(inference.OfflineClient):
        def invoke(self, model_id, body):
            time.sleep(30 if "hang" in body else 0.3)
            return super().invoke(model_id, body)

    df = spark.createDataFrame([(k, MODEL, f"prompt {k}") for k in range(12)] + [(99, MODEL, "hang")], "k int, m string, p string").coalesce(1)
    began = time.monotonic()
    out = {r.k: r for r in inference.run_model(df, "m", "p", Slow, concurrency=13, timeout=3.0, retries=0).collect()}
    assert time.monotonic() - began < 20
    assert out[99].error == "timed out after 3 s" and not out[99].success
    assert all(out[k].text == f"prompt {k}" for k in range(12))


def test_retries_wait_longer_each_time():
    attempts = []

    def flaky():
        attempts.append(time.monotonic())
        if len(attempts) < 4:
            raise RuntimeError("busy")
        return "ok"
    reply, error, seconds = inference.call_with_retries(flaky, retries=3, backoff=0.05)
    gaps = [b - a for a, b in zip(attempts, attempts[1:])]
    assert (reply, error) == ("ok", None) and gaps[0] >= 0.05 and gaps[1] >= 0.1 and gaps[2] >= 0.2 and seconds >= 0.35
    assert inference.call_with_retries(lambda: 1 / 0, retries=0, backoff=9.0)[1] == "division by zero"


def test_concurrent_calls_keep_their_order():
    calls = [lambda k=k: (str(k), None, time.sleep(0.01 * (k % 3)) or 0.0) for k in range(50)]
    assert [r for r, _, _ in inference.call_concurrently(calls, 7, None)] == [str(k) for k in range(50)]
    assert inference.call_concurrently([], 7, 1.0) == []


@pytest.mark.parametrize("limits", [{}, {"concurrency": 2, "timeout": 30.0}, {"once": True}])
def test_calls_in_steps_keep_every_row(spark, monkeypatch, limits):
    monkeypatch.setattr(inference, "STEP_ROWS", 1)  # so steps are 32 calls a caller
    rows = [(k, MODEL if k % 3 else None, f"prompt {k % 100}") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, m string, p string").coalesce(1)
    out = inference.run_model(df, "m", F.concat("p", F.lit("!")), **limits)
    assert {"__req", "__model", "__prompt"}.isdisjoint(out.columns)
    got = {r.k: (r.p, r.text, r.error) for r in out.collect()}
    assert got == {k: (p, f"{p}!" if m else None, None if m else "no model or prompt") for k, m, p in rows}


#: Replies of every layout and kind: plain, spaced otherwise, escaped, cut, doubled, nested, of other types, no JSON.
REPLIES = [before + text + after for before, after in [
    ('{"content": [{"type": "text", "text": ', '}]}'), ('{"content":[{"text":', '}],"usage":{"n":[1,-2e3,null,true]}}'),
    ('{"choices": [{"message": {"content": ', '}}]}'), ('{"choices":[{"message":{"role":"a","content":', '}}],"id":"x"}'),
    ('{"output": {"message": {"content": [{"text": ', '}]}}}'), ('{"text":"no","content":[{"text":', '}]}'),
    ('{"content":[{"text":"first","text":', '}]}'), ('{"content":[{"text":', ',"text":"last"}]}'),
    ('{"content":[{"text":', '}],"content":[]}'), ('{"content":[{"text":', '}],"x":NaN}'), ('{"content":[{"text":', '}]} x'),
    ('{"content":[{"text":', '}]'), ('{"content":[{"text":', ']}'), ('[{"content":[{"text":', '}]}]'), (' {"content":[{"text":', '}]}\n'),
    ('{"content":[{"x":1},{"text":', '}]}'), ('{"content":{"text":', '}}'), ('{"a":"\\"text\\":\\"","content":[{"text":', '}]}'),
    ('{"completion":"c","text":', '}'), ('', ''), ('{"cont\\u0065nt":[{"text":', '}]}'), ('{"content":[{"text":', '}],"x":"a\nb"}')]
    for text in ['"plain"', '""', '"a \\"b\\" \\\\ \\n \\u00e9 \\/"', '"é 漢 😀 \\ud83d\\ude00"', '"half \\ud800 é"', '"bad \\x"', '"tab\t"',
                 '"\\u0000"', '5', 'null', '{"k": 1.50}', '["a", "b"]', '"open']]


def test_plain_replies_are_read_as_all_others(spark, monkeypatch):
    """What the task reads itself is what Spark's parser gives for the whole reply."""
    class Fixed:
        def invoke(self, model_id, body):
            return REPLIES[int(json.loads(body)["messages"][0]["content"][0]["text"] if "nova" in model_id
                               else json.loads(body)["messages"][0]["content"])]

    # Twice, as a frame is known when it comes again.
    rows = [(m, str(k % len(REPLIES))) for m in (MODEL, "openai.gpt-oss-x", "amazon.nova-x") for k in range(2 * len(REPLIES))]
    df = spark.createDataFrame(rows, "m string, p string").coalesce(1)
    seen = lambda: [(r.m, r.p, r.text, r.success, r.error) for r in inference.run_model(df, "m", "p", Fixed).collect()]
    quick = seen()
    plain = inference._reply_texts()
    assert {m for m, p, *_ in quick if plain(m, REPLIES[int(p)]) is not None} == {m for m, _ in rows}
    monkeypatch.setattr(inference, "MAX_PLAIN_REPLY", -1)
    assert quick == seen()


def test_a_frame_is_proved_before_it_is_used():
    found = inference.TextIn(lambda r: r["a"], '"a":"')
    assert found('{"a":"x","b":1}') == "x" and found('{"a":"y \\"","b":1}') == 'y "' and len(found.known) == 1
    for other in ('{"b":{"a":"x"}}', '{"a":"x","a":"y"}', '{"a":"x"', '{"b":"\\"a":"x"}', '{"a":"x"}}', '{"a":1}', "", '{"a":"x","b":Infinity}',
                  '{"a":"x","b":' + "1" * 2000 + "}"):
        assert found(other) is None and found(other) is None
    assert len(found.known) == 1
    assert [found(f'{{"a":"x","n":{k}}}') for k in range(63)] == ["x"] * 63 and len(found.known) == 64
    assert found('{"a":"x","n":99}') is None and found('{"a":"z","n":5}') == "z"
    # A request in another layout than Spark writes is parsed.
    assert inference.OfflineClient().invoke("x", '{"messages": [{"content": "hi", "role": "user"}]}') == '{"content": [{"type": "text", "text": "hi"}]}'


@pytest.mark.parametrize("limits", [{}, {"once": True}])
def test_chain_returns_the_named_columns(spark, limits):
    rows = [(k % 50, m, None if k % 7 == 0 else f"Claimant Name: {k % 9}\nClaim Amount: $1") for k in range(200) for m in (MODEL, "amazon.nova-x", None)]
    df = spark.createDataFrame(rows, "k int, m string, t string")
    whole = inference.process_documents(df, "t", "m", **limits)
    for columns in (["k", "m", "summary"], ["summary_error", "k", "extracted_info", "extract_success"]):
        some = inference.process_documents(df, "t", "m", columns=columns, **limits)
        assert some.columns == columns
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_claims_are_dealt_evenly_behind_the_join(spark, tmpdir_path):
    """One customer with most orders, repeated and null keys: the same claims, no task with many more than another."""
    orders = [(None if k % 50 == 0 else k // 2, None if k % 41 == 0 else 7 if k % 3 else k % 20, float(k)) for k in range(3000)]
    (spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double")
     .withColumn("o_orderdate", F.timestamp_seconds(F.col("o_orderkey") * 86400)).coalesce(1).write.parquet(f"{tmpdir_path}/orders.parquet"))
    (spark.createDataFrame([(None if k == 19 else k % 18, f"C{k}") for k in range(20)], "c_custkey long, c_name string")
     .coalesce(1).write.parquet(f"{tmpdir_path}/customer.parquet"))
    plain, dealt = views.claims(spark, tmpdir_path), views.claims(spark, tmpdir_path, 2000)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    each = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) > 8 and max(each) - min(each) <= 8


def test_offline_client_reads_labels_and_quotes():
    from claimflow.operators.prompts import DEFAULT_TEMPLATES
    text = 'x Claimant Name: A "B" \\ é\nPolicy Number: \nClaimant Name: later\nClaim Amount: $5\tok'
    info = inference.OfflineClient.answer("context\n" + DEFAULT_TEMPLATES.get("extract_info").replace("{document_text}", text))
    assert info == ('{"Claimant Name":"A \\"B\\" \\\\ é","Policy Number":"","Incident Date":"","Claim Amount":"$5\\tok",'
                    '"Incident Description":""}')
    summary = DEFAULT_TEMPLATES.get("generate_summary")
    assert inference.OfflineClient.answer(summary.replace("{extracted_info}", info)) == (
        'Claim by A "B" \\ é under policy  for $5\tok, incident on : ')
    assert inference.OfflineClient.answer(summary.replace("{extracted_info}", "[1]")) == "[1]"


def test_export_gives_each_document_a_file(spark, tmpdir_path):
    """Repeated ids of a task share a file, as in a partitioned write; no document has a folder or a checksum file."""
    import os
    rows = [(k, f"text {k}\n" if k % 4 else None) for k in range(200)] + [(7, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("doc_id", F.encode("text", "UTF-8").alias("body"))
    from claimflow.sources import documents
    documents.export_documents(docs, f"file://{tmpdir_path}/documents", "doc_id", "body")
    names = [n for _, _, files in os.walk(tmpdir_path) for n in files]
    assert sorted(names) == sorted([f"doc_id={k}.txt" for k in [*range(200), None]])
    got = {r.name: r.text for r in documents.scan_documents(spark, f"file://{tmpdir_path}", prefix="documents/").collect()}
    assert len(got) == 201 and got["doc_id=8"] == "\n" and got["doc_id=9"] == "text 9\n\n" and got["doc_id=None"] == "no id\n"
    assert sorted(got["doc_id=7"].splitlines()) == ["", "again", "text 7"]


def test_a_scan_of_small_files_has_few_tasks(spark, tmpdir_path):
    from claimflow.sources import documents
    docs = spark.range(0, 3000, 1, 3).select("id", F.lit(b"x").alias("body"))
    documents.export_documents(docs, f"{tmpdir_path}/documents", "id", "body")
    scan = documents.scan_documents(spark, tmpdir_path, prefix="documents/")
    assert scan.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and scan.count() == 3000
