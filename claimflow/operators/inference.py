"""Model request/response JSON and pluggable batch inference.

Request and response layouts are chosen by model-id prefix. Inference runs
over Arrow batches with a client created once per partition by a factory the
caller supplies; a failure is caught per row and reported in
``success / error / time_seconds`` columns instead of failing the job.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Collection, Iterable, Iterator
from json.decoder import scanstring
from json.encoder import encode_basestring, encode_basestring_ascii

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.operators.extract import CLAIM_FIELDS
from claimflow.operators.prompts import BUILTIN_TEMPLATES, DEFAULT_TEMPLATES
from claimflow.sources.staging import staged

MAX_TOKENS = 1000
# Request format version string of the default layout.
ANTHROPIC_VERSION = "bedrock-2023-05-31"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def request_body(model_id, prompt, temperature: float = 0.0, max_tokens: int = MAX_TOKENS) -> Column:
    """M9: JSON request body for ``model_id``'s layout."""
    m, p = _c(model_id), _c(prompt)
    t = F.lit(float(temperature))
    mt = F.lit(int(max_tokens))
    msg_text = F.array(F.struct(F.lit("user").alias("role"), p.alias("content")))
    nova = F.to_json(F.struct(
        F.array(F.struct(F.lit("user").alias("role"),
                         F.array(F.struct(p.alias("text"))).alias("content"))).alias("messages"),
        F.struct(mt.alias("max_new_tokens"), t.alias("temperature")).alias("inferenceConfig")))
    openai = F.to_json(F.struct(m.alias("model"), msg_text.alias("messages"),
                                mt.alias("max_completion_tokens"), t.alias("temperature")))
    default = F.to_json(F.struct(F.lit(ANTHROPIC_VERSION).alias("anthropic_version"), mt.alias("max_tokens"),
                                 msg_text.alias("messages"), t.alias("temperature")))
    return (F.when(m.startswith("amazon.nova"), nova)
             .when(m.startswith("openai.gpt-oss"), openai)
             .otherwise(default))


def response_text(model_id, body) -> Column:
    """Generated text from a JSON response body.

    Where the layout's message is there, its text counts, empty if absent; a
    message of the default layout without text is null, which ``run_model``
    reports as a failure. Bodies of another layout give their ``completion``,
    else the empty string."""
    m, b = _c(model_id), _c(body)
    get = lambda path: F.get_json_object(b, path)
    nova, openai, default = "$.output.message.content[0]", "$.choices[0]", "$.content[0]"
    other = F.coalesce(get("$.completion"), F.lit(""))
    # The message itself is looked for only where it gives no text.
    return (F.when(m.startswith("amazon.nova"),
                   F.coalesce(get(nova + ".text"), F.when(get(nova).isNotNull(), F.lit("")).otherwise(other)))
             .when(m.startswith("openai.gpt-oss"),
                   F.coalesce(get(openai + ".message.content"), F.when(get(openai).isNotNull(), F.lit("")).otherwise(other)))
             .otherwise(F.coalesce(get(default + ".text"), F.when(get(default).isNull(), other))))


def response_body(model_id, text) -> Column:
    """The response JSON a service returns for ``model_id`` (used by the
    offline client and tests)."""
    m, t = _c(model_id), _c(text)
    nova = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))
                                       .alias("message")).alias("output")))
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    default = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")))
    return (F.when(m.startswith("amazon.nova"), nova)
             .when(m.startswith("openai.gpt-oss"), openai)
             .otherwise(default))


#: What stands before and after the document or the fields in the prompts of the chain.
_AROUND = tuple((name, *dict(BUILTIN_TEMPLATES)[name].split(slot))
                for name, slot in (("extract_info", "{document_text}"), ("generate_summary", "{extracted_info}")))


#: How a field's line begins, and its key in the reply.
_LABELS = tuple((f + ": ", f'"{f}":') for f in CLAIM_FIELDS)


def _labelled(text: str, label: str) -> str:
    """Rest of the line after the first ``label``; empty without one."""
    at = text.find(label)
    if at < 0:
        return ""
    at += len(label)
    end = text.find("\n", at)
    return text[at:] if end < 0 else text[at:end]


class TextIn:
    """Reads one string of JSON objects that differ in little else.

    Two texts of JSON that are equal up to the beginning of a string and after
    its end have this string at the same place. So where a frame, what stands
    around the string, is known to hold it at the wanted place, only the
    string is read. ``read`` takes it out of a parsed object, ``starts`` are
    the ways in which the text up to it may end. A frame is taken for known
    only if it is strict JSON that names no key twice, so every parser reads
    it alike."""

    #: Frames that are remembered, and their length at most.
    FRAMES, FRAME_CHARS = 64, 1000

    def __init__(self, read: Callable[[dict], object], *starts: str):
        self.read, self.starts, self.known = read, starts, set()

    def __call__(self, body: str) -> str | None:
        """The string; None if the whole body has to be parsed for it."""
        for start in self.starts:
            at = body.find(start)
            if at >= 0:
                break
        else:
            return None
        at += len(start)
        try:
            text, end = scanstring(body, at)
        except ValueError:
            return None
        frame = body[:at], body[end:]
        return text if frame in self.known or self._learn(*frame) else None

    def _learn(self, before: str, after: str) -> bool:
        if len(self.known) >= self.FRAMES or len(before) + len(after) > self.FRAME_CHARS:
            return False
        # Longer than anything else in the frame: where it comes out, the string stood at the wanted place.
        probe = "?" * (len(before) + len(after))
        try:
            if self.read(json.loads(f'{before}{probe}"{after}', object_pairs_hook=_once_each, parse_constant=_refused)) != probe:
                return False
        except (ValueError, LookupError, TypeError, RecursionError):
            return False
        self.known.add((before, after))
        return True


def _once_each(pairs: list[tuple[str, object]]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key is there twice")
    return found


def _refused(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def _message_text(request: dict) -> str:
    """The text of the first message of a parsed request."""
    content = request["messages"][0]["content"]
    return content if isinstance(content, str) else content[0]["text"]


def _reply_texts() -> Callable[[str, str], str | None]:
    """A function of a model and its reply: the text where it is a string at
    its layout's place (see ``response_text``), None where the reply has to be
    parsed."""
    layouts = (("amazon.nova", TextIn(lambda r: r["output"]["message"]["content"][0]["text"], '"text": "', '"text":"')),
               ("openai.gpt-oss", TextIn(lambda r: r["choices"][0]["message"]["content"], '"content": "', '"content":"')),
               ("", TextIn(lambda r: r["content"][0]["text"], '"text": "', '"text":"')))
    readers: dict[str, TextIn] = {}

    def text(model: str, reply: str) -> str | None:
        if type(reply) is not str or len(reply) > MAX_PLAIN_REPLY:
            return None
        if (reader := readers.get(model)) is None:
            reader = readers[model] = next(r for start, r in layouts if model.startswith(start))
        found = reader(reply)
        if found is None or found.isascii():
            return found
        try:
            found.encode()
        except UnicodeEncodeError:  # half a surrogate pair
            return None
        return found

    return text


class OfflineClient:
    """Deterministic stand-in for a hosted model, so jobs run without a network.

    It reads the whole prompt: an extraction prompt is answered with the
    labelled lines of its document as a JSON object, a summary prompt with a
    sentence over the fields in it, any other prompt with its own text. The
    answer comes in the layout of the model's provider.
    """

    prompt_in = TextIn(_message_text, '"content":"', '"content":[{"text":"')

    def invoke(self, model_id: str, body: str) -> str:
        prompt = self.prompt_in(body)
        text = encode_basestring_ascii(self.answer(_message_text(json.loads(body)) if prompt is None else prompt))
        if model_id.startswith("amazon.nova"):
            return '{"output": {"message": {"content": [{"text": ' + text + "}]}}}"
        if model_id.startswith("openai.gpt-oss"):
            return '{"choices": [{"message": {"content": ' + text + "}}]}"
        return '{"content": [{"type": "text", "text": ' + text + "}]}"

    @staticmethod
    def answer(prompt: str) -> str:
        for name, before, after in _AROUND:
            # Context may stand before the prompt.
            at = prompt.find(before)
            if at >= 0 and prompt.endswith(after):
                value = prompt[at + len(before):len(prompt) - len(after)]
                break
        else:
            return prompt
        if name == "extract_info":
            return "{" + ",".join([key + encode_basestring(_labelled(value, label)) for label, key in _LABELS]) + "}"
        try:
            fields = json.loads(value)
            who, policy, date, amount, what = [fields[f] for f in CLAIM_FIELDS]
        except (ValueError, KeyError, TypeError):
            return value
        return f"Claim by {who} under policy {policy} for {amount}, incident on {date}: {what}"


#: Rows whose requests and replies a task holds at a time.
STEP_ROWS = 512
#: Longer replies are not read in the task that made the call.
MAX_PLAIN_REPLY = 1_000_000
#: The longest wait between two attempts of a call, in seconds.
MAX_WAIT = 30.0


def call_with_retries(invoke: Callable[[], str], retries: int, backoff: float) -> tuple[str | None, str | None, float]:
    """(reply, error, seconds) of up to ``1 + retries`` attempts; the wait
    before a further one starts at ``backoff`` seconds and doubles, up to
    ``MAX_WAIT``. An exception of every attempt is an error, not a failure of
    the job."""
    began, error = time.monotonic(), None
    for attempt in range(retries + 1):
        if attempt and backoff > 0:
            time.sleep(min(backoff * 2 ** (attempt - 1), MAX_WAIT))
        try:
            return invoke(), None, time.monotonic() - began
        except Exception as e:  # per-row isolation
            error = str(e) or type(e).__name__
    return None, error, time.monotonic() - began


def call_concurrently(calls: list[Callable[[], tuple]], concurrency: int, timeout: float | None) -> list[tuple]:
    """The results of ``calls``, in their order, with up to ``concurrency`` of
    them running. A call that takes longer than ``timeout`` seconds, its
    retries included, gets the result ``(None, "timed out ...", timeout)``;
    its thread is left behind and its place given to the next call."""
    results: list[tuple | None] = [None] * len(calls)
    finished: queue.SimpleQueue = queue.SimpleQueue()
    running: dict[int, float] = {}
    waiting = iter(range(len(calls)))
    while True:
        while len(running) < concurrency and (k := next(waiting, None)) is not None:
            running[k] = time.monotonic()
            threading.Thread(target=lambda k=k: finished.put((k, calls[k]())), daemon=True).start()
        if not running:
            return results  # type: ignore[return-value]
        left = None if timeout is None else max(0.0, min(running.values()) + timeout - time.monotonic())
        try:
            k, result = finished.get(timeout=left)
        except queue.Empty:
            now = time.monotonic()
            for k in [k for k, began in running.items() if now - began >= timeout]:
                results[k] = (None, f"timed out after {timeout:g} s", timeout)
                del running[k]
            continue
        if running.pop(k, None) is not None:
            results[k] = result


def run_model(df: DataFrame, model_col: str, prompt_col: str | Column, client_factory: Callable[[], object] = OfflineClient,
              temperature: float = 0.0, retries: int = 2, out_prefix: str = "", concurrency: int = 1,
              timeout: float | None = None, backoff: float = 0.5, once: bool = False,
              keep: Collection[str] | None = None) -> DataFrame:
    """Call a model for every row. Adds ``text, success, error,
    time_seconds`` (of the call, its waits included). A reply that is no JSON
    object, or holds no text where its layout has one, is a failure with an
    error, like an exception of the client; a null model or prompt is one
    without a call. A prompt given as an expression is sent and not kept, and
    so are columns of ``df`` that ``keep`` does not name (default: all come back).

    A task has one client and up to ``concurrency`` calls at a time (the
    client has to allow that); each call is tried ``1 + retries`` times with a
    growing wait from ``backoff`` seconds on, and gives up after ``timeout``
    seconds. The work is spread by Spark's partitions.

    ``once``: rows with the same model and request share one call. The
    distinct requests are aggregated before they are shuffled, so a request of
    any number of rows is one row from then on; their replies are written to
    the shared folder, so a lost executor does not repeat calls that are
    paid for, and joined back. Adds ``request_id``, equal for rows that share
    a call.
    """
    row = df.withColumn("__prompt", _c(prompt_col))
    row = row.withColumn("__req", F.when(F.col("__prompt").isNotNull(), request_body(model_col, "__prompt", temperature)))
    row = row.withColumn("__model", F.col(model_col)).drop("__prompt")
    if keep is not None:
        row = row.drop(*[c for c in df.columns if c not in keep and c != model_col])
    limits = {"retries": retries, "concurrency": concurrency, "timeout": timeout, "backoff": backoff}
    if once:
        # Two hashes of which one covers the length of the model's name: equal only for equal requests.
        row = row.withColumn(out_prefix + "request_id", F.sha2(F.concat(
            F.coalesce(F.length("__model"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("__model", F.lit("")),
            F.coalesce("__req", F.lit(""))), 256))
        asked = row.groupBy(F.col(out_prefix + "request_id").alias("__key")).agg(
            F.any_value("__model").alias("__model"), F.any_value("__req").alias("__req"))
        replies = staged(_called(asked, client_factory, limits), "model-replies")
        res = row.drop("__model", "__req").join(replies, F.col(out_prefix + "request_id") == F.col("__key")).drop("__key")
    else:
        res = _called(row, client_factory, limits)
    res = res.withColumn("__parsed", F.json_object_keys("__resp").isNotNull())
    res = res.withColumn("__text", F.coalesce("__plain", F.when(F.col("__parsed"), response_text(model_col, "__resp"))))
    error = (F.when(F.col("__resp").isNull(), F.col("__err")).when(~F.col("__parsed"), F.lit("response is not a JSON object"))
              .when(F.col("__text").isNull(), F.lit("response has no text")))
    return (res.withColumn("__err", error).withColumn("__ok", F.col("__text").isNotNull())
               .withColumnsRenamed({"__text": out_prefix + "text", "__ok": out_prefix + "success",
                                    "__err": out_prefix + "error", "__secs": out_prefix + "time_seconds"})
               .drop("__plain", "__resp", "__parsed"))


def _strings(column: pa.Array) -> Iterable[str | None]:
    """The values of a column; those of strings are made all at once."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_string(column.type) else column.to_pylist()


def _called(rows: DataFrame, client_factory: Callable[[], object], limits: dict) -> DataFrame:
    """``rows`` with the text of the reply, or the reply where it is not plain, the error and the seconds of each call
    in the place of its ``__model`` and ``__req``."""
    kept = [k for k, c in enumerate(rows.columns) if c not in ("__model", "__req")]
    schema = T.StructType([*(rows.schema.fields[k] for k in kept), T.StructField("__plain", T.StringType()),
                           T.StructField("__resp", T.StringType()), T.StructField("__err", T.StringType()), T.StructField("__secs", T.DoubleType())])
    retries, backoff, timeout = limits["retries"], limits["backoff"], limits["timeout"]
    inline = limits["concurrency"] <= 1 and timeout is None
    step = max(STEP_ROWS, 32 * limits["concurrency"])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        text = _reply_texts()

        def one(model, body):
            if model is None or body is None:
                return None, "no model or prompt", 0.0
            return call_with_retries(lambda: client.invoke(model, body), retries, backoff)

        # A batch has up to 10,000 rows; only a step of them is held as Python objects and replies.
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            models, bodies = _strings(part.column("__model")), _strings(part.column("__req"))
            if inline:
                done = [one(m, b) for m, b in zip(models, bodies)]
            else:
                done = call_concurrently([lambda m=m, b=b: one(m, b) for m, b in zip(models, bodies)], max(1, limits["concurrency"]), timeout)
            replies, errors, seconds = zip(*done)
            texts = [None if r is None else text(m, r) for m, r in zip(models, replies)]
            rest = [r if t is None else None for t, r in zip(texts, replies)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in kept), pa.array(texts, pa.string()), pa.array(rest, pa.string()), pa.array(errors, pa.string()),
                 pa.array([round(s, 2) for s in seconds], pa.float64())], schema.names)

    return rows.mapInArrow(call, schema)


def process_documents(df: DataFrame, text_col: str, model_col: str,
                      client_factory: Callable[[], object] = OfflineClient, columns: Collection[str] | None = None,
                      **limits) -> DataFrame:
    """Extract (temperature 0.0) then summarise the extraction
    (temperature 0.7), both through ``run_model`` with its ``limits``.
    ``columns`` names those to return, of ``df`` and of the chain (default:
    all); others are not carried through the calls."""
    named = {"extract_text": "extracted_info", "summary_text": "summary"}

    def keep(df: DataFrame) -> list[str] | None:
        return None if columns is None else [c for c in df.columns if named.get(c, c) in columns]

    s1 = run_model(df, model_col, DEFAULT_TEMPLATES.render("extract_info", document_text=text_col), client_factory, 0.0,
                   out_prefix="extract_", keep=keep(df), **limits)
    s2 = run_model(s1, model_col, DEFAULT_TEMPLATES.render("generate_summary", extracted_info="extract_text"), client_factory, 0.7,
                   out_prefix="summary_", keep=keep(s1), **limits)
    out = s2.withColumnsRenamed(named)
    return out if columns is None else out.select(*columns)


def summary_record(df: DataFrame, key_col: str, model_col: str, processed_at: Column | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """D3 summary record: ``input_file, processed_at, model_used,
    extracted_info, summary`` plus the output key ``summaries/{basename}.json``
    and the columns ``keep``."""
    return df.select(
        F.col(key_col).alias("input_file"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"),
        F.col(model_col).alias("model_used"), "extracted_info", "summary",
        F.concat(F.lit("summaries/"), F.element_at(F.split(key_col, "/"), -1), F.lit(".json")).alias("output_key"),
        *keep,
    )
