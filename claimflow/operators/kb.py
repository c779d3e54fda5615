"""Knowledge base: chunking, embedding, dimension checks, exact k-NN retrieval
and incremental ingestion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.functions.arrays import let
from claimflow.operators.knn import IvfIndex, knn_topk  # noqa: F401
from claimflow.operators.policy import KB_SOURCE
from claimflow.sources.commits import CommittedTable, Conflict, Version
from claimflow.sources.staging import staged

# Token = maximal run of characters that are not whitespace (ASCII
# whitespace, vertical tab, and the Unicode separator categories).
WHITESPACE = r"[\s\p{Z}\x0B]+"
# The same for Python: its \\s and the separators that it leaves out.
_PY_WHITESPACE = "[\\s\u2028\u2029]+"
MAX_TOKENS = 300
OVERLAP_PCT = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def chunk_texts(text: Column, max_tokens: int = MAX_TOKENS, overlap_pct: int = OVERLAP_PCT) -> Column:
    """V1: fixed-size chunks of ``max_tokens`` words, consecutive chunks
    overlapping by ``overlap_pct`` percent (stride = size - overlap), as
    ``array<struct<chunk_text, n_words>>``."""
    stride = max_tokens - (max_tokens * overlap_pct) // 100

    def per_doc(w):
        n = F.size(w)
        count = F.greatest(F.ceil((n - max_tokens) / stride).cast("int"), F.lit(0)) + 1

        def chunk(i):
            return let(F.slice(w, i * stride + 1, max_tokens), lambda piece: F.struct(
                F.array_join(piece, " ").alias("chunk_text"), F.size(piece).alias("n_words")))
        return F.when(n == 0, F.array().cast("array<struct<chunk_text:string,n_words:int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), count - 1), chunk))
    return let(words(text), per_doc)


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep=(), max_tokens: int = MAX_TOKENS, overlap_pct: int = OVERLAP_PCT) -> DataFrame:
    """One row per chunk: ``id, chunk_no, chunk_text, n_words`` (+ ``keep``
    columns, e.g. the source location as chunk metadata). Documents with no
    word yield no chunk. Narrow: no shuffle."""
    out = df.select(id_col, *keep, F.posexplode_outer(chunk_texts(F.col(text_col), max_tokens, overlap_pct))
                    .alias("chunk_no", "c"))
    return out.where(F.col("c").isNotNull()).select(id_col, *keep, "chunk_no", "c.chunk_text", "c.n_words")


def hashed_terms(texts: list[str], dim: int) -> np.ndarray:
    """The offline embedding of ``texts``: term counts in ``dim`` buckets (the
    first 32 bits of each lower-cased word's md5), scaled to length 1."""
    bucket: dict[str, int] = {}
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for w in re.split(_PY_WHITESPACE, text.lower()):
            if w:
                if w not in bucket:
                    bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
                row[bucket[w]] += 1
        row /= np.sqrt((row * row).sum()) or 1.0
    return out


def embed_chunks(df: DataFrame, text_col: str = "chunk_text", dim: int = 1024, out_col: str = "vector",
                 embed: Callable[[list[str], int], np.ndarray] = hashed_terms) -> DataFrame:
    """V2/U4: ``embed(texts, dim)`` of each Arrow batch as ``array<double>``.

    ``embed`` is any callable from a list of texts to one vector each, e.g. a
    client of a hosted embedding model; the default works offline. A null
    text has a null vector."""
    body = df.drop(out_col)
    schema = T.StructType([*body.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                vectors = iter(embed([t for t in texts if t is not None], dim))
                values = [None if t is None else np.asarray(next(vectors), dtype=np.float64) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.list_(pa.float64()))], schema.names)

    return body.mapInArrow(run, schema)


def dimension_check(df: DataFrame, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """V3: rows whose vector has ``dim`` elements, and the rest (quarantine)."""
    ok = F.coalesce(F.size(vec_col) == dim, F.lit(False))
    return df.where(ok), df.where(~ok)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the index at ``path`` as its newest committed version names them; None before the first."""
    return CommittedTable(spark, path).read()


def build_index(chunks: DataFrame, path: str, dim: int, vec_col: str = "vector",
                key_cols: tuple[str, ...] = ("doc_id", "chunk_no"), stream: tuple[str, int] | None = None,
                content_col: str | None = None) -> tuple[str, DataFrame]:
    """V4: the embedded chunk table *is* the index. Absent -> created; present
    with the same vector dimension -> chunks with new keys are appended;
    another dimension -> rebuilt from ``chunks``. Rows of the wrong dimension
    are returned, not indexed.

    Each of these is one commit (:class:`CommittedTable`): readers see the
    index before or after it, a writer that fails leaves it as it was, and of
    two writers at the same time the second one starts again from what the
    first one left, so no key is there twice and no chunk is lost. With a
    ``content_col`` no content is, either. ``stream`` (application, epoch)
    makes a replayed epoch a no-op.
    """
    table = CommittedTable(chunks.sparkSession, path)
    ok, bad = dimension_check(chunks, vec_col, dim)
    ok = ok.dropDuplicates(list(key_cols))
    while True:
        seen = table.version()
        if stream is not None and seen.done.get(stream[0], -1) >= stream[1]:
            return "done", bad
        index = table.read(version=seen)
        if index is None:
            status, new = "created", ok
        elif seen.notes.get("dim") == dim:
            new = ok.join(index.select(*key_cols), list(key_cols), "left_anti")
            if content_col is not None:
                new = new.join(index.select(content_col).distinct(), content_col, "left_anti")
            status, new = "appended", new.select(*index.columns)
        else:
            status, new = "rebuilt", ok
        part = table.write_part(new)

        def change(now: Version) -> Version:
            if now.number != seen.number:
                raise Conflict("another writer was first")
            now.parts = ([] if status == "rebuilt" else now.parts) + [part]
            now.notes["dim"] = dim
            return now
        try:
            table.commit(change, *(stream or ()))
            return status, bad
        except Conflict:
            continue


def compact_index(spark: SparkSession, path: str, key_cols: tuple[str, ...] = ("doc_id", "chunk_no")) -> None:
    """Put the parts of all commits so far into one, ordered by key; appends meanwhile stay."""
    table = CommittedTable(spark, path)
    seen = table.version()
    if len(seen.parts) > 1:
        merged = table.write_part(table.read(version=seen).repartitionByRange(*key_cols).sortWithinPartitions(*key_cols))
        table.replace(seen.names(), [merged])


def sync_index(documents: DataFrame, path: str, dim: int = 1024, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = (), embed: Callable[[list[str], int], np.ndarray] = hashed_terms,
               stream: tuple[str, int] | None = None) -> tuple[str, DataFrame, DataFrame]:
    """V8: chunk, embed, check and append the documents that the index lacks,
    by content: one document of each new text.

    Returns the status, the rows of a wrong dimension, and the run's
    ingestion statistics (A13). The documents are hashed in one scan, which
    leaves a narrow row per content; the statistics are sums over those rows
    and need no scan of their own.
    """
    spark = documents.sparkSession
    hashed = documents.withColumn("content_hash", content_hash(text_col))
    per = hashed.groupBy("content_hash").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n"))
    index = read_index(spark, path)
    if index is None:
        per = per.withColumn("in_index", F.lit(False))
    else:
        known = index.select("content_hash").distinct().withColumn("in_index", F.lit(True))
        per = per.join(known, "content_hash", "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    per = staged(per, "kb-contents")
    first = per.where(~F.col("in_index")).select("content_hash", id_col)
    new = hashed.join(first, [id_col, "content_hash"], "left_semi")
    chunks = chunk_documents(new, id_col, text_col, keep=("content_hash", *keep))
    status, bad = build_index(embed_chunks(chunks, dim=dim, embed=embed), path, dim, key_cols=(id_col, "chunk_no"), stream=stream, content_col="content_hash")
    return status, bad, _ingest_totals(per)


def label_centroids(df: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                    out_col: str = "qvec") -> DataFrame:
    """Mean vector per label (MLlib ``Summarizer``: partial aggregation, one
    row per label and partition crosses the shuffle)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(label_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("__v"))
    agg = v.groupBy(label_col).agg(Summarizer.mean(F.col("__v")).alias("__m"))
    return agg.select(label_col, vector_to_array("__m").alias(out_col))


def with_score(df: DataFrame, d2_col: str = "d2") -> DataFrame:
    """Similarity score for retrieval results: ``1 / (1 + d2)``."""
    return df.withColumn("score", 1.0 / (1.0 + F.col(d2_col)))


def retrieval_results(knn: DataFrame, contents: DataFrame, id_cols: tuple[str, ...], content_col: str,
                      location_col: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """V5 result shape per query: ``array<struct<rank, content, score, location,
    metadata>>`` in rank order (at most k per query, so the list is bounded).
    ``metadata`` maps the keys of the metadata map to columns of ``contents``."""
    entries = [x for name, c in (metadata or {}).items() for x in (F.lit(name), F.col(c).cast("string"))]
    tags = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    j = with_score(knn).join(contents, list(id_cols))
    return j.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col(content_col).alias("content"), "score", F.col(location_col).alias("location"),
        F.to_json(tags).alias("metadata")))).alias("results"))


def content_hash(text) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def hashed_documents(documents: DataFrame, indexed_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, content_hash, in_index) of every document: the text is
    hashed in the scan and only narrow rows are joined with the indexed ids."""
    narrow = documents.select(id_col, *keep, content_hash(text_col).alias("content_hash"))
    done = indexed_ids.select(id_col).distinct().withColumn("in_index", F.lit(True))
    return narrow.join(done, id_col, "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))


def new_documents(hashed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contents of which no document is in the index, with their
    smallest id. One aggregation over :func:`hashed_documents`, partial before
    its shuffle, so a hot duplicate costs no more than another."""
    per = hashed.groupBy("content_hash").agg(F.min(id_col).alias(id_col), F.max("in_index").alias("in_index"))
    return per.where(~F.col("in_index")).select("content_hash", id_col)


def ingest_stats(hashed: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Documents scanned, new documents indexed, skipped and failed, with
    the reasons of failures (``failures``: a ``reason`` per failed document).
    The status is ``FAILED`` where nothing but failures was seen."""
    per = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.max("in_index").alias("in_index"))
    return _ingest_totals(per, failures)


def _ingest_totals(per: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """A13 from one row per content: ``n`` documents, ``in_index``."""
    agg = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ok"), F.count_if(~F.col("in_index")).alias("new"))
    failed, reasons = F.lit(0), F.array().cast("array<string>")
    if failures is not None:
        failed = failures.agg(F.count(F.lit(1))).scalar()
        # One entry per kind of failure, not per document.
        reasons = failures.agg(F.sort_array(F.collect_set("reason"))).scalar()
    return agg.select(
        (F.col("ok") + failed).cast("bigint").alias("documents_scanned"),
        F.col("new").cast("bigint").alias("new_documents_indexed"),
        (F.col("ok") - F.col("new")).cast("bigint").alias("documents_skipped"),
        failed.cast("bigint").alias("documents_failed"),
        reasons.alias("failure_reasons"),
        F.when((failed > 0) & (F.col("ok") == 0), F.lit("FAILED")).otherwise(F.lit("COMPLETE")).alias("status"))


def ingest_stats_by_source(hashed: DataFrame, source_col: str = "source") -> DataFrame:
    """A13 per data source: documents scanned and contents of the source of
    which no source has a document in the index."""
    per = hashed.groupBy(source_col, "content_hash").agg(
        F.count(F.lit(1)).alias("n"), F.max("in_index").alias("in_index"))
    seen = per.where("in_index").select("content_hash").distinct().withColumn("seen", F.lit(True))
    return per.join(seen, "content_hash", "left").groupBy(source_col).agg(
        F.sum("n").cast("bigint").alias("documents_scanned"),
        F.count_if(F.col("seen").isNull()).cast("bigint").alias("new_documents_indexed"))


def context_with_fallback(df: DataFrame, kb_results_col: str, fallback_cols: dict) -> DataFrame:
    """V7: retrieval context when results exist, keyword fallback otherwise;
    ``source`` tells which one was used."""
    has_kb = F.coalesce(F.size(kb_results_col) > 0, F.lit(False))
    out = df.withColumn("source", F.when(has_kb, F.lit(KB_SOURCE)).otherwise(F.lit("fallback")))
    for name, c in fallback_cols.items():
        out = out.withColumn(name, F.when(has_kb, F.lit(None)).otherwise(c))
    return out
