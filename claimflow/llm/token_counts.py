"""Token counts kept as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are
never recounted. A batch of changes (inserts, deletes, revised counts) is
turned into signed sums per key and committed under its batch id; the totals
are the sum of all committed deltas. A batch counts once however often it is
committed: its rows go to a folder of their own and one row in the commit
table names it; a second commit of the id finds that row and does nothing,
and of two commits at the same time the totals take the first by name.

Scale: deltas have one row per key, summed on the map side, so a hot source
costs no more than another; totals read the deltas only, and ``compact``
folds them into one; folds at the same time count once. Texts are read once,
to count their tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import materialise, shared_dir
from claimflow.llm.piece_codec import PieceCodec, steps
from claimflow.llm.token_shards import ByteBpe

KEYS = ("source", "lang", "tokenizer")
CHANGES = "source string, lang string, tokenizer string, change string, n_tokens long, old_tokens long"
_COMMITS = "batch_id string, path string, covers array<string>"


class TokenRollup:
    """The rollup below one folder: ``commits`` and the deltas that they name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(batch_id, path, covers): one row per committed batch, the first by path."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:  # no batch yet
            return self.spark.createDataFrame([], _COMMITS)
        first = Window.partitionBy("batch_id").orderBy("path")
        return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of changes unless its id is committed; whether it was applied now.

        ``changes`` has the columns of ``CHANGES``. ``insert`` adds a document
        and its tokens, ``delete`` takes both away, ``revise`` replaces
        ``old_tokens`` by ``n_tokens``. Null counts are zero, null keys are a
        key of their own, other kinds of change are an error.
        """
        if self.commits().where(F.col("batch_id") == batch_id).limit(1).count():
            return False
        change, n, old = F.col("change"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        bad = F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(change, F.lit("null"))))
        signed = changes.select(
            *KEYS,
            F.when(change == "insert", 1).when(change == "delete", -1).when(change == "revise", 0)
            .otherwise(bad.cast("int")).cast("long").alias("n_docs"),
            F.when(change == "insert", n).when(change == "delete", -n).otherwise(n - old).cast("long").alias("n_tokens"))
        self._record(batch_id, self._sum(signed), [])
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; keys without documents drop out."""
        return self._sum(self._deltas(self.commits())).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the committed deltas into one; their ids stay committed."""
        done = self.commits()
        ids = [r[0] for r in done.select(F.explode(F.array_append("covers", F.col("batch_id")))).distinct().collect()]
        if ids:
            self._record(f"compacted-{uuid.uuid4().hex}", self._sum(self._deltas(done)), ids)

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def _deltas(self, commits: DataFrame) -> DataFrame:
        # One row per batch, so the list is as short as the list of batches.
        paths = counted_paths([(r.batch_id, r.path, frozenset(r.covers)) for r in commits.collect()])
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _record(self, batch_id: str, delta: DataFrame, covers: list[str]) -> None:
        path = f"{self.path}/deltas/{uuid.uuid4().hex}"
        delta.write.parquet(path)
        self.spark.createDataFrame([(batch_id, path, covers)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def counted_paths(commits: list[tuple[str, str, frozenset[str]]]) -> list[str]:
    """The deltas that together count every batch once, of rows (batch id, path, ids that it covers).

    A compaction stands for the ids that it covers, other compactions among
    them. Two that ran at the same time may cover common ids without covering
    each other: the first by path counts, and what only the other covers
    counts by itself.
    """
    folds = {b: (path, covers) for b, path, covers in commits if covers}
    taken: dict[str, tuple[str, frozenset[str]]] = {}
    while folds:
        # Those that no other compaction stands for, in the order of their paths.
        inner = {b for _, covers in folds.values() for b in covers}
        outer = sorted((path, b) for b, (path, _) in folds.items() if b not in inner)
        for path, b in outer:
            covers = folds.pop(b)[1]
            if not any(covers & other for _, other in taken.values()):
                taken[b] = path, covers
        stood_for = {b for _, covers in taken.values() for b in covers}
        folds = {b: f for b, f in folds.items() if b not in stood_for}
    stood_for = {b for _, covers in taken.values() for b in covers}
    return [path for path, _ in taken.values()] + [path for b, path, covers in commits if not covers and b not in stood_for]


def token_counts(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(``id_col``, ``keep``, tokenizer, n_bytes, n_tokens) of every document under every tokenizer.

    ``tokenizers`` maps a version's name to its kind (``bytes`` of the
    tokenizers library or ``pieces`` of sentencepiece) and file. No end id is
    counted; a null text has no tokens; repeated rows count each time.
    """
    schema = T.StructType([*[docs.schema[c] for c in (id_col, *keep)], T.StructField("tokenizer", T.StringType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    width = 1 + len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: (ByteBpe if kind == "bytes" else PieceCodec)(file) for name, (kind, file) in tokenizers.items()}
        for batch in batches:
            at = 0
            for texts in steps(batch.column(width).to_pylist()):
                keys = batch.slice(at, len(texts)).columns[:width]
                sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                for name, counter in counters.items():
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array([name] * len(texts)), sizes, pa.array(counter.count(texts), pa.int64())], schema.names)
                at += len(texts)

    return docs.select(id_col, *keep, text_col).mapInArrow(count, schema)


def corpus_token_totals(docs: DataFrame, labels: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """Totals of a corpus after a load, its exact counts and the removal of toxic documents.

    Batch ``load`` inserts every document with an estimate of a token for four
    bytes; ``exact`` revises the estimates to the tokenizers' counts;
    ``removal`` deletes the documents that ``labels`` calls toxic. The load is
    delivered twice, as a feed may do. The result has a row for each source,
    language and tokenizer with documents: n_docs and n_tokens.

    A document is a row; rows with one id are removed together, rows with a
    null id never; a null source or language is a key of its own; a null text
    is a document without tokens; no documents give no rows, no labels remove
    none; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counted = materialise(token_counts(docs, tokenizers), "token-counts").withColumn(
        "estimate", F.ceil(F.col("n_bytes") / 4).cast("long"))
    rollup = TokenRollup(spark, shared_dir(spark, "token-rollup"))
    none = F.lit(None).cast("long")
    load = counted.select(*KEYS, F.lit("insert").alias("change"), F.col("estimate").alias("n_tokens"), none.alias("old_tokens"))
    exact = counted.select(*KEYS, F.lit("revise").alias("change"), "n_tokens", F.col("estimate").alias("old_tokens"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    removal = counted.join(toxic, "doc_id", "left_semi").select(
        *KEYS, F.lit("delete").alias("change"), "n_tokens", none.alias("old_tokens"))
    for batch_id, changes in (("load", load), ("exact", exact), ("load", load), ("removal", removal)):
        rollup.commit(batch_id, changes)
    return rollup.totals()
