"""Vector code compression: product codes whose nearest entries are found with LAESA pivots.

A vector is cut into equal parts and each part is written as the index of
its nearest entry in that part's codebook. A few parts of the first codebook
serve as fixed pivots: the distances of every part to its pivots are
computed once and kept beside the vectors. In each round the pivots'
distances to the codebook's current entries are computed; by the triangle
inequality ``|d(part, pivot) - d(entry, pivot)|`` is never more than
``d(part, entry)``, so the largest of these differences orders the entries,
and an entry whose bound lies beyond the best exact distance so far is never
evaluated. The distances that decide are exact integers.

Scale: vectors are never shuffled after the table with the pivot distances
is written. A round sends at most one row per codebook component and task;
the codebooks (64 entries times the dimension) are all that reaches the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import materialise

#: Parts of a vector, entries of a part's codebook, rounds of refinement (contract), and pivots of a part.
PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
#: Components reach so far from zero that squared distances stay exact in 64 bits.
LARGEST = 1 << 28
#: Rows of a part that are compared at once.
BLOCK = 2048


def is_finite_vector(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    wide = vector.cast("array<double>")
    return F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component x, as ``array<long>``."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def part_bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and last component (exclusive) of each part; equal parts where ``parts`` divides ``width``."""
    return [(j * width // parts, (j + 1) * width // parts) for j in range(parts)]


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` of ``entries`` that lie far apart: each the farthest from those chosen before."""
    chosen = [0]
    least = _distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(entries, entries[chosen[-1]][None])[:, 0])
    return entries[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``; the squares are exact."""
    return np.sqrt(np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1).astype(np.float64))


def nearest(values: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray,
            entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (ties to the lower index), its squared distance, and the exact evaluations made.

    Every row evaluates the entry of least lower bound that it has not seen,
    until that bound lies beyond its best distance. The bounds are floating
    point, so they prune with a margin far above their rounding.
    """
    n = len(values)
    code, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    low = np.abs(to_pivots[:, 0, None] - entry_pivots[None, :, 0])
    for k in range(1, to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, k, None] - entry_pivots[None, :, k]), out=low)
    margin = 1e-9 * (1.0 + to_pivots.max(initial=0.0) + entry_pivots.max(initial=0.0))
    live, evaluations = np.arange(n), 0
    while len(live):
        entry = low.argmin(axis=1)
        go = low[np.arange(len(live)), entry] <= np.sqrt(best[live].astype(np.float64)) + margin
        live, low, entry = live[go], low[go], entry[go]
        exact = ((values[live] - entries[entry]) ** 2).sum(axis=1)
        better = (exact < best[live]) | ((exact == best[live]) & (entry < code[live]))
        code[live[better]], best[live[better]] = entry[better], exact[better]
        low[np.arange(len(live)), entry] = np.inf
        evaluations += len(live)
    return code, best, evaluations


class _Codebooks:
    """The entries of every part and the part's fixed pivots; travels to the tasks by value (a few hundred KB at most)."""

    def __init__(self, vectors: list[list[int]], parts: int, pivots: int):
        whole = np.array(vectors, np.int64)
        if len(whole) and np.abs(whole).max(initial=0) >= LARGEST:
            raise ValueError(f"components have to lie within {LARGEST} of zero")
        self.width = whole.shape[1]
        self.bounds = part_bounds(self.width, parts)
        self.entries = [whole[:, a:b].copy() for a, b in self.bounds]
        self.pivots = [choose_pivots(e, pivots) for e in self.entries]

    def to_pivots(self, values: np.ndarray) -> np.ndarray:
        """Distances of every part of every row to its part's pivots, side by side."""
        return np.concatenate([_distances(values[:, a:b], p) for (a, b), p in zip(self.bounds, self.pivots)], axis=1)

    def assign(self, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances (rows by parts), given the rows' distances to the pivots."""
        codes, errors = (np.zeros((len(values), len(self.bounds)), np.int64) for _ in range(2))
        at = 0
        for j, (a, b) in enumerate(self.bounds):
            entry_pivots = _distances(self.entries[j], self.pivots[j])
            count = entry_pivots.shape[1]
            for k in range(0, len(values), BLOCK):
                rows = slice(k, k + BLOCK)
                codes[rows, j], errors[rows, j], _ = nearest(
                    values[rows, a:b], known[rows, at:at + count], self.entries[j], entry_pivots)
            at += count
        return codes, errors

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``BLOCK`` rows, so that the work space of a task stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _with_pivot_distances(rows: DataFrame, books: _Codebooks) -> DataFrame:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            values = _matrix(batch.column("values"), books.width)
            if np.abs(values).max(initial=0) >= LARGEST:
                raise ValueError(f"components have to lie within {LARGEST} of zero")
            known = books.to_pivots(values)
            lists = pa.ListArray.from_arrays(np.arange(0, known.size + 1, known.shape[1], dtype=np.int32), known.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "known"])

    schema = T.StructType([*rows.schema.fields, T.StructField("known", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(measured, schema)


def _sums(rows: DataFrame, books: _Codebooks) -> DataFrame:
    """(part, entry, position, n, total): sums of the parts that chose each entry, one row a task at most."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in _batches(batches):
            values = _matrix(batch.column("values"), books.width)
            codes, _ = books.assign(values, _matrix(batch.column("known"), sum(len(p) for p in books.pivots)))
            for j, (a, b) in enumerate(books.bounds):
                np.add.at(totals[j], codes[:, j], values[:, a:b])
                counts[j] += np.bincount(codes[:, j], minlength=len(counts[j]))
        for j, (total, n) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(n)
            size = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * size, j, np.int32)), pa.array(np.repeat(used, size).astype(np.int32)),
                 pa.array(np.tile(np.arange(size, dtype=np.int32), len(used))),
                 pa.array(np.repeat(n[used], size)), pa.array(total[used].ravel())],
                ["part", "entry", "position", "n", "total"])

    return rows.select("values", "known").mapInArrow(summed, "part int, entry int, position int, n long, total long")


def _refine(rows: DataFrame, books: _Codebooks) -> None:
    """Replace every used entry by the floored mean of the parts that chose it."""
    means = _sums(rows, books).groupBy("part", "entry", "position").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # At most entries x dimension rows.
    for r in means.collect():
        books.entries[r.part][r.entry, r.position] = int(r.total) // r.n


def _encode(rows: DataFrame, books: _Codebooks) -> DataFrame:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            known = _matrix(batch.column("known"), sum(len(p) for p in books.pivots))
            codes, errors = books.assign(_matrix(batch.column("values"), books.width), known)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))],
                ["id", "label", "code", "error"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    return rows.select("id", "label", "values", "known").mapInArrow(encoded, schema)


def compress(items: DataFrame, id_col: str, label_col: str, values_col: str, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) for every row of ``items``.

    ``values_col`` holds integer vectors (``array<long>``). The codebooks
    start as the parts of the ``entries`` smallest ids and are refined
    ``rounds`` times; ``entries`` may be 256 at most, a code is two hex
    digits for each part.

    Defined cases: every row gets a row, repeated ones too; null ids come
    last in the order that picks the first codebook, ties of the id are taken
    by vector; rows with a null label form one group of ``label_error``; with
    fewer rows than entries the codebook is shorter; the width is that of the
    vector with the smallest id, where ``parts`` does not divide it parts
    differ by one component, and rows of another width get a null code and
    error; an empty table gives an empty one; other columns, of any name, are
    ignored; components of 2^28 or more in size are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's code is one byte: 1 to 256 entries")
    rows = items.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(values_col).alias("values"))
    by_id = (F.col("id").asc_nulls_last(), F.col("values"))
    first = rows.orderBy(*by_id).select(F.size("values").alias("w")).first()
    if first is None:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                           F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    fits = F.size("values") == first.w
    head = rows.where(fits).orderBy(*by_id).select("values").limit(entries).collect()
    books = _Codebooks([r.values for r in head], parts, pivots)
    known = materialise(_with_pivot_distances(rows.where(fits), books), "vector-codes")
    for _ in range(rounds):
        _refine(known, books)
    coded = _encode(known, books).unionByName(rows.where(~fits).select(
        "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = materialise(coded, "vector-codes-final")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label").withColumn(
        "codebooks_sha256", F.lit(books.digest()))


def vector_code_digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every finite vector (contract of op12)."""
    kept = embeddings.where(is_finite_vector(F.col("embedding"))).select(
        "vec_id", "label", quantised(F.col("embedding")).alias("values"))
    return compress(kept, "vec_id", "label", "values").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The contract of op12 in DuckDB SQL: every distance, no pivots."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
assigned{k} AS (
  SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts p JOIN book{k} b USING (part)
  QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY d, b.entry) = 1)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (
  SELECT part, entry, position, sum(x)::HUGEINT AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS position FROM assigned{k}) GROUP BY ALL),
means{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY position) AS v FROM sums{k} GROUP BY part, entry),
book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS v
  FROM kept, range({PARTS}) AS r(part)),
book0 AS (
  SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, v FROM parts
  QUALIFY entry < {ENTRIES}),{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM assigned{ROUNDS} GROUP BY vec_id),
labelled AS (SELECT k.label, c.* FROM coded c JOIN kept k USING (vec_id)),
labels_error AS (SELECT label, sum(error)::BIGINT AS label_error FROM labelled GROUP BY label)
SELECT l.vec_id, l.code, l.error, e.label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM labelled l JOIN labels_error e ON l.label IS NOT DISTINCT FROM e.label
"""


VECTOR_CODES_SQL = _sql()
