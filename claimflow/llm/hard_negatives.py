"""Hard-negative mining with LEMP-style coordinate pruning.

All rows are cut into length buckets: they are ordered by the length of
their vectors, and each run of up to ``BUCKET`` rows becomes one packed row
that holds the vectors and, for every coordinate, the list of the bucket's
rows sorted by that coordinate of the unit vector. An anchor that needs
scores of at least t asks a bucket of lengths up to l for a cosine of at
least c = t / (|anchor| l). For a coordinate with value a in the anchor's
unit vector this confines the row's value to

    a c - sqrt((1 - c^2)(1 - a^2))  ..  a c + sqrt((1 - c^2)(1 - a^2)),

an interval of the sorted list. The intervals of the anchor's few largest
(focus) coordinates are intersected, and the rows left are scored exactly
in integers. Thresholds rise while a task goes through its buckets, longest
first, and a bucket too short for the threshold is skipped whole.

Scale: rows are sorted once into buckets. The stated query set (the anchors)
meets all rows in a grid of blocks, anchor sets times bucket groups; a task
holds one anchor set and one bucket at a time and returns a few best rows
per anchor, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import materialise
from claimflow.llm.vector_codes import is_finite_vector, quantised

#: Rows of a bucket, rows of a bucket group, anchors of a set: sizes of the blocks, without effect on the result.
BUCKET, GROUP_ROWS, ANCHOR_SET = 2048, 16_384, 1024
#: Coordinates whose feasible ranges are intersected.
FOCUS = 4
#: Room for rounding in the feasible ranges.
MARGIN = 1e-9

_BUCKET = "width int, longest double, shortest double, n int, ids binary, labels binary, vectors binary, sorted binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (width, length descending); up to ``BUCKET`` of one width become a packed row."""
    held: list[tuple[int, int, list[int]]] = []

    def packed() -> pa.RecordBatch:
        ids, labels = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
        vectors = np.array([r[2] for r in held], np.int64).reshape(len(held), -1)
        _check(vectors)
        unit, length = _units(vectors)
        order = unit.argsort(axis=0, kind="stable").T.astype("<u2")
        columns = [[vectors.shape[1]], [float(length.max())], [float(length.min())], [len(held)], [ids.tobytes()],
                   [labels.tobytes()], [vectors.astype("<i4").tobytes()], [order.tobytes()]]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          [x.split()[0] for x in _BUCKET.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("id", "label", "values"))):
            if held and (len(held) == BUCKET or len(row[2]) != len(held[0][2])):
                yield packed()
                held = []
            held.append(row)
    if held:
        yield packed()


def _check(vectors: np.ndarray) -> None:
    most = int(np.abs(vectors).max(initial=0))
    if most >= 1 << 31 or most * most * vectors.shape[1] >= 1 << 63:
        raise ValueError("components too large: inner products have to fit 64 bits")


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    wide = vectors.astype(np.float64)
    length = np.sqrt((wide * wide).sum(axis=1))
    return wide / np.where(length > 0, length, 1.0)[:, None], length


class _Bucket:
    """A packed row, opened: vectors, ids, labels, and the sorted coordinate lists with their values."""

    def __init__(self, row: dict):
        self.width, n = row["width"], row["n"]
        self.longest, self.shortest = row["longest"], row["shortest"]
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(n, self.width).astype(np.int64)
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.wide = self.vectors.astype(np.float64)
        self.lists = np.frombuffer(row["sorted"], "<u2").reshape(self.width, n)
        unit, _ = _units(self.vectors)
        self.keys = np.take_along_axis(unit.T, self.lists.astype(np.int64), axis=1)

    def candidates(self, anchor: "_Anchor", least: float) -> np.ndarray:
        """Rows that may score ``least`` or more, by the feasible ranges of the anchor's focus coordinates."""
        n = len(self.ids)
        # Over all lengths of the bucket the smallest cosine that can reach the score.
        reach = anchor.length * (self.longest if least > 0 else self.shortest)
        if least == -np.inf or reach == 0:
            return np.arange(n) if least <= 0 else np.zeros(0, np.int64)
        cosine = least / reach - MARGIN
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return np.arange(n)
        ranges = []
        for f in anchor.focus:
            a = anchor.unit[f]
            spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - a * a)))
            low = -1.0 if -a >= cosine else a * cosine - spread
            high = 1.0 if a >= cosine else a * cosine + spread
            ranges.append((f, *self.keys[f].searchsorted([low - MARGIN, high + MARGIN])))
        hits = np.zeros(n, np.uint8)
        for f, low, high in ranges:
            hits[self.lists[f, low:high]] += 1
        return np.flatnonzero(hits == len(ranges))

    def scores(self, anchor: "_Anchor", rows: np.ndarray) -> np.ndarray:
        """Exact inner products; in floating point only where every sum is an exact integer there."""
        if self.most * anchor.most * max(self.width, 1) < 1 << 53:
            return (self.wide[rows] @ anchor.wide).astype(np.int64)
        return self.vectors[rows] @ anchor.vector


class _Best:
    """The first few (score descending, id ascending) of all that was offered."""

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self, otherwise: float) -> float:
        """The score that a further row has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.size else otherwise

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            first = np.lexsort((ids, -scores))[:self.size]
            self.scores, self.ids = scores[first], ids[first]


class _Anchor:
    def __init__(self, row: dict):
        self.id, self.uid, self.label = row["id"], row["uid"], row["label"]
        self.vector = np.array(row["values"], np.int64)
        _check(self.vector[None])
        self.most = int(np.abs(self.vector).max(initial=0))
        self.wide = self.vector.astype(np.float64)
        unit, length = _units(self.vector[None])
        self.unit, self.length = unit[0], float(length[0])
        self.focus = np.argsort(-np.abs(self.unit), kind="stable")[:FOCUS]
        self.positives = row["positives"] or []


class _Positives:
    """The best rows of the anchor's label."""
    schema = "uid long, anchor_id long, place int, id long, score long"

    def __init__(self, anchor: _Anchor, options: dict):
        self.anchor, self.best = anchor, _Best(options["positives"])

    def least(self) -> float:
        return self.best.floor(-np.inf)

    def offer(self, bucket: _Bucket, rows: np.ndarray, scores: np.ndarray) -> None:
        ids = bucket.ids[rows]
        fit = (bucket.labels[rows] == self.anchor.label) & (ids != self.anchor.id) & (scores >= self.least())
        self.best.offer(scores[fit], ids[fit])

    def rows(self) -> Iterator[tuple]:
        for i, s in zip(self.best.ids.tolist(), self.best.scores.tolist()):
            yield self.anchor.uid, self.anchor.id, 0, i, s


class _Negatives:
    """For each positive the best rows of other labels between the two shares of its score."""
    schema = _Positives.schema

    def __init__(self, anchor: _Anchor, options: dict):
        self.anchor = anchor
        low, high = options["low"], options["high"]
        # low * positive <= 100 * negative <= high * positive, in integers.
        self.wanted = [(p["place"], -(-low * p["score"] // 100), high * p["score"] // 100, _Best(options["negatives"]))
                       for p in anchor.positives]
        self.wanted = [w for w in self.wanted if w[1] <= w[2]]

    def least(self) -> float:
        return min((max(low, best.floor(low)) for _, low, _, best in self.wanted), default=np.inf)

    def offer(self, bucket: _Bucket, rows: np.ndarray, scores: np.ndarray) -> None:
        fit = (bucket.labels[rows] != self.anchor.label) & (bucket.ids[rows] != self.anchor.id) & (scores >= self.least())
        ids, scores = bucket.ids[rows[fit]], scores[fit]
        for _, low, high, best in self.wanted:
            fit = (scores >= max(low, best.floor(low))) & (scores <= high)
            best.offer(scores[fit], ids[fit])

    def rows(self) -> Iterator[tuple]:
        for place, _, _, best in self.wanted:
            for i, s in zip(best.ids.tolist(), best.scores.tolist()):
                yield self.anchor.uid, self.anchor.id, place, i, s


def _search(buckets: DataFrame, anchors: DataFrame, kind: type, options: dict) -> DataFrame:
    """Every anchor against every bucket, in a grid of anchor sets and bucket groups; few best rows from each cell."""
    sizes = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    groups, sets = max(1, -(-sizes // GROUP_ROWS)), max(1, -(-anchors.count() // ANCHOR_SET))
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("uid"), F.lit(sets)).cast("int").alias("s"),
        F.lit(True).alias("asks"), F.struct("id", "uid", "label", "values", "positives").alias("anchor"))
    told = buckets.select(
        F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"),
        F.lit(False).alias("asks"), F.struct(*buckets.columns).alias("bucket"))
    cells = asking.unionByName(told, allowMissingColumns=True).repartition("g", "s").sortWithinPartitions(
        "g", "s", F.col("asks").desc(), F.col("bucket.longest").desc())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("g")[k].as_py(), batch.column("s")[k].as_py()
                if now != cell:
                    yield from _written(found)
                    cell, found = now, []
                if batch.column("asks")[k].as_py():
                    found.append(kind(_Anchor(batch.column("anchor")[k].as_py()), options))
                elif found:
                    bucket = _Bucket(batch.column("bucket")[k].as_py())
                    for f in found:
                        if len(f.anchor.vector) == bucket.width and (least := f.least()) < np.inf:
                            rows = bucket.candidates(f.anchor, least)
                            if len(rows):
                                f.offer(bucket, rows, bucket.scores(f.anchor, rows))
        yield from _written(found)

    return cells.mapInArrow(searched, kind.schema)


def _written(found: list) -> Iterator[pa.RecordBatch]:
    rows = [r for f in found for r in f.rows()]
    if rows:
        names, kinds = ["uid", "anchor_id", "place", "id", "score"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def mine_hard_negatives(items: DataFrame, id_col: str, label_col: str, values_col: str, anchor_every: int = 50,
                        positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``items`` has integer ids and labels and vectors of integers
    (``array<long>``). Anchors are the rows whose id ``anchor_every``
    divides. An anchor's positives are its first ``positives`` rows of its
    label, by falling inner product and rising id; for each of them the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 *
    score <= high * positive_score`` are returned, ranked from 1.

    Defined cases: rows with a null id, label, vector or component take no
    part; rows that repeat an id, label and vector count once; rows that share
    an id but differ are rows of their own, though never each other's
    partners; only vectors of the anchor's width are its partners; an empty
    table, and an anchor without partners, give no rows; other columns, of any
    name, are ignored; inner products beyond 64 bits are an error.
    """
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(values_col).cast("array<long>").alias("values")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("values", lambda x: x.isNotNull())).distinct()
    rows = materialise(rows.withColumn("uid", F.xxhash64("id", "label", "values")), "negatives-rows")
    length = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_length = [F.size("values"), length.desc(), F.xxhash64("id")]
    buckets = materialise(
        rows.repartitionByRange(*by_length).sortWithinPartitions(*by_length).select("id", "label", "values")
        .mapInArrow(_pack, _BUCKET), "negatives-buckets")
    options = {"positives": positives, "negatives": negatives, "low": low, "high": high}
    anchors = rows.where(F.col("id") % anchor_every == 0)
    first = Window.partitionBy("anchor_id", "uid", "place").orderBy(F.col("score").desc(), "id")
    none = F.lit(None).cast("array<struct<place:int,score:bigint>>")
    found = _search(buckets, anchors.withColumn("positives", none), _Positives, options)
    best = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    best = materialise(best, "negatives-positives")
    # At most ``positives`` rows of an anchor.
    listed = best.groupBy("anchor_id", "uid").agg(F.collect_list(F.struct("place", "score")).alias("positives"))
    asking = materialise(
        anchors.join(listed.withColumnRenamed("anchor_id", "id"), ["id", "uid"]).select("id", "uid", "label", "values", "positives"),
        "negatives-anchors")
    found = _search(buckets, asking, _Negatives, options)
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(
        best.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["anchor_id", "uid", "place"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negative_digest(embeddings: DataFrame) -> DataFrame:
    """The hard negatives of ``embeddings`` (contract of op11): every seventh id has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("label").isNotNull() & is_finite_vector(F.col("embedding"))).select(
        "vec_id", label.alias("label"), quantised(F.col("embedding")).alias("values"))
    return mine_hard_negatives(rows, "vec_id", "label", "values")


HARD_NEGATIVES_SQL = """
WITH kept AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
