"""Nearest neighbours by squared L2 distance: exact scans (V5) and an
inverted-file index (V6).

The corpus never moves to the queries' side: queries are counted and
broadcast in blocks of bounded size, every scan task streams its rows against
the block and returns its best k rows per query, and a window merges those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from claimflow.sources.staging import staged

#: Queries that are broadcast at once.
BLOCK_QUERIES = 4096
#: Distances that a task holds at once.
CELLS = 1_000_000


class Nearest:
    """The k nearest rows seen so far of each query; ties go to the smaller ids.

    Distances are screened with one matrix product, whose rounding is bounded
    from the vectors' lengths, and what may be among the best is computed as
    a sum of squared differences, so results are exact far from the origin too.
    """

    def __init__(self, queries: np.ndarray, k: int, reach: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.length2 = (queries * queries).sum(axis=1)
        #: A row farther than this cannot be among the best of a query.
        self.reach = np.full(len(queries), np.inf) if reach is None else reach.copy()
        self.query, self.d2, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def offer(self, rows: np.ndarray, ids: list[np.ndarray], asked: np.ndarray | None = None) -> None:
        """Compare ``rows`` with the queries numbered ``asked`` (all of them by default)."""
        if len(rows) and rows.shape[1] != self.queries.shape[1]:
            raise ValueError("vectors differ in width; check the dimension first")
        asked = np.arange(len(self.queries)) if asked is None else asked
        step = max(1, CELLS // max(1, len(asked)))
        for at in range(0, len(rows) if len(asked) else 0, step):
            self._tile(rows[at:at + step], [c[at:at + step] for c in ids], asked)

    def _tile(self, rows: np.ndarray, ids: list[np.ndarray], asked: np.ndarray) -> None:
        q = self.queries[asked]
        scale = self.length2[asked][:, None] + (rows * rows).sum(axis=1)[None, :]
        about = scale - 2.0 * (q @ rows.T)
        margin = scale * (8.0 * (rows.shape[1] + 8) * np.finfo(float).eps)
        reach = self.reach[asked]
        if rows.shape[0] >= self.k:
            reach = np.minimum(reach, np.partition(about + margin, self.k - 1, axis=1)[:, self.k - 1])
        who, row = np.nonzero(about - margin <= reach[:, None])
        if not len(who):
            return
        d2 = ((rows[row] - q[who]) ** 2).sum(axis=1)
        keep = d2 <= self.reach[asked[who]]
        who, row, d2 = asked[who[keep]], row[keep], d2[keep]
        if self.ids is None:
            self.ids = [c[:0] for c in ids]
        query, d2 = np.concatenate((self.query, who)), np.concatenate((self.d2, d2))
        named = [np.concatenate((old, new[row])) for old, new in zip(self.ids, ids)]
        ranks = [c if c.dtype.kind in "iuf" else np.unique(c, return_inverse=True)[1] for c in named]
        order = np.lexsort((*reversed(ranks), d2, query))
        query = query[order]
        first = np.searchsorted(query, query)
        best = np.arange(len(query)) - first < self.k
        self.query, self.d2, self.ids = query[best], d2[order][best], [c[order][best] for c in named]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.queries)) == self.k)
        self.reach[full] = np.minimum(self.reach[full], self.d2[np.searchsorted(self.query, full, side="right") - 1])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one width."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n or (n and np.any(np.diff(column.offsets.to_numpy()) != len(flat) // n)):
        raise ValueError("vectors differ in width; check the dimension first")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class Block:
    """Queries of one block: their ids, numbers and vectors."""

    def __init__(self, rows: list):
        self.qids = [r.qid for r in rows]
        self.vectors = np.array([r.vec for r in rows], dtype=np.float64)


def query_blocks(queries: DataFrame, size: int = BLOCK_QUERIES) -> Iterator[Block]:
    """The distinct queries (qid, vec) in blocks of about ``size``.

    No more than a block is on the driver at any time: it is there to be
    broadcast. Up to one block costs one job; more queries are written to the
    shared folder once and read block by block.
    """
    asked = queries.where("vec is not null").distinct()
    head = asked.limit(size + 1).collect()
    if len(head) <= size:
        if head:
            yield Block(head)
        return
    del head
    asked = staged(asked, "knn-queries")
    blocks = -(-asked.count() // size)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid", "vec"), F.lit(blocks)) == b).collect()
        if rows:
            yield Block(rows)


def _result_schema(id_fields: list[T.StructField], qid: T.DataType, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("qid", qid), T.StructField("uid", T.LongType()), *id_fields, *more,
                         T.StructField("d2", T.DoubleType())])


def _found(best: Nearest, qids: list, base: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The best rows of a task, query by query."""
    if best.ids is not None and len(best.query):
        columns = [[qids[q] for q in best.query.tolist()], best.query + base, *best.ids, best.d2]
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _vector(c: str):
    return F.col(c).cast("array<double>")


def _ranked(found: DataFrame, k: int, names: list[str]) -> DataFrame:
    w = Window.partitionBy("qid", "uid").orderBy("d2", *names)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def knn_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str | tuple[str, ...] = "vec_id",
             vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec") -> DataFrame:
    """V5/K4: exact k nearest corpus rows per query by squared L2 distance;
    ties go to the smaller id. Returns ``qid, rank``, the id columns, ``d2``.

    The corpus stays where it is scanned; only a few rows per query and task
    are shuffled. Queries are broadcast in blocks (:func:`query_blocks`), which
    runs the queries' own plan when this is called. Rows of one query id with
    different vectors are queries of their own; rows without a vector are left
    out; ids may not be null.
    """
    ids = (id_col,) if isinstance(id_col, str) else tuple(id_col)
    names = [f"id{n}" for n in range(len(ids))]
    rows = corpus.select(*[F.col(c).alias(n) for c, n in zip(ids, names)], _vector(vec_col).alias("vec")).where("vec is not null")
    asked = queries.select(F.col(qid_col).alias("qid"), _vector(qvec_col).alias("vec"))
    schema = _result_schema([rows.schema[n] for n in names], asked.schema["qid"].dataType)
    context = corpus.sparkSession.sparkContext

    def scan(block, base: int) -> Callable:
        def topk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(block.value.vectors, k)
            for batch in batches:
                if batch.num_rows:
                    best.offer(_matrix(batch.column("vec")), _columns(batch, names))
            yield from _found(best, block.value.qids, base, schema)
        return topk

    parts, base = [], 0
    for block in query_blocks(asked):
        parts.append(rows.mapInArrow(scan(context.broadcast(block), base), schema))
        base += len(block.qids)
    found = reduce(DataFrame.union, parts) if parts else corpus.sparkSession.createDataFrame([], schema)
    return _ranked(found, k, names).select("qid", "rank", *[F.col(n).alias(c) for n, c in zip(names, ids)], "d2")


# --- V6: inverted-file index ---

#: Rows per list that the centroids are fitted on, and the most of all; bytes that all centroids may take.
SAMPLE_PER_LIST, MAX_SAMPLE, CENTROID_BYTES = 256, 262_144, 64 << 20
#: Rows of a segment: longer lists are split again.
SEGMENT_ROWS = 65_536
#: Pairs of a query and a list that a block of queries may have.
BLOCK_PAIRS = 4_000_000
#: Queries that the number of probes is fitted on.
CALIBRATION_QUERIES = 256


def _nearest_list(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centroid."""
    best = Nearest(rows, 1)
    best.offer(centroids, [np.arange(len(centroids))])
    return best.ids[0], np.sqrt(best.d2)


def _distances(queries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((centroids - q) ** 2).sum(axis=1) for q in queries]))


class IvfIndex:
    """Vectors dealt to the lists of their nearest coarse centroids.

    ``path/vectors`` has the rows ordered by list (and by segment, where a
    list is long) with their distance to the centroid; ``path/centroids``, one
    row per list with its size and radius, is written last and commits the
    index. A search asks the lists in the order of their centroids' distance.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in rows], dtype=np.float64)
        self.radius = np.array([r.radius for r in rows])
        self.numbers = np.array([r.list for r in rows], np.int64)
        self.vectors = spark.read.parquet(f"{self.path}/vectors")
        self.ids = [c for c in self.vectors.columns if c not in ("list", "segment", "r", "vec")]

    @classmethod
    def build(cls, corpus: DataFrame, path: str, id_col: str | tuple[str, ...] = "vec_id", vec_col: str = "embedding",
              lists: int | None = None, seed: int = 11) -> "IvfIndex":
        """Fit the centroids and write every vector to its list.

        ``lists`` is the square root of the number of rows by default. The
        centroids come from k-means over a sample chosen by a hash of the ids,
        ``SAMPLE_PER_LIST`` rows a list and ``MAX_SAMPLE`` in all; every row is
        indexed, rows without a vector are not. Lists of more than
        ``SEGMENT_ROWS`` rows, as identical vectors make them, are split again
        into segments, so that no task gets a whole long list.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        ids = (id_col,) if isinstance(id_col, str) else tuple(id_col)
        if reserved := {"list", "segment", "r", "vec"} & set(ids):
            raise ValueError(f"reserved column names: {sorted(reserved)}")
        spark, path = corpus.sparkSession, path.rstrip("/")
        rows = corpus.select(*ids, _vector(vec_col).alias("vec")).where("vec is not null")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
        if not size.n:
            raise ValueError("an index needs at least one vector")
        most = max(1, CENTROID_BYTES // (8 * max(1, size.width)))
        lists = min(lists or max(1, round(size.n ** 0.5)), size.n, most)
        wanted = min(lists * SAMPLE_PER_LIST, MAX_SAMPLE)
        unit = 1 << 30
        sample = rows if wanted >= size.n else rows.where(
            F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(unit)) < int(unit * wanted / size.n))
        if lists > 1:
            fitted = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("vec").alias("f")))
            centres = fitted.clusterCenters()
        else:  # any point serves a single list
            centres = [rows.first().vec]
        held = spark.sparkContext.broadcast(np.array(centres, dtype=np.float64))
        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.LongType()), T.StructField("r", T.DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    number, r = _nearest_list(_matrix(batch.column("vec")), held.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(r)], schema.names)

        assigned = staged(rows.mapInArrow(assign, schema), "ivf-assigned")
        stats = assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"))
        # At most CENTROID_BYTES of centroids, whatever the corpus.
        counted = {r.list: r for r in stats.collect()}
        long = {number: -(-r.n // SEGMENT_ROWS) for number, r in counted.items() if r.n > SEGMENT_ROWS}
        segments = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])[F.col("list")] if long else F.lit(None).cast("long")
        segment = F.pmod(F.xxhash64(*ids), F.coalesce(segments, F.lit(1).cast("long")))
        dealt = assigned.withColumn("segment", segment).repartitionByRange("list", "segment").sortWithinPartitions("list", "segment")
        dealt.write.mode("overwrite").parquet(f"{path}/vectors")
        summary = [(n, held.value[n].tolist(), counted[n].n, counted[n].radius) for n in sorted(counted)]
        spark.createDataFrame(summary, "list long, centroid array<double>, n long, radius double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/centroids")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, qid_col: str = "qid",
               qvec_col: str = "qvec") -> DataFrame:
        """``qid, rank``, the id columns, ``list`` and ``d2`` of the k nearest rows in each query's ``probes`` nearest lists.

        Without ``probes`` all lists count and the result is exact: the nearest
        list gives a first bound t for the k-th distance, and the triangle
        inequality then leaves out every list whose centroid is farther than
        its radius plus t, and every row whose distance to its centroid differs
        by more than t from the query's.
        """
        asked = queries.select(F.col(qid_col).alias("qid"), _vector(qvec_col).alias("vec"))
        schema = _result_schema([self.vectors.schema[c] for c in self.ids], asked.schema["qid"].dataType,
                                T.StructField("list", T.LongType()))
        parts, base = [], 0
        for block in query_blocks(asked, max(1, min(BLOCK_QUERIES, BLOCK_PAIRS // len(self.numbers)))):
            away = _distances(block.vectors, self.centroids)
            nearest = np.argsort(away, axis=1, kind="stable")
            near = np.zeros(away.shape, bool)
            np.put_along_axis(near, nearest[:, :1 if probes is None else probes], True, axis=1)
            first = self._scan(block, base, away, near, np.full(len(away), np.inf), k, schema)
            parts.append(first)
            if probes is None:
                # At most k rows for each query of the block; the block's ids number the queries.
                first = staged(_ranked(first, k, [*self.ids]).drop("rank").select(*schema.names), "ivf-first")
                bound = np.full(len(away), np.inf)
                for r in first.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2")).where(F.col("n") == k).collect():
                    bound[r.uid - base] = r.d2
                reach = np.sqrt(bound)[:, None]
                open_ = ~near & (away - self.radius[None, :] <= reach + _slack(away, reach))
                parts[-1] = first
                parts.append(self._scan(block, base, away, open_, bound, k, schema))
            base += len(block.qids)
        found = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)
        return _ranked(found, k, self.ids).select("qid", "rank", *self.ids, "list", "d2")

    def _scan(self, block: Block, base: int, away: np.ndarray, wanted: np.ndarray, bound: np.ndarray, k: int,
              schema: T.StructType) -> DataFrame:
        """The best rows of the ``wanted`` (query, list) pairs within each query's ``bound`` (squared)."""
        lists = self.numbers[wanted.any(axis=0)]
        rows = self.vectors if len(lists) in (0, len(self.numbers)) or len(lists) > 1000 else self.vectors.where(
            F.col("list").isin([int(x) for x in lists]))
        if not len(lists):
            rows = self.vectors.where(F.lit(False))
        held = self.spark.sparkContext.broadcast((block, away, wanted, bound, {int(n): j for j, n in enumerate(self.numbers)}))
        ids = self.ids

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, away, wanted, bound, place = held.value
            best = Nearest(block.vectors, k, bound)
            for batch in batches:
                number = batch.column("list").to_numpy()
                cuts = np.flatnonzero(np.diff(number)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                    if a == b:
                        continue
                    j = place[int(number[a])]
                    asked = np.flatnonzero(wanted[:, j])
                    if not len(asked):
                        continue
                    part = batch.slice(a, b - a)
                    r, reach = part.column("r").to_numpy(), np.sqrt(best.reach[asked])[:, None]
                    close = np.abs(away[asked, j][:, None] - r[None, :]) <= reach + _slack(away[asked, j][:, None], reach)
                    asked, rows = asked[close.any(axis=1)], np.flatnonzero(close.any(axis=0))
                    part = part.take(pa.array(rows))
                    best.offer(_matrix(part.column("vec")), [*_columns(part, ids), np.full(len(rows), number[a])], asked)
            yield from _found(best, block.qids, base, schema)

        return rows.select(*ids, "list", "r", "vec").mapInArrow(scan, schema)

    def probes_for_recall(self, queries: DataFrame, k: int = 5, target: float = 0.95, qid_col: str = "qid",
                          qvec_col: str = "qvec") -> int:
        """The fewest lists to probe so that a share of ``target`` of the true neighbours of ``queries`` lies in them.

        Fitted on up to ``CALIBRATION_QUERIES`` of the queries (least hash of
        the id), which are searched exactly.
        """
        some = queries.select(F.col(qid_col).alias("qid"), _vector(qvec_col).alias("qvec")).where("qvec is not null")
        some = staged(some.orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATION_QUERIES), "ivf-calibration")
        vectors = {r.qid: np.array(r.qvec) for r in some.collect()}
        place = {int(n): j for j, n in enumerate(self.numbers)}
        needed = []
        for r in self.search(some, k).select("qid", "list").collect():
            away = _distances(vectors[r.qid][None], self.centroids)[0]
            needed.append(int(np.flatnonzero(np.argsort(away, kind="stable") == place[r.list])[0]) + 1)
        if not needed:
            return len(self.numbers)
        return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Room for the rounding of distances that are compared."""
    return 1e-9 * (a + np.where(np.isfinite(b), b, 0.0)) + 1e-12
