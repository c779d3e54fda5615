"""Suffix-array dedup: remove every byte of a string of 400 bytes that starts twice.

Equal strings are brought together before any suffix is sorted. Each start of
400 bytes is named by its minimizer, the smallest hash of the 50-byte strings
inside, so equal strings have one name wherever they stand. Neighbouring
starts with one name form a region: a stretch of text of some 575 bytes.

* Regions with equal bytes are counted by hash. One that occurs twice or more
  is a repeat as a whole, so copies of any number cost one row.
* One copy of each different region with a shared name goes, with the others
  of that name, into a block whose suffix array (two-stage sorting) puts equal
  strings side by side; adjacent common prefixes of 400 bytes mark repeats.
* A name with over ``HOT_REGIONS`` different regions (a passage shorter than
  400 bytes in very many documents) or ``HOT_BYTES`` bytes of them (long runs
  of one line or character) is not sorted in one task: its starts are hashed,
  in slices of a region, and counted over the cluster.

The marked stretches are joined back to every occurrence and cut out.

Scale: hashes and positions are shuffled, and bytes only of regions that
share a name but differ; whole texts move twice, keyed by document. Documents
of any length are cut into pieces of ``PIECE`` starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import materialise
from claimflow.llm.suffix_array import repeated

#: Bytes of a repeated string (contract) and of the strings that minimizers hash.
LENGTH, GRAM = 400, 50
#: Starts of a text that are handled at once.
PIECE = 1 << 18
#: Different regions of one name that a single task sorts, and bytes of a block.
HOT_REGIONS, BLOCK_BYTES = 3000, 2_000_000
#: Bytes of the different regions of one name that a single task sorts.
HOT_BYTES = BLOCK_BYTES
#: Starts of a hot name's region that are hashed at once.
SLICE = 2048
#: Not in UTF-8, so no string of a text holds it.
SEPARATOR = b"\xff"

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on, rolled by prefix sums."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each window of ``width`` values."""
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return best(x[:-rest], x[rest:]) if rest else x


def regions(data: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> Iterator[tuple[int, int, int, int, bool]]:
    """(name, hash of the bytes, first start, starts, whether the name is in it twice) of each region.

    Every start of ``length`` bytes is in exactly one region. A region's bytes
    go from its first start to the end of the string at its last.
    """
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, piece):
        part = np.frombuffer(data, np.uint8, min(piece + length - 1, len(data) - at), at)
        h = _gram_hashes(part, gram)
        least = _sliding(h, width, np.minimum)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        count = np.diff(np.append(first, len(least)))
        # A gram is the least of some window if it is the greatest of the least around it.
        around = np.concatenate((np.full(width - 1, least[0]), least, np.full(width - 1, least[-1])))
        around[:width - 1] = 0
        around[len(around) - width + 1:] = 0
        chosen = int((h == _sliding(around, width, np.maximum)).sum())
        twice = [False] * len(first)
        if chosen > len(first):
            twice = [int((h[a:a + n + width - 1] == least[a]).sum()) > 1 for a, n in zip(first.tolist(), count.tolist())]
        for name, a, n, more in zip(least[first].tolist(), first.tolist(), count.tolist(), twice):
            begin = at + a
            yield name, xxhash.xxh3_64_intdigest(data[begin:begin + n + length - 1]), begin, n, more


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(key, version, name, region, first, n, twice): the regions of every text (binary column body)."""
    schema = T.StructType([docs.schema["key"], T.StructField("version", T.LongType()), T.StructField("name", T.LongType()),
                           T.StructField("region", T.LongType()), T.StructField("first", T.IntegerType()),
                           T.StructField("n", T.IntegerType()), T.StructField("twice", T.BooleanType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, owner = [], []
                for k, body in enumerate(part.column(2)):
                    found = list(regions(body.as_py()))
                    rows += found
                    owner += [k] * len(found)
                if rows:
                    name, region, first, n, twice = zip(*rows)
                    who = pa.array(owner, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(who), part.column(1).take(who), _signed(name), _signed(region),
                         pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(twice, pa.bool_())], schema.names)

    return docs.where(F.octet_length("body") >= LENGTH).select("key", "version", "body").mapInArrow(find, schema)


_MARKS = "name long, region long, begins array<int>, ends array<int>"


def _stretches(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of the strings at the sorted ``starts``: begins and ends."""
    cuts = np.flatnonzero(np.diff(starts) > LENGTH)
    return (starts[np.concatenate(([0], cuts + 1))].tolist(),
            (starts[np.concatenate((cuts, [len(starts) - 1]))] + LENGTH).tolist())


def _marks(rows: list[tuple[int, int, list[int], list[int]]]) -> pa.RecordBatch:
    name, region, begins, ends = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(name, pa.int64()), pa.array(region, pa.int64()), pa.array(begins, pa.list_(pa.int32())),
         pa.array(ends, pa.list_(pa.int32()))], ["name", "region", "begins", "ends"])


def _sort_block(block: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Marks of the regions of a block: the strings that start in it twice."""
    if not block:
        return
    text = np.frombuffer(SEPARATOR.join(body for *_, body in block) + SEPARATOR * 8, np.uint8)
    sizes = np.array([len(body) for *_, body in block])
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))
    starts = np.concatenate([np.arange(o, o + n - LENGTH + 1) for o, n in zip(offset.tolist(), sizes.tolist())])
    found = repeated(text, starts, LENGTH)
    owner = np.searchsorted(offset, found, side="right") - 1
    rows = []
    for k in np.unique(owner).tolist():
        mine = found[np.searchsorted(owner, k):np.searchsorted(owner, k, side="right")]
        rows.append((*block[k][:2], *_stretches(mine - offset[k])))
    if rows:
        yield _marks(rows)


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, region, body) sorted by name and region: names are gathered into blocks of ``BLOCK_BYTES``."""
    block, size = [], 0
    for batch in batches:
        for name, region, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
            new = not block or block[-1][0] != name
            if not new and block[-1][1] == region:
                continue  # fetched from a repeated row
            if new and size >= BLOCK_BYTES:
                yield from _sort_block(block)
                block, size = [], 0
            block.append((name, region, body))
            size += len(body)
    yield from _sort_block(block)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different string of a slice: 128-bit hash, number of its starts, and what they cover in the region."""
    for batch in batches:
        for name, region, at, body in zip(*batch.columns[:4]):
            at, body = at.as_py(), body.as_py()
            digests = [xxhash.xxh3_128_digest(body[i:i + LENGTH]) for i in range(len(body) - LENGTH + 1)]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0]))  # stable: starts of a string ascend
            halves, starts = halves[order], order + at
            new = np.concatenate(([True], (halves[1:] != halves[:-1]).any(axis=1)))
            cut = np.flatnonzero(new | np.concatenate(([True], np.diff(starts) > LENGTH)))
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(np.searchsorted(cut, first), len(cut)), pa.int32())
            ends = starts[np.append(cut[1:], len(starts)) - 1] + LENGTH
            m = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.as_py()] * m, pa.int64()), pa.array([region.as_py()] * m, pa.int64()), pa.array([at] * m, pa.int32()),
                 pa.array(halves[first, 0]), pa.array(halves[first, 1]), pa.array(np.diff(np.append(first, len(starts))), pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(starts[cut], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32()))],
                ["name", "region", "at", "w1", "w2", "times", "begins", "ends"])


def _hot_marks(bodies: DataFrame) -> DataFrame:
    """Marks of the regions of hot names, by counting the hashes of all their strings."""
    # A repeated row fetches its regions again.
    slices = bodies.select("name", "region", "at", "body").dropDuplicates(["name", "region", "at"])
    strings = materialise(slices.mapInArrow(
        _window_hashes, "name long, region long, at int, w1 long, w2 long, times long, begins array<int>, ends array<int>"), "suffix-hot")
    twice = strings.groupBy("w1", "w2").agg(F.sum("times").alias("all_times")).where("all_times > 1")
    found = strings.join(twice, ["w1", "w2"]).groupBy("name", "region", "at").agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, region, begins, ends in zip(*(batch.column(k) for k in (0, 1, 3, 4))):
                spans = union_of(list(zip(begins.as_py(), ends.as_py())))
                rows.append((name.as_py(), region.as_py(), [b for b, _ in spans], [e for _, e in spans]))
            if rows:
                yield _marks(rows)

    return found.mapInArrow(merge, _MARKS)


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, region, at, body, hot): the bytes of one occurrence of each wanted region, from its start ``at`` on.

    Regions of hot names come in slices of ``SLICE`` starts.
    """
    asked = wanted.groupBy(F.col("key").alias("k"), F.col("version").alias("v")).agg(
        F.collect_list(F.struct("name", "region", "first", "n", "hot")).alias("asked"))
    joined = docs.join(asked, docs["key"].eqNullSafe(asked["k"]) & (docs["version"] == asked["v"])).select("body", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, asked in zip(batch.column(0), batch.column(1)):
                data, rows = body.as_py(), asked.as_py()
                parts = [(r, at, min(at + SLICE, r["n"]) if r["hot"] else r["n"])
                         for r in rows for at in (range(0, r["n"], SLICE) if r["hot"] else (0,))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["name"] for r, _, _ in parts], pa.int64()), pa.array([r["region"] for r, _, _ in parts], pa.int64()),
                     pa.array([at for _, at, _ in parts], pa.int32()),
                     pa.array([data[r["first"] + at:r["first"] + end + LENGTH - 1] for r, at, end in parts], pa.binary()),
                     pa.array([r["hot"] for r, _, _ in parts], pa.bool_())],
                    ["name", "region", "at", "body", "hot"])

    return joined.mapInArrow(cut, "name long, region long, at int, body binary, hot boolean")


def repeated_stretches(docs: DataFrame, hot_regions: int = HOT_REGIONS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, version, spans): for each text (key, version, body) with repeats, what they cover.

    ``spans`` are structs (b, e) of byte positions, in any order, overlapping.
    """
    found = materialise(_occurrences(docs), "suffix-regions")
    classes = found.groupBy("name", "region").agg(
        F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.first("n").alias("n"),
        F.first("key").alias("key"), F.first("version").alias("version"), F.first("first").alias("first"))
    shared = classes.groupBy("name").agg(F.count(F.lit(1)).alias("regions"), F.max("twice").alias("any_twice"),
                                         F.sum(F.col("n").cast("long") + (LENGTH - 1)).alias("bytes"))
    classes = materialise(
        classes.join(shared, "name").where("times > 1 or regions > 1 or any_twice"), "suffix-classes")
    whole = classes.where("times > 1").select(
        "name", "region", F.array(F.lit(0)).alias("begins"), F.array(F.col("n") + (LENGTH - 1)).alias("ends"))
    mixed = classes.where("regions > 1 or any_twice").withColumn(
        "hot", (F.col("regions") > hot_regions) | (F.col("bytes") > hot_bytes))
    bodies = materialise(_bodies(docs, mixed), "suffix-bodies")
    sorted_marks = (
        bodies.where("not hot").select("name", "region", "body").repartition("name")
        .sortWithinPartitions("name", "region").mapInArrow(_sort_blocks, _MARKS))
    marks = whole.union(sorted_marks)
    if not bodies.where("hot").isEmpty():
        marks = marks.union(_hot_marks(bodies.where("hot")))
    marks = materialise(marks, "suffix-marks")
    spans = found.join(marks, ["name", "region"]).select(
        "key", "version", "first", F.explode(F.arrays_zip("begins", "ends")).alias("s"))
    return spans.groupBy("key", "version").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("s.begins")).alias("b"), (F.col("first") + F.col("s.ends")).alias("e"))).alias("spans"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_regions: int = HOT_REGIONS,
                 hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, kept (bytes), n_bytes, n_removed and n_spans.

    Every byte of a string of 400 bytes that also starts elsewhere, in this or
    another row, is removed; strings are judged on the input.

    Defined cases: a null or empty text, or one under 400 bytes, is kept;
    repeated rows repeat each other, whatever their ids; null ids are ids;
    an empty table gives an empty one; other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("key"), F.xxhash64(body).alias("version"), body.cast("binary").alias("body"))
    spans = repeated_stretches(docs, hot_regions, hot_bytes).withColumnsRenamed({"key": "k", "version": "v"})
    joined = docs.join(spans, docs["key"].eqNullSafe(spans["k"]) & (docs["version"] == spans["v"]), "left")
    schema = T.StructType([T.StructField(id_col, docs.schema["key"].dataType), T.StructField("kept", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for data, spans in zip(part.column(1), part.column(2)):
                    data = data.as_py()
                    gone = union_of([(s["b"], s["e"]) for s in spans.as_py() or ()])
                    ends = [0, *(e for _, e in gone)]
                    kept = b"".join(data[e:b] for e, b in zip(ends, [*(b for b, _ in gone), len(data)]))
                    rows.append((kept, len(data), len(data) - len(kept), len(gone)))
                kept, *counts = map(list, zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]], schema.names)

    return joined.select("key", "body", "spans").mapInArrow(cut, schema)


def suffix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (contract of op2)."""
    return suffix_dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
