"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the vector of
the segments' bit counts is its embedding. Flipping one bit moves one
coordinate by one, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance of their fingerprints. The vectors are laid on
a grid and range-joined: vectors within distance 3 are within distance 1 in
one of their two halves of 16 coordinates, so each fingerprint is stored in
its own cell of both half grids and asks there and in the cells one step
down. Candidates pass the Manhattan bound of the whole vector, then the
exact bit distance. Linked fingerprints form components.

A count of 0, 1 or 2 is written as the two bits 00, 01 or 11, which makes the
Manhattan distance the bit count of an XOR, and a step down the loss of one
bit.

Scale: exact copies meet in one fingerprint before anything is paired, so a
group of copies of any size is one node. A cell never sends its pairs
anywhere: the task that holds it returns a spanning forest. Cells above
``CELL_BLOCK`` rows are split into blocks of rows, and each pair of blocks is
a group of its own, so a crowded cell is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import LOWER, UPPER, free_name, materialise
from claimflow.llm.components import components

#: Words of a shingle and the most differing bits of a link (contract).
SHINGLE, MAX_BITS = 3, 3
#: Rows of a cell that one task compares at once.
CELL_BLOCK = 20_000

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PAIRS = np.uint64(0x5555555555555555)
_LOW_HALF = np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is in over half the shingles' XXH64 (seed 42).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle, one without words is zero.
    """
    # bytes.split() splits at exactly [\x20\x09-\x0D].
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter(
        (digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[k - 1:].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def embed(prints: np.ndarray) -> np.ndarray:
    """The segments' bit counts of each fingerprint, as two bits each (00, 01, 11)."""
    low, high = prints & _PAIRS, (prints >> np.uint64(1)) & _PAIRS
    return ((low & high) << np.uint64(1)) | low | high


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, fp): the fingerprint of every row as a signed long."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in part.column(1)), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(hashed, schema)


_CELL = "half tinyint, cell long, own boolean, fp long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in its own cell of both half grids (own) and in the cells one step down."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            fp = batch.column(0).slice(at, 5000).to_numpy(zero_copy_only=False).view(np.uint64)
            where = embed(fp)
            for half in (0, 1):
                own = (where >> np.uint64(32 * half)) & _LOW_HALF
                cells, rows = [own], [fp]
                for segment in range(16):
                    unit, two = np.uint64(1 << (2 * segment)), np.uint64(2 << (2 * segment))
                    some = (own & unit) > 0
                    # 11 loses its upper bit, 01 its lower.
                    cells.append((own ^ np.where(own & two, two, unit))[some])
                    rows.append(fp[some])
                cell, fps = np.concatenate(cells), np.concatenate(rows)
                mine = np.zeros(len(fps), bool)
                mine[:len(fp)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), half, np.int8)), pa.array(cell.view(np.int64)),
                     pa.array(mine), pa.array(fps.view(np.int64))], ["half", "cell", "own", "fp"])


def _links(fp: np.ndarray, own: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of one group.

    One of two rows must own the cell: rows one step down in the same cell
    meet in another cell if they are close.
    """
    where, tree, out = embed(fp), np.arange(len(fp)), []
    for i in np.flatnonzero(own).tolist():
        near = np.flatnonzero(np.bitwise_count(where ^ where[i]) <= max_bits)
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= max_bits]
        other = near[tree[near] != tree[i]]
        while len(other):
            out.append((i, int(other[0])))
            tree[tree == tree[other[0]]] = tree[i]
            other = other[tree[other] != tree[i]]
    return out


def _small_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links in cells of up to ``most`` rows, cells side by side in ``key``: rows compared with the d-th next."""
    where = embed(fp)
    a, b = [], []
    for d in range(1, most):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        other = same + d
        near = (np.bitwise_count(where[same] ^ where[other]) <= max_bits) & (own[same] | own[other])
        same, other = same[near], other[near]
        near = (np.bitwise_count(fp[same] ^ fp[other]) <= max_bits) & (fp[same] != fp[other])
        a.append(fp[same[near]])
        b.append(fp[other[near]])
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


SMALL_CELL = 32


def _verifier(max_bits: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may reach over several batches."""
        left = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            group = now[0]
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            left = [x[cut:] for x in now]
            yield from compare(*[x[:cut] for x in now])
        if left is not None:
            yield from compare(*left)

    def compare(group, own, fp) -> Iterator[pa.RecordBatch]:
        if not len(group):
            return
        fp, own = fp.view(np.uint64), own.astype(bool)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, len(group)))
        small = np.repeat(sizes <= SMALL_CELL, sizes)
        a, b = _small_links(group[small], fp[small], own[small], SMALL_CELL, max_bits)
        yield _edges(a, b)
        for at, n in zip(first[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
            part = fp[at:at + n]
            found = _links(part, own[at:at + n], max_bits)
            if found:
                i, j = np.array(found).T
                yield _edges(part[i], part[j])

    def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return verify


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``prints`` (column fp) as all links would.

    ``max_bits`` may be at most 3: only then two embeddings within that
    distance are within distance 1 in one half.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the half grids find links of at most 3 bits")
    cells = prints.select("fp").mapInArrow(_cells, _CELL)
    cells = materialise(cells, "simhash-cells")
    # Cells with an owner and a second row.
    sizes = cells.groupBy("half", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("owned and n > 1").drop("owned")
    rows = cells.join(sizes, ["half", "cell"])
    # A crowded cell: its rows are dealt to k blocks, and each pair of blocks is a group.
    k = F.ceil(F.col("n") / cell_block)
    block = F.pmod(F.xxhash64("fp", F.lit(7)), k)
    others = F.when(k == 1, F.array(block)).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), k - 1), lambda o: o != block))
    grouped = (
        rows.select("half", "cell", "own", "fp", block.alias("block"), F.explode(others).alias("other"))
        .select(F.xxhash64("half", "cell", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "own", "fp")
    )
    return (
        grouped.repartition("g").sortWithinPartitions("g")
        .mapInArrow(_verifier(max_bits), "a long, b long")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(``id_col``, fp, component_id) for every row; component_id is the smallest id reachable by links.

    Defined cases: a null or empty text and one of white space only have
    fingerprint zero, which links like any other; rows with equal texts share
    a fingerprint and so a component; repeated ids each get their row; a null
    id gets a row but is never a component's id unless all ids there are null;
    an empty table gives an empty one; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    nodes = materialise(distinct, "simhash-distinct")
    roots = components(near_links(nodes, max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose id is its component's id, with all their columns.

    Rows that repeat an id are one document and stay or go together; so are
    the rows with a null id, which go if any of them has a component with an
    id.
    """
    found = simhash_components(docs, id_col, text_col, shingle, max_bits)
    name = free_name(docs, "__gone")
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document (contract of op10)."""
    return simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
