"""Token-ID output: binary shards with a minimal perfect hash index.

Format (all integers little-endian), below one folder:

``ids/shard-*.bin``
    The ids of the documents of one key range, ascending, as unsigned 16-bit
    integers (32-bit for vocabularies above 65,536). Nothing else is in them.
``keys/*.parquet``
    One row per document: its key (id, occurrence: 0 for the first row of an
    id), its hashes, shard, offset (in ids) and n_tokens.
``shards/*.parquet``
    One row per shard: its file, the ``width`` of an id in bytes, and ``first``,
    the ids in all shards before it.
``index/part-*.bin`` and ``buckets/*.parquet``
    A minimal perfect hash for each bucket of about ``BUCKET_KEYS`` keys, and
    the file and position of each bucket. A bucket is ``n`` and ``m`` (32 bit),
    ``m`` pilots (32 bit), then ``n`` entries of fingerprint (64 bit), offset
    (64 bit), shard (32 bit) and n_tokens (32 bit). A key's group names a pilot
    and the pilot its slot, so a look-up reads one pilot and one entry; the
    stored fingerprint tells keys that were never written.

Scale: one range shuffle of the texts by id; every task streams one shard.
Buckets are hashed, so they are even, and each is built by one task from a
thousand keys. Files get the name of the task attempt that wrote them and
only the tables, which Spark commits, name files, so a repeated task or a
lost executor leaves at most an unnamed file.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimflow.llm.common import shared_dir
from claimflow.llm.piece_codec import steps

MAX_CHUNKS = 1_000_000
#: Marks that may stand behind a word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BUCKET_KEYS = 1000
#: Keys that share a pilot, on average.
GROUP_KEYS = 4


class ByteBpe:
    """Ids of a byte-level BPE of the tokenizers library, as bytes, through a table of distinct chunks.

    A chunk starts at a space or line feed whose left neighbour is no white
    space; the pre-tokenizer always starts a token there, so chunks are
    encoded independently. Words whose pre-tokens are plain go straight to the
    library's model.
    """

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.max_chunks = self.tokenizer.model, max_chunks
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.table: dict[str, bytes | None] = {}
        self.tokens: dict[str, bytes] = {}
        pre = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_chunk = (
            self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel)
            and not pre.add_prefix_space and pre.use_regex and not any(re.search(r"\s", t) for t in added)
        )
        # Letters as the model knows them: one character for each byte.
        alphabet = {b: b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = [b for b in range(256) if b not in alphabet]
        self.shown = alphabet | {b: 256 + k for k, b in enumerate(rest)}
        self.space = chr(self.shown[ord(" ")])

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _direct(self, token: str) -> bytes:
        """The ids of one pre-token: letters led by one space or none, marks, or a line feed."""
        ids = self.tokens.get(token)
        if ids is None:
            plain = token.isascii() and token != "\n"
            shown = token.replace(" ", self.space) if plain else token.encode().decode("latin1").translate(self.shown)
            ids = self.tokens[token] = self._pack([t.id for t in self.model.tokenize(shown)])
        return ids

    def learn(self, new: set[str]) -> None:
        """Encode chunks into the table. A chunk of letters, with a line feed
        before or ASCII marks behind them, is two or three pre-tokens; each goes
        to the model once. All others go through the whole tokenizer."""
        slow = []
        table, direct = self.table, self._direct
        for c in new:
            body = c[1:]
            if body.isalpha() and c[0] == " ":
                table[c] = direct(c)
                continue
            first = c[:1]
            if first != " " and first != "\n":
                body = c
            word = body.rstrip(MARKS)
            if word.isalpha():
                marks = len(body) - len(word)
                lead = direct("\n") + direct(word) if first == "\n" else direct(c[:len(c) - marks])
                table[c] = lead + direct(body[-marks:]) if marks else lead
            elif body[-1:].isspace() or not body:
                table[c] = None  # white space before the next chunk
            else:
                slow.append(c)
        for at in range(0, len(slow), 1000):
            part = slow[at:at + 1000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.table[c] = self._pack(e.ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, packed."""
        if not self.by_chunk:
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield self._pack(e.ids)
            return
        split = [t.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") for t in texts]
        distinct = set(chain.from_iterable(split))
        new = distinct.difference(self.table)  # asks the table for each chunk; a view of its keys would be gone through whole
        if len(self.table) + len(new) > self.max_chunks:
            self.table, self.tokens, new = {}, {}, distinct
        self.learn(new)
        self.table[""] = b""
        for text, parts in zip(texts, split):
            try:
                if "\0" in text:
                    raise TypeError
                yield b"".join(map(self.table.__getitem__, parts))
            except TypeError:  # white space runs: cut only behind other characters
                whole = self.tokenizer.encode_batch_fast(_CUT.split(text), add_special_tokens=False)
                yield self._pack(list(chain.from_iterable(e.ids for e in whole)))

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [len(ids) // self.dtype.itemsize for ids in self.encode(texts)]


def worker_table(path: str) -> ByteBpe:
    """The table of this Python worker. Spark reuses workers, so what one task
    has encoded serves the next ones; the table is bounded, and starts anew for
    another tokenizer. It stands in a module of its own because this one comes
    with each task."""
    state = sys.modules.setdefault("_claimflow_worker", types.ModuleType("_claimflow_worker")).__dict__
    if state.get("byte_bpe_path") != path:
        state["byte_bpe"], state["byte_bpe_path"] = ByteBpe(path), path
    return state["byte_bpe"]


_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _open(path: str):
    """The file system and path of a location, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _local(path: str) -> str:
    """Spark writes ``file:/x``, Arrow reads ``file:///x``."""
    return "file:///" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


def key_hashes(key: str, occurrence: str) -> tuple[Column, Column]:
    """128 bits of a key: where it goes, and its fingerprint."""
    return F.xxhash64(key, occurrence), F.xxhash64(F.lit(1), key, occurrence)


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0) -> None:
    """Encode ``docs`` and write ids, keys, shards, index and buckets below ``path``.

    Defined cases: a null or empty text is the end id alone; rows of one id
    lie side by side, ordered by a hash of their text, and are told apart by
    their occurrence; null ids come first and share the key null; other
    columns are not stored; an empty table gives empty tables and no shard.
    """
    spark, root = docs.sparkSession, _local(path)
    kind = docs.schema[id_col].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).repartitionByRange(n, "key")
    ranged = ranged.sortWithinPartitions("key", F.xxhash64("text"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("occurrence", T.IntegerType()),
                           T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()),
                           T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
                           T.StructField("width", T.IntegerType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        file = f"{root}/ids/shard-{shard:06d}-{task.taskAttemptId()}.bin"
        bpe, out, offset, last, occurrence = None, None, 0, object(), 0
        for batch in batches:
            at = 0
            for texts in steps(batch.column(1).to_pylist()):
                if out is None:
                    bpe = worker_table(tokenizer_file)
                    end = np.array([end_id], bpe.dtype).tobytes()
                    system, where = _open(file)
                    system.create_dir(where.rpartition("/")[0])
                    out = system.open_output_stream(where)
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                order, offsets, counts = [], [], []
                for key, ids in zip(keys.to_pylist(), bpe.encode(texts)):
                    occurrence = occurrence + 1 if key == last else 0
                    last = key
                    out.write(ids + end)
                    order.append(occurrence)
                    offsets.append(offset)
                    counts.append((len(ids) + len(end)) // bpe.dtype.itemsize)
                    offset += counts[-1]
                m = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(order, pa.int32()), pa.array([shard] * m, pa.int32()), pa.array([file] * m),
                     pa.array(offsets, pa.int64()), pa.array(counts, pa.int32()), pa.array([bpe.dtype.itemsize] * m, pa.int32())],
                    schema.names)
        if out is not None:
            out.close()

    slot, mark = key_hashes("key", "occurrence")
    ranged.mapInArrow(write, schema).withColumns({"h1": slot, "h2": mark}).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    # One row per shard, so one small window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = keys.groupBy("shard", "file", "width").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    totals.select("shard", "file", "width", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/shards")
    _write_index(keys, path)


def _mix(a: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def _groups(h1: np.ndarray, m: int) -> np.ndarray:
    return (_mix(h1) % np.uint64(m)).astype(np.int64)


def _places(h1: np.ndarray, h2: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slots under the pilots: ``pilot // n`` rehashes, ``pilot % n`` turns."""
    rehash, turn = np.divmod(pilots.astype(np.uint64), np.uint64(n))
    return ((_mix(h1 ^ _mix(h2 + rehash)) % np.uint64(n) + turn) % np.uint64(n)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and the slot of each key: a bijection onto 0..n-1. Keys must be distinct.

    Groups are placed from the largest on; a group tries all turns of its
    slots at once, then the next rehash. A single key always fits a turn.
    """
    n = len(h1)
    m = -(-n // GROUP_KEYS)
    group = _groups(h1, m)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=m)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
    first = _places(h1, h2, np.zeros(n, np.uint64), n)
    pilots, slots = np.zeros(m, np.uint32), np.zeros(n, np.int64)
    free, low = bytearray(b"\x01") * n, 0
    for g in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[g]:
            break
        rows = order[starts[g]:starts[g] + int(sizes[g])]
        low = free.index(1, low)
        for rehash in range((1 << 32) // n):
            base = (_places(h1[rows], h2[rows], np.full(len(rows), rehash * n, np.uint64), n) if rehash else first[rows]).tolist()
            turn = _turn(base, free, low) if len(set(base)) == len(base) else None
            if turn is not None:
                pilots[g] = rehash * n + turn
                for row, b in zip(rows.tolist(), base):
                    slots[row] = (b + turn) % n
                    free[(b + turn) % n] = 0
                break
        else:
            raise ValueError("equal keys in a bucket")
    return pilots, slots


def _turn(base: list[int], free: bytearray, low: int) -> int | None:
    """The turn that moves every slot of ``base`` to a free one; no slot below ``low`` is free."""
    n, rest = len(free), base[1:]
    at = low
    while at >= 0:
        turn = (at - base[0]) % n
        if all(free[(b + turn) % n] for b in rest):
            return turn
        at = free.find(1, at + 1)
    return None


ENTRY = np.dtype([("mark", "<u8"), ("offset", "<i8"), ("shard", "<u4"), ("n", "<u4")])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, its rows) from batches sorted by their column bucket."""
    left = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if left is None else pa.concat_tables([left, now])
        bucket = now.column("bucket").to_numpy()
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        at = 0
        for cut in cuts.tolist():
            yield int(bucket[at]), now.slice(at, cut - at)
            at = cut
        left = now.slice(at)
    if left is not None and len(left):
        yield int(left.column("bucket")[0].as_py()), left


def _write_index(keys: DataFrame, path: str) -> None:
    """The perfect hash of every bucket and the table of buckets."""
    spark, root = keys.sparkSession, _local(path)
    n_buckets = max(1, -(-keys.count() // BUCKET_KEYS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        file = f"{root}/index/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, at, rows = None, 0, []
        for bucket, table in _bucketed(batches):
            if out is None:
                system, where = _open(file)
                system.create_dir(where.rpartition("/")[0])
                out = system.open_output_stream(where)
            h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            pilots, slots = perfect_hash(h1, h2)
            entries = np.zeros(len(h1), ENTRY)
            entries["mark"][slots] = h2
            for field, column in (("offset", "offset"), ("shard", "shard"), ("n", "n_tokens")):
                entries[field][slots] = table.column(column).to_numpy()
            block = np.array([len(h1), len(pilots)], "<u4").tobytes() + pilots.astype("<u4").tobytes() + entries.tobytes()
            out.write(block)
            rows.append((bucket, at, len(block)))
            at += len(block)
        if out is not None:
            out.close()
            bucket, start, size = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array([file] * len(rows)),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["bucket", "index_file", "start", "size"])

    (keys.select(F.pmod("h1", F.lit(n_buckets)).alias("bucket"), "h1", "h2", "shard", "offset", "n_tokens")
     .repartition("bucket").sortWithinPartitions("bucket")
     .mapInArrow(build, "bucket long, index_file string, start long, size long")
     .withColumn("n_buckets", F.lit(n_buckets).cast("long"))
     .write.parquet(f"{path}/buckets"))


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``keys`` (key, occurrence) with shard, offset and n_tokens from the index; keys never written drop out."""
    buckets = spark.read.parquet(f"{path}/buckets")
    n_buckets = (buckets.select("n_buckets").first() or [1])[0]
    slot, mark = key_hashes("key", "occurrence")
    asked = (keys.select("key", "occurrence", slot.alias("h1"), mark.alias("h2"))
             .withColumn("bucket", F.pmod("h1", F.lit(n_buckets)))
             .join(buckets.drop("n_buckets"), "bucket"))
    schema = T.StructType([*[asked.schema[c] for c in ("key", "occurrence")], T.StructField("shard", T.IntegerType()),
                           T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.IntegerType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for _, table in _bucketed(batches):
            file, start, size = (table.column(c)[0].as_py() for c in ("index_file", "start", "size"))
            if file not in opened:
                opened.clear()
                system, where = _open(file)
                opened[file] = system.open_input_file(where)
            block = opened[file].read_at(size, start)
            n, m = np.frombuffer(block, "<u4", 2).tolist()
            pilots = np.frombuffer(block, "<u4", m, 8)
            entries = np.frombuffer(block, ENTRY, n, 8 + 4 * m)
            h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            found = entries[_places(h1, h2, pilots[_groups(h1, m)], n)]
            mine = pa.array(found["mark"] == h2)
            yield from pa.table(
                [table.column("key"), table.column("occurrence"), pa.array(found["shard"].astype(np.int32)),
                 pa.array(found["offset"]), pa.array(found["n"].astype(np.int32))], schema.names,
            ).filter(mine).combine_chunks().to_batches()

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look, schema)


def read_documents(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, occurrence, start, n_tokens, ids_crc32) of ``keys``, by keyed access to the shards.

    ``start`` counts the ids of all documents before; the checksum is taken
    over the ids read back, as unsigned 32-bit little-endian integers.
    """
    shards = spark.read.parquet(f"{path}/shards")
    found = locate(spark, path, keys).join(shards, "shard")
    schema = T.StructType([*[found.schema[c] for c in ("key", "occurrence")], T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            sums = []
            for file, offset, n, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens", "width"))):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    opened.clear()
                    system, where = _open(file)
                    opened[file] = system.open_input_file(where)
                ids = np.frombuffer(opened[file].read_at(n * size, offset * size), f"<u{size}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            start = np.array(batch.column("first")) + np.array(batch.column("offset"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("occurrence"), pa.array(start, pa.int64()),
                 batch.column("n_tokens").cast(pa.int64()), pa.array(sums, pa.int64())], schema.names)

    # A shard's reads are spread over tasks by stretches of it.
    stretch = F.floor(F.col("offset") / 1_000_000)
    return (found.withColumn("stretch", stretch).repartition("shard", "stretch").sortWithinPartitions("shard", "offset")
            .drop("stretch").mapInArrow(fetch, schema))


def token_shard_digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files (contract of op3)."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-shards")
    write_shards(docs.select("doc_id", "text"), path, tokenizer_file)
    keys = spark.read.parquet(f"{path}/keys").select("key", "occurrence")
    return read_documents(spark, path, keys).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
