"""SentencePiece encoding and decoding with a distinct-chunk table.

SentencePiece marks each space with U+2581 and no piece of the model has a
marker behind another character, so a marked text falls into chunks (markers
and the characters up to the next one) that are segmented independently. The
same holds on both sides of a line feed where it is in no longer piece. Each
distinct chunk of the table's span is segmented once by the library, several
in a text with line feeds between them, and documents get their ids by joining
the chunks' ids back by position. Both properties are read from the model; a
model without them is used on whole texts.

Scale: one pass without a shuffle. A table over the whole corpus would have
to be joined back to every word of it, a shuffle of several times the text;
here a task keeps a table of at most ``MAX_CHUNKS`` chunks in two halves. When
the newer half is full it becomes the older one, from which chunks that are met
again move on, so memory is bounded whatever the vocabulary and frequent chunks
stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_CHUNKS = 400_000
#: Chunks that are segmented in one text.
JOINED = 64
MARK = "▁"
#: Characters of text that are segmented before the table is looked at again.
STEP_CHARS = 1_000_000


class PieceCodec:
    """Encodes and decodes exactly as the model's processor does."""

    def __init__(self, model_file: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.end, self.max_chunks = self.model.eos_id(), max_chunks
        #: chunk -> its place among ``starts`` and ``sizes``, which say where its ids are in ``flat``.
        self.ids: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: chunk -> the number of its ids.
        self.lengths: dict[str, int] = {}
        #: The older halves of the two.
        self.old_ids, self.old_lengths = self.ids, self.lengths
        self.old_flat, self.old_starts, self.old_sizes = self.flat, self.starts, self.sizes
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i) and not self.model.is_control(i)]
        probe = " a  b\tc\r\n ééﬁ\x85 　z "
        self.by_chunk = (
            not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in plain)
            and self.model.decode(self.model.encode(probe)) == probe  # nothing is normalised
            and len(self.model.encode("\n")) == 2  # a marker before the text, and the line feed alone
        )
        self.feed = self.model.encode("\n")[-1]
        # Each id in decimal and a space, padded with zero bytes.
        decimal = [b"%d " % i for i in range(len(pieces))]
        self.digits = np.array(decimal).view(np.uint8).reshape(len(pieces), -1)
        self.widths = np.fromiter(map(len, decimal), np.int64)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text: each without its first marker, or led by a line feed; further markers are spaces."""
        if not text:
            return []
        # The marker put before the text is the first chunk's own. Each line feed
        # gets a space that only separates.
        parts = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, empty = [], 0
        for part in parts:
            if not part:
                empty += 1
            elif part[0] == "\n":
                if empty:
                    out.append(" " * (empty - 1))
                out.append(part)
                empty = 0
            else:
                out.append(" " * empty + part)
                empty = 0
        if empty:
            out.append(" " * (empty - 1))
        return out

    def segment(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, one after the other, and the number of each one's."""
        # A line feed stands alone on both sides, so it can be cut off again;
        # behind it a chunk is segmented without a marker.
        bodies = [c if c[:1] == "\n" else " " + c for c in new]
        found = self.model.encode(["\n" + "\n".join(bodies[at:at + JOINED]) + "\n" for at in range(0, len(new), JOINED)], num_threads=1)
        ids = np.fromiter(chain.from_iterable(f[2:] for f in found), np.int32)  # the marker and line feed before the first
        feeds = np.flatnonzero(ids == self.feed)
        ends = feeds[np.cumsum([1 + (c[:1] == "\n") for c in new], dtype=np.int64) - 1]
        keep = np.ones(len(ids), bool)
        keep[ends] = False
        return ids[keep], np.diff(ends, prepend=-1) - 1

    def learn(self, distinct: set[str]) -> None:
        """Bring chunks into the table: from its older half, or segmented."""
        new = distinct.difference(self.ids)
        if len(self.ids) + len(new) > self.max_chunks // 2:
            self.old_ids, self.old_flat, self.old_starts, self.old_sizes = self.ids, self.flat, self.starts, self.sizes
            self.ids, self.flat, self.starts, self.sizes, new = {}, self.flat[:0], self.starts[:0], self.sizes[:0], distinct
        again = [c for c in new if c in self.old_ids]
        if again:
            places = np.fromiter(map(self.old_ids.__getitem__, again), np.int64, len(again))
            self._add(again, _gather(self.old_flat, self.old_starts[places], self.old_sizes[places]), self.old_sizes[places])
        if len(again) < len(new):
            listed = list(new.difference(again))
            self._add(listed, *self.segment(listed))

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.update(zip(chunks, range(len(self.ids), len(self.ids) + len(chunks))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, ids)

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text, without an end id."""
        if not self.by_chunk:
            return list(map(len, self.model.encode(texts, num_threads=1)))
        split = [self.chunks(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        new = distinct.difference(self.lengths)
        if len(self.lengths) + len(new) > self.max_chunks // 2:
            self.old_lengths, self.lengths, new = self.lengths, {}, distinct
        again = [c for c in new if c in self.old_lengths]
        self.lengths.update(zip(again, map(self.old_lengths.__getitem__, again)))
        listed = list(new.difference(again))
        if listed:
            self.lengths.update(zip(listed, self.segment(listed)[1].tolist()))
        return [sum(map(self.lengths.__getitem__, parts)) for parts in split]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts with their end ids, one after the other, and where each text's begin and the last one's end."""
        if not self.by_chunk:
            found = self.model.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        else:
            split = [self.chunks(t) for t in texts]
            self.learn(set(chain.from_iterable(split)))
            edges = np.cumsum([0, *map(len, split)])
            places = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(split)), np.int64, int(edges[-1]))
            sizes = self.sizes[places]
            ids = _gather(self.flat, self.starts[places], sizes)
            sizes = np.diff(np.append(0, np.cumsum(sizes))[edges])
        bounds = np.append(0, np.cumsum(sizes + 1))
        out, inner = np.full(bounds[-1], self.end, np.int32), np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        out[inner] = ids
        return out, bounds

    def decimal(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The ids between ``bounds`` as decimal numbers joined by one space."""
        shown = self.digits[ids]
        text = memoryview(shown[shown != 0])
        at = np.append(0, np.cumsum(self.widths[ids]))[bounds].tolist()
        return [text[a:max(a, b - 1)] for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """The ids of each text with the end id, and the same as decimal text."""
        flat, bounds = self.encode_flat(texts)
        for ids, shown in zip(lists(flat, bounds), self.decimal(flat, bounds)):
            yield ids, str(shown, "ascii")

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``starts`` on, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def lists(flat: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The values between ``bounds``."""
    values, at = flat.tolist(), bounds.tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def steps(texts: list[str | None], most: int = STEP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; null is empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def piece_digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 and decoded_sha256 of every row (contract of op7).

    A null text is encoded as the empty one, whose only id is the end id; rows
    with one id or null ids each get a row; an empty table gives an empty one;
    other columns, of any name, are ignored.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            at = 0
            for texts in steps(batch.column(1).to_pylist()):
                flat, bounds = codec.encode_flat(texts)
                decoded = codec.decode(lists(flat, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.diff(bounds), pa.int64()),
                     pa.array(list(map(sha, codec.decimal(flat, bounds))), pa.string()),
                     pa.array([sha(d.encode("utf-8", "surrogatepass")) for d in decoded], pa.string())],
                    schema.names)
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def piece_encode(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` (end id included) as an int array in ``out_col``.

    An input column of that name is replaced; all others pass through.
    """
    body = docs.drop(out_col)
    schema = T.StructType([*body.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        for batch in batches:
            at = 0
            for texts in steps(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                flat, bounds = codec.encode_flat(texts)
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], schema.names)
                at += len(texts)

    return body.mapInArrow(run, schema)


def piece_decode(rows: DataFrame, model_file: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` in ``out_col``; null ids give null, no ids ''.

    An input column named ``out_col`` is replaced; all others pass through; an
    empty table gives an empty one.
    """
    body = rows.drop(out_col)
    schema = T.StructType([*body.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                texts = codec.decode([x or [] for x in ids])
                text = pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], schema.names)

    return body.mapInArrow(run, schema)
