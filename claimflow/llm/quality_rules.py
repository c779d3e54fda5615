"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Each rule looks at one document and says whether it is rejected. A task runs
all rules over a sample of its first documents, measures what each costs and
how often it rejects, and from then on applies them in falling order of
rejections per second, stopping at the first that rejects. Measures are
computed once for a document, whichever rules ask for them, and only when
one does. The verdict is the conjunction of all rules, so the order changes
the time spent and which rule is named, never who is kept.

Scale: one pass over the rows, no shuffle, nothing sent to the driver. The
sample is taken by each task from its own rows, so it costs no scan and
follows local differences between files.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Documents of each task that all rules see, for cost and selectivity.
SAMPLE_ROWS = 128

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5


class Measures:
    """What the rules measure of one text; each value is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() splits at exactly [\x20\x09-\x0D].
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(ASCII_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five that occur twice or more, the first included.

        Windows whose 64-bit combination is unique cannot repeat; the others
        are compared word by word.
        """
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.uint64, self.n_words)
        code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        mixed = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + code[k:k + n]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        if not same.any():
            return 0
        maybe = np.zeros(n, bool)
        maybe[order[1:][same]] = maybe[order[:-1][same]] = True
        at = np.flatnonzero(maybe).tolist()
        words = self.words
        count = Counter(tuple(words[i:i + WINDOW]) for i in at)
        covered = np.zeros(self.n_words + 1, np.int64)
        for i in at:
            if count[tuple(words[i:i + WINDOW])] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
        return int((np.cumsum(covered[:-1]) > 0).sum())

    @cached_property
    def n_upper_words(self) -> int:
        """Words with capitals and no small letters (of a-z)."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def letter_share(self) -> float:
        """Share of letters in the bytes of the words; all bytes beyond ASCII count as letters."""
        raw = self.text.encode("utf-8", "surrogatepass").translate(None, ASCII_SPACE.encode())
        return len(raw.translate(None, _NO_LETTERS)) / len(raw) if raw else 0.0


_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())

Rule = tuple[str, Callable[[Measures], bool]]

#: The rules of the contract's base verdict.
BASE_RULES: list[Rule] = [
    ("few_words", lambda m: m.n_words < 10),
    ("repeated_words", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
]

#: All rules: the base and further ones with the usual, lenient thresholds.
RULES: list[Rule] = [
    *BASE_RULES,
    ("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    ("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 14 * m.n_words),
    ("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    ("capitals", lambda m: 2 * m.n_upper_words > m.n_words),
    ("few_letters", lambda m: m.letter_share < 0.5),
]


class Cascade:
    """The rules of one task, ordered after ``sample_rows`` documents."""

    def __init__(self, rules: list[Rule], sample_rows: int = SAMPLE_ROWS):
        self.order, self.left = list(rules), sample_rows
        self.cost = dict.fromkeys((name for name, _ in rules), 0.0)
        self.rejected = dict.fromkeys((name for name, _ in rules), 0)

    def verdict(self, m: Measures) -> str | None:
        """The rule that rejects the document, or None."""
        if self.left > 0:
            return self._sampled(m)
        return next((name for name, rule in self.order if rule(m)), None)

    def _sampled(self, m: Measures) -> str | None:
        found = None
        for name, rule in self.order:
            alone = Measures(m.text)  # so that no rule rides on another's measures
            began = time.perf_counter()
            bad = rule(alone)
            self.cost[name] += time.perf_counter() - began
            self.rejected[name] += bad
            found = found or (name if bad else None)
        self.left -= 1
        if not self.left:
            self.order.sort(key=lambda r: -self.rejected[r[0]] / max(self.cost[r[0]], 1e-9))
        return found


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text is judged as an empty one, which ``few_words`` rejects.
    Repeated rows are judged alike; an empty table stays empty; nothing is
    read or named but the text, so other columns may have any name.
    """
    rules = RULES if rules is None else rules

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in _pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([cascade.verdict(Measures(t)) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


#: Measures of the contract, in its order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: ``id_col``, the measures, base_failed and kept.

    Lines count as equal when all their code points are; a null text is an
    empty one (all counts zero, rejected for its few words); a null id stays
    null; repeated rows each get a row; an empty table gives an empty one;
    other columns, of any name, are ignored.
    """
    rules = RULES if rules is None else rules
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)]
                          + [T.StructField(c, T.LongType()) for c in MEASURES]
                          + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in _pieces(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                rejected = cascade.verdict(m) is not None
                failed = any(rule(m) for _, rule in BASE_RULES)
                rows.append([getattr(m, c) for c in MEASURES] + [failed, not (failed or rejected)])
            columns = list(zip(*rows)) or [[]] * (len(MEASURES) + 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.int64()) for c in columns[:-2]]
                + [pa.array(c, pa.bool_()) for c in columns[-2:]], [id_col, *MEASURES, "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(judge, schema)


#: DuckDB SQL for :func:`quality_verdicts` over the given table (ids there are unique).
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] || ' ' || w[p + 5] AS five
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
    coalesce(list_sum(list_transform(w, lambda x: strlen(x))), 0) AS n_bytes,
    coalesce(list_sum(list_transform(w, lambda x: strlen(regexp_replace(x, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')))), 0) AS n_letters
    FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_words OR n_letters < 0.5 * n_bytes) AS kept
FROM b
"""
