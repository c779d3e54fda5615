"""Benchmark decontamination: spaced-seed hashing with verified overlaps.

A seed is a window of twelve tokens of which a fixed mask ignores some, so a
substituted word under an ignored position leaves the hash as it is. The
hashes of all training windows are joined with those of the benchmark; each
hit fixes an alignment, at which the whole item is compared position by
position. Three masks together find nearly every 16-token passage with three
substitutions. Only DataFrame functions run.

Scale: documents are scanned in one codegen stage (split, explode positions,
hash, probe a broadcast table) and only hits leave it. Those of items of up to
``WHOLE`` tokens bring the aligned tokens along, so no text is shuffled; for
longer items, whose many hits would repeat them, the distinct alignments are
joined with their documents. The broadcast table holds the seeds
of a block of at most ``BLOCK_SEEDS`` benchmark windows (its size is counted
first); a larger benchmark is handled in further blocks, each with a scan of
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import free_name, materialise

SPAN = 12
#: Token positions of a window that each mask keeps; chosen by a search for the
#: best joint sensitivity on 16 to 30 tokens with 3 to 6 substitutions.
MASKS = ((0, 2, 5, 6, 9, 11), (0, 1, 3, 8, 9, 11), (0, 1, 4, 5, 7, 11))
#: Benchmark seeds broadcast at once: about 32 bytes each.
BLOCK_SEEDS = 1_000_000
#: Tiles of an item and their margin in the SQL.
TILE, MARGIN = 64, 32
#: Tokens of the longest item whose hits bring the aligned tokens along.
WHOLE = 128
#: Matching tokens that make an overlap.
MIN_MATCH = 12
#: What a substituted token takes from the score; runs with fewer than two
#: matches for each substitution end.
MISMATCH = 2


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1)


def _seeds(words: Column, at: Column) -> Column:
    """The hash of each mask for the window that starts at ``at`` (from 0)."""
    return F.array(*[F.xxhash64(F.lit(k), *[words[at + F.lit(o)] for o in mask]) for k, mask in enumerate(MASKS)])


def _windows(df: DataFrame) -> DataFrame:
    """A row for each window and mask: the columns of ``df``, ``pos`` and ``seed``."""
    return (
        df.where(F.size("words") >= SPAN)
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("words") - SPAN)))
        .withColumn("seed", F.explode(_seeds(F.col("words"), F.col("pos"))))
    )


def best_run(same: str) -> Column:
    """Most matches in a run of the array ``same`` (of 0 and 1) whose score never falls below zero."""
    return F.expr(f"""aggregate({same}, named_struct('score', 0, 'run', 0, 'best', 0),
      (a, x) -> named_struct(
        'score', greatest(a.score + if(x = 1, 1, -{MISMATCH}), 0),
        'run', if(a.score + if(x = 1, 1, -{MISMATCH}) < 0, 0, a.run + x),
        'best', greatest(a.best, if(a.score + if(x = 1, 1, -{MISMATCH}) < 0, 0, a.run + x))),
      a -> a.best)""")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
             block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """Rows (``id_col``, ``item_col``, n_matched, n_item_tokens) of documents that hold a passage of an item.

    ``n_matched`` is the most tokens of the item found in one run at one
    alignment, substitutions not counted; pairs below ``min_match`` are left
    out. Tokens are lower-cased runs of letters and digits.

    Defined cases: null and empty texts match nothing; items and documents
    under twelve tokens cannot be told from chance and match nothing; repeated
    rows and repeated items give one row for each id pair, with the largest
    count; null ids are kept as ids; empty tables give an empty table; other
    columns are ignored, whatever their names.
    """
    items = (
        benchmark.select(F.col(item_col).alias("item"), F.array_remove(tokens(F.col(item_text_col)), "").alias("words"))
        .where(F.size("words") >= SPAN).distinct()
        .withColumn("item_key", F.xxhash64("item", "words"))
    )
    n_seeds, longest = items.agg(F.sum(F.size("words").cast("long") - SPAN + 1), F.max(F.size("words"))).first()
    n_blocks = max(1, -(-(n_seeds or 0) * len(MASKS) // block_seeds))
    seeds = _windows(items).select("seed", "item_key", F.col("pos").alias("item_pos"), F.size("words").alias("n_item"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    long_items = (longest or 0) > WHOLE
    train = _windows(texts.select("id", *[version.alias("version")] * long_items, tokens(F.col("text")).alias("words")))

    where = ["id", "item_key", "shift", "low"]
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.col("n_item"), F.size("words") - F.col("shift"))
    # The document's tokens at the item's positions from ``low`` on.
    part = F.array_join(F.slice("words", F.col("low") + F.col("shift") + 1, high - F.col("low")), " ")
    short = F.col("n_item") <= WHOLE
    found = None
    for b in range(n_blocks):
        block = seeds.where(F.pmod(F.xxhash64("seed", "item_key", "item_pos"), F.lit(n_blocks)) == b)
        hits = (
            train.join(F.broadcast(block), "seed")
            .withColumn("shift", F.col("pos") - F.col("item_pos")).withColumn("low", low)
        )
        if long_items:
            hits = hits.select(*where, F.when(short, part).alias("part"), "n_item", F.when(~short, F.col("version")).alias("version"))
        else:
            hits = hits.select(*where, part.alias("part"))
        found = hits if found is None else found.unionByName(hits)
    found = found.distinct()
    if long_items:
        found = materialise(found, "overlap-alignments")
        rest = found.where("part is null").select(F.col("id").alias("d"), "version", "item_key", "shift", "low", "n_item")
        rest = (
            texts.withColumn("v", version)
            .join(rest, F.col("id").eqNullSafe(F.col("d")) & (F.col("v") == F.col("version")))
            .withColumn("words", tokens(F.col("text")))
        )
        found = found.where("part is not null").select(*where, "part").unionByName(rest.select(*where, part.alias("part")))

    return (
        found.join(items, "item_key")
        .withColumn("same", F.expr(
            "zip_with(split(part, ' ', -1), slice(words, low + 1, size(split(part, ' ', -1))), (a, b) -> if(a = b, 1, 0))"))
        .select("id", "item", best_run("same").alias("n"), F.size("words").alias("n_item"))
        .where(F.col("n") >= min_match)
        .groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col))
        .agg(F.max("n").cast("long").alias("n_matched"), F.max("n_item").cast("long").alias("n_item_tokens"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id has no overlap with the benchmark, with all their columns."""
    name = free_name(docs, "__bad")
    bad = overlaps(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def _sql() -> str:
    """DuckDB SQL for :func:`overlaps` over the given tables (ids there are unique)."""
    keys = ", ".join(
        "'" + str(k) + "' || ' ' || " + " || ' ' || ".join(f"words[p + {o + 1}]" for o in mask)
        for k, mask in enumerate(MASKS))
    split = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+')"
    return f"""
WITH d AS (SELECT doc_id, {split} AS words FROM documents),
b AS (SELECT item_id, list_filter({split}, lambda w: w <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, words, unnest(range(0, len(words) - {SPAN - 1})) AS p FROM d WHERE len(words) >= {SPAN}),
bw AS (SELECT item_id, words, unnest(range(0, len(words) - {SPAN - 1})) AS p FROM b WHERE len(words) >= {SPAN}),
ds AS (SELECT doc_id, p, unnest([{keys}]) AS seed FROM dw),
bs AS (SELECT item_id, p, unnest([{keys}]) AS seed FROM bw),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS shift, bs.p // {TILE} AS tile FROM ds JOIN bs USING (seed)),
a AS (SELECT doc_id, item_id, shift, tile, d.words AS dws, b.words AS bws,
        unnest(range(greatest(0, tile * {TILE} - {MARGIN}, -shift),
                     least(len(b.words), (tile + 1) * {TILE} + {MARGIN}, len(d.words) - shift))) AS q
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (SELECT doc_id, item_id, shift, tile, q, len(bws) AS n_item,
        CASE WHEN dws[q + shift + 1] = bws[q + 1] THEN 1 ELSE 0 END AS x FROM a),
s AS (SELECT *, sum(CASE WHEN x = 1 THEN 1 ELSE -{MISMATCH} END)
        OVER (PARTITION BY doc_id, item_id, shift, tile ORDER BY q) AS total FROM m),
l AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift, tile ORDER BY q
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM s),
g AS (SELECT *, sum(CASE WHEN total < lowest THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, item_id, shift, tile ORDER BY q) AS run FROM l),
r AS (SELECT doc_id, item_id, max(n_item) AS n_item, sum(x) AS n FROM g GROUP BY doc_id, item_id, shift, tile, run)
SELECT doc_id, item_id, max(n)::BIGINT AS n_matched, max(n_item)::BIGINT AS n_item_tokens
FROM r GROUP BY doc_id, item_id HAVING max(n) >= {MIN_MATCH}
"""


DECONTAMINATION_SQL = _sql()
