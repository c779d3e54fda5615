"""Line dedup: drop the lines that many documents share.

Every document is split at ``\\n``; lines are normalised, hashed and exploded
to (document, position, hash). Distinct documents are counted for each hash,
and a line whose hash reaches the threshold is dropped everywhere but in the
document with the largest id. Documents are put together again from the
positions that stay. Only DataFrame functions run.

Scale: hashes and positions are shuffled, never line texts. The count is
pre-aggregated in two steps (distinct (document, hash), then hash), so a line
of a third of all documents is summed on the map side; the join back to the
hot hash is an ordinary equi-join that AQE splits. Whole texts move once, in
the last join on the document id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import ASCII_SPACE, ascii_lower, free_name, materialise


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 20, min_docs: int = 3, out_col: str = "line_dedup") -> DataFrame:
    """``docs`` with ``text_col`` deduplicated and a struct ``out_col`` (n_lines, n_dropped).

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of ``min_chars`` code points or more found in at least
    ``min_docs`` documents lose all lines but those of the largest id.

    Defined cases: a null text counts as empty and comes out as '' (one empty
    line); rows with one id are one document for the count, and each row comes
    out again; rows with a null id are together one document that is never the
    keeper; a document whose lines all go has the text ''; an empty table
    gives an empty table; an input column named ``out_col`` is replaced, all
    other columns pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    ).withColumn("line", F.btrim("line", F.lit(ASCII_SPACE)))
    key = ascii_lower(F.col("line"))
    # 128 bits: two XXH64 with different seeds.
    keys = lines.where(F.char_length("line") >= min_chars).select(
        "id", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))

    frequent = (
        keys.select("id", "h1", "h2").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    )
    # Written, so that its size is known: it is broadcast where it is small, and
    # else both sides of the join are shuffled for it and a hot hash is split.
    frequent = materialise(frequent, "line-dedup-frequent")
    body = docs.drop(out_col)
    whose, version, gone = (free_name(body, c) for c in ("__id", "__version", "__dropped"))
    dropped = (
        keys.join(frequent, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias(whose), F.col("version").alias(version))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = body.join(
        dropped, F.col(id_col).eqNullSafe(F.col(whose)) & (F.xxhash64(text) == F.col(version)), "left")
    parts = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"))
    n_dropped = F.coalesce(F.size(gone), F.lit(0))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in body.columns],
        F.struct(F.size(parts).cast("long").alias("n_lines"),
                 F.when(F.col(gone).isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"),
                 ).alias(out_col),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document (contract of op8)."""
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
        F.sha2(F.col("text"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
