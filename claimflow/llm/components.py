"""Connected components of a large edge list, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node it can reach.

    Alternating large-star and small-star steps: each step joins a node's
    neighbours to the smallest of them, so a path of length n is flat after
    about log n rounds. The smallest neighbour is an ordinary (partially
    aggregated) minimum and is joined back, so the neighbours of a hot node
    are never gathered; every round's edges are written to the shared folder.
    """
    flat = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        large = _star(flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        flat = materialise(_star(large, large=False), "edges")
        # Both steps leave a forest of stars unchanged, and nothing else.
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of the node and them.

    ``large``: ``links`` has each edge in both directions and the neighbours
    above the node are linked; else u > v in each row and the neighbours are
    those below, the node included.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = links.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()
