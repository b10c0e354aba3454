"""Connected components of an edge table, by alternating stars (union by smallest id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import staged


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and order-free hash sum: equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every id with an edge, root being the smallest id of its component.

    Each round links every neighbour above an id to that id's smallest
    neighbour, then every id's smaller neighbours to the smallest one. Groups
    are reduced by `min` before the shuffle and joined back, so an id with very
    many edges is never gathered in one task. Self edges, repeated edges and
    null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = staged(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    seen = _fingerprint(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        e = staged(below.distinct(), "edges")
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
