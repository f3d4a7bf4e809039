"""Connected components of links between documents, by joins alone.

Alternating star contraction: every node's neighbours are linked to its
smallest one, larger ones first, then smaller ones, until each component is a
star around its smallest node. Rounds grow with the logarithm of a component's
size, not its diameter. Neighbours are never gathered: minima are aggregated
(with partial sums in the map tasks) and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b. Large: both ways, larger neighbours to the minimum; small: the rest."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = joined.unionByName(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``doc, root`` for every document in ``links`` (``a, b``) but the roots themselves.

    ``root`` is the smallest document reachable. Links of a document to itself
    and repeated links do no harm; no links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _print(edges)
    while seen[0]:
        done = cut(_star(_star(edges, True), False))
        now = _print(done)
        release(edges)
        edges = done
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("root"))
