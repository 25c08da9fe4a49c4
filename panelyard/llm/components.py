"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge seen from u, with the least of u and its neighbours; a node with very many
    neighbours is combined on the map side and then joined, a side that adaptive execution can split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of *edges* (two columns a and b of one sortable type); root is its
    component's least node.  Loops and repeated edges do no harm; null ends are ignored.

    Both steps of a round replace each edge by one towards a smaller node and never join components, so the
    rows never grow; after O(log n) rounds every component is a star.  Each round is cut off as a written table.
    """
    now = C.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_minimum(both).where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _to_minimum(down)
        small = small.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        now = C.materialize(small)
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == state or not said[0]:
            break
        state = said
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
