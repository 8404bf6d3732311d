"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the exchange) and a join, so a hub with a third of all edges is never
gathered. Each round is stored in the shared folder; a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm.common import small


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with a > b. Large: neighbours above a node move to its least neighbour; small: those below do."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    moved = both.join(small(least), "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return staged(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge reaches. Loops and NULL ends are ignored.

    An empty table gives no rows; repeated edges count once.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = staged(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        e = _star(_star(e, True), False)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return staged(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
