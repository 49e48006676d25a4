"""Connected components by alternating star contraction, on DataFrames.

Every step is a join on an aggregate with map-side combine; between steps the
edges are a table in the shared folder, so lineage stays short and a lost executor
costs one step. Edges that change nothing are dropped, so tables only shrink. What the
driver holds of a step's shuffles is let go before the next, however many steps there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import erase, release, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first())


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component) for every node on an edge (a, b), as a written table; component is the least node.

    Large star: each node hands its least neighbour to its larger neighbours.
    Small star: each node links itself and its smaller neighbours to the least.
    At the fixed point every node links to its component's least node.
    """
    stars = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = _state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, stars = stars, written(moved.unionByName(low.withColumnRenamed("m", "b")).distinct(), name, rows=2 * before[0])
        erase(last)
        del last, both, least, large, low, moved
        release(edges.sparkSession)
        now = _state(stars)
        if now == before:
            break
        before = now
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found = written(out, f"{name}-components", rows=2 * before[0])
    erase(stars)
    return found
