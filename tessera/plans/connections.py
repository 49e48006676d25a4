"""Shortest connections between two entities, searched from both ends.

Each end has a table of visited names with their distance and a frontier; the smaller
frontier is expanded by one join with the edges, and names visited before are left out.
The search ends once the two sides meet, after ``most`` edges, or when a frontier is
empty. The connections are then followed back from where the sides met, level by level,
so the result is the edges that lie on any shortest connection, by step, not a list of
all combinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MOST = 6


def _level(names: DataFrame, depth: int) -> DataFrame:
    return written(names.select("name").distinct().withColumn("depth", F.lit(depth)), "visited")


def shortest(edges: DataFrame, start: str, goal: str, most: int = MOST, directed: bool = False) -> DataFrame:
    """(step, from_name, predicate, to_name, forward): the edges on shortest connections of at most ``most``.

    ``forward`` is false where an edge is followed against its direction, as happens
    unless ``directed``. No connection, or equal names, give no rows.
    """
    base = edges.select(F.col("subj_name").alias("from_name"), "predicate", F.col("obj_name").alias("to_name")).filter("from_name != to_name").distinct().withColumn("forward", F.lit(True))
    if not directed:
        base = base.unionByName(base.select(F.col("to_name").alias("from_name"), "predicate", F.col("from_name").alias("to_name"), F.lit(False).alias("forward")))
    base = written(base, "edges")
    links = base.select("from_name", "to_name").distinct()
    spark = edges.sparkSession
    near, far = ([_level(spark.createDataFrame([(name,)], "name string"), 0)] for name in (start, goal))
    none = base.limit(0).select(F.lit(0).alias("step"), "from_name", "predicate", "to_name", "forward")
    if start == goal:
        return none
    sizes = [1, 1]
    while True:
        if not all(sizes) or len(near) + len(far) - 2 >= most:
            return none
        ahead = sizes[0] <= sizes[1]
        side, (own, other) = (near, ("from_name", "to_name")) if ahead else (far, ("to_name", "from_name"))
        visited = side[0]
        for level in side[1:]:
            visited = visited.unionByName(level)
        step = links.join(side[-1].select(F.col("name").alias(own)), own).select(F.col(other).alias("name"))
        side.append(_level(step.join(visited, "name", "left_anti"), len(side)))
        sizes[0 if ahead else 1] = side[-1].count()
        met = written(near[-1].select("name").join(far[-1].select("name"), "name"), "met")
        if met.limit(1).count():
            break
    found, marks = [], met
    for depth in range(len(near) - 1, 0, -1):
        back = base.join(marks.select(F.col("name").alias("to_name")), "to_name").join(near[depth - 1].select(F.col("name").alias("from_name")), "from_name")
        found.append(written(back.select(F.lit(depth).alias("step"), "from_name", "predicate", "to_name", "forward"), "steps"))
        marks = found[-1].select(F.col("from_name").alias("name")).distinct()
    marks = met
    for depth in range(len(far) - 1, 0, -1):
        on = base.join(marks.select(F.col("name").alias("from_name")), "from_name").join(far[depth - 1].select(F.col("name").alias("to_name")), "to_name")
        found.append(written(on.select(F.lit(len(near) + len(far) - 1 - depth).alias("step"), "from_name", "predicate", "to_name", "forward"), "steps"))
        marks = found[-1].select(F.col("to_name").alias("name")).distinct()
    out = none
    for rows in found:
        out = out.unionByName(rows)
    return out
