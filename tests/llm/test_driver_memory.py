"""What the driver holds does not grow with the steps of an operator."""

import gc

from pyspark.sql import functions as F

from tessera.llm import components


def test_finished_rounds_are_let_go(spark, monkeypatch):
    """A path takes several rounds of contraction; the driver lets go of each before the next."""
    states, released, state, collect = [], [], components._state, gc.collect
    monkeypatch.setattr(components, "_state", lambda edges: states.append(len(released)) or state(edges))
    monkeypatch.setattr(gc, "collect", lambda *a: released.append(1) or collect(*a))
    path = spark.range(20).select((F.col("id") * 8 % 21).alias("a"), ((F.col("id") + 1) * 8 % 21).alias("b"))
    assert components.components(path).select("component").distinct().count() == 1
    assert len(states) > 3
    assert states == list(range(len(states)))
