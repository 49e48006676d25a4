"""What one task holds does not grow with the tables: rows are dealt to a number of tasks that does."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import registry, star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(star, "TASK_ROWS", 500)


def most(df):
    """Rows of the partition that has the most."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_facts_are_dealt_by_their_number(spark, small):
    facts = star.Star(spark, FOLDER).facts()
    assert most(facts) < 1000 < facts.count() / 4


def test_facts_of_large_dimensions(spark, small, monkeypatch):
    """Dimensions and names too many to broadcast are shuffled; the facts are the same."""
    t = star.Star(spark, FOLDER)
    few = sorted(t.facts().select("triple_id", "subj_name", "obj_name").collect())
    monkeypatch.setattr(star, "BROADCAST_ROWS", 5)
    assert sorted(t.facts().select("triple_id", "subj_name", "obj_name").collect()) == few


def test_names_are_judged_by_few_patterns(spark):
    from tessera.functions.entities import is_valid_entity, normalize_predicate

    plan = spark.range(1).select(F.col("id").cast("string").alias("n")).select(is_valid_entity(F.col("n")).alias("v"), normalize_predicate(F.col("n")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2
    assert "lambda" not in plan


def test_answers_to_one_message_stay_apart(spark):
    """Two lines about one message, the same or not, are two answers."""
    import json

    from tessera.operators import batches

    def line(*objects):
        text = json.dumps([{"subject": "flask", "predicate": "uses", "object": o} for o in objects])
        return (json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}, "metadata": {"message_id": "m", "session_id": "s", "source_file": "f"}}),)

    lines = spark.createDataFrame([line("werkzeug"), line("werkzeug"), line("jinja", "werkzeug")], "value string")
    assert sorted(len(r.facts) for r in batches.read_answers(lines).collect()) == [1, 1, 2]
    assert [tuple(r) for r in batches.by_source(batches.read_answers(lines)).collect()] == [("f", 3, 4)]


def test_files_and_archives_are_dealt_by_their_rows(spark, monkeypatch):
    from tessera.plans import source_queries

    t = star.Star(spark, FOLDER)
    monkeypatch.setattr(source_queries, "EVENTS", 50)
    monkeypatch.setattr(source_queries, "TURNS", 5)
    assert source_queries._tool_files(t).rdd.getNumPartitions() == -(-t.table("events").count() // 50)
    assert source_queries._zips(t, source_queries._tree).rdd.getNumPartitions() == max(4, -(-t.table("conversations").count() // 5))


@pytest.mark.parametrize("name", ["s15_sparql_hubs", "s17_sparql_platform_lists"])
def test_patterns_of_one_subject_are_joined_where_they_lie(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(" in plan
    assert "Exchange hashpartitioning(fact" not in plan


def test_parts_stored_by_subject(spark, tmp_path):
    """Stored parts are the terms of their long rows, each bucket of a predicate in one file."""
    from pathlib import Path

    from tessera.plans import graph_model
    from tessera.plans.sparql import encoded, predicates, resource, spelt, stored_parts

    facts = star.Star(spark, FOLDER).facts()
    parts = lambda named=None: [(r, resource(s), lambda d, spell=spell: spelt(spell(d))) for r, s, spell in graph_model.fact_row_parts(facts, named)]
    want = encoded(graph_model.fact_rows(facts))
    kept = stored_parts(parts(), str(tmp_path / "all"), 3)
    assert kept.triples.exceptAll(want).count() == want.exceptAll(kept.triples).count() == 0
    assert max(len(list(p.glob("*.parquet"))) for p in Path(tmp_path / "all").iterdir() if p.name.startswith("p=")) <= 6
    named = predicates("PREFIX kg: <http://tessera.local/terms#> SELECT ?f WHERE { { ?f kg:tripleSubject ?e } UNION { ?f kg:tripleObject ?e OPTIONAL { ?e a kg:Entity } } }")
    some = stored_parts(parts(named), str(tmp_path / "some"), 3).triples
    asked = want.filter(F.col("p").isin(*[f"<{p}>" for p in named]))
    assert len(named) == 3 and asked.count() and some.exceptAll(asked).count() == asked.exceptAll(some).count() == 0
    assert predicates("SELECT ?s WHERE { ?s ?p ?o }") is None
