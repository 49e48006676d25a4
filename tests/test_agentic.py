import json

import pytest

from tessera.operators import agentic, linking
from tessera.streaming.store import Store

#: name: (context, queries in order, the item or none)
CASES = {
    "python": ("dedicated backend service builtWith Go, Node.js, Python", ["python"], "Q28865"),
    "backend": ("dedicated backend service deployedOn container", ["backend", "back end"], "Q1"),
    "agent": ("agent SDK for building autonomous agents", ["agent", "software agent"], "Q2"),
    "apis": ("apis enable data consumption from external services", ["apis", "application programming interface"], "Q3"),
    "neo4j": ("graph database for knowledge graph storage", ["neo4j"], "Q4"),
    "k8s": ("k8s orchestrates container deployments across clusters", ["k8s", "kubernetes"], "Q5"),
    "js": ("frontend built with js and react framework", ["js", "javascript"], "Q6"),
    "made up": ("nothing", ["made up", "made", "up"], None),
}


def searching(broken=()):
    cases = CASES

    def provider():
        def find(query):
            if query in broken:
                raise TimeoutError
            for _, queries, qid in cases.values():
                if query == queries[-1] and qid:
                    return [{"id": "Q9", "label": "a snake", "description": "animal"}, {"id": qid, "label": query, "description": "software"}]
            return [{"id": "Q9", "label": "a snake", "description": "animal"}]

        return find

    return provider


def judging(change=lambda name, answer: answer):
    cases = CASES

    class Judge:
        def generate(self, prompt):
            name = prompt.split("Name: ")[1].split("\n")[0]
            context, queries, qid = cases[name]
            assert f"Context: {context}" in prompt
            searched = prompt.split("Searched so far: ")[1].split("\n")[0].split(", ")
            assert searched == queries[: len(searched)]
            if qid and f"- {qid}: " in prompt:
                answer = {"qid": qid, "confidence": 0.95, "label": name, "description": "software", "reasoning": "fits"}
            elif len(searched) < len(queries):
                assert "another search" in prompt
                answer = {"qid": "none", "confidence": 0, "search": queries[len(searched)], "reasoning": "try on"}
            else:
                answer = {"qid": "none", "confidence": 0.0, "label": name, "description": "", "reasoning": "no item"}
            return change(name, "Here: " + json.dumps(answer))

    return Judge


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(n, c) for n, (c, _, _) in CASES.items()], "label string, context string").repartition(3)


def test_hand_cases(spark, tmp_path, names):
    store = Store(spark, str(tmp_path))
    got = {r.label: (r.qid, r.searches, r.failed) for r in agentic.link_into(store, names, 0, searching(), judging()).collect()}
    assert got == {n: (qid, len(queries), False) for n, (_, queries, qid) in CASES.items()}
    links, _ = linking.cached_links(store, names.select("label"))
    assert {r.label: r.qid for r in links.collect()} == {n: q for n, (_, _, q) in CASES.items() if q}
    assert [store.count(f"round_{n}") for n in (1, 2, 3)] == [8, 6, 1]

    def forbidden():
        raise AssertionError("asked again")

    assert agentic.link_into(store, names, 1, lambda: lambda q: forbidden(), forbidden).count() == 0


def test_only_items_found_count(spark, tmp_path, names):
    guess = judging(lambda name, answer: json.dumps({"qid": "Q777", "confidence": 1.0, "label": name, "description": "", "reasoning": "from memory"}))
    rows = agentic.link_by_rounds(Store(spark, str(tmp_path)), names, 0, searching(), guess).collect()
    assert {(r.qid, r.confidence, r.failed) for r in rows} == {(None, 0.0, False)}


def test_failures_are_null_and_come_again(spark, tmp_path, names):
    """A judge without a readable answer and a search that fails leave their names alone unknown."""
    store = Store(spark, str(tmp_path))
    odd = judging(lambda name, answer: "I'd say snakes." if name == "js" else answer)
    got = {r.label: (r.qid, r.failed) for r in agentic.link_into(store, names, 0, searching(["neo4j"]), odd).collect()}
    assert got["js"] == got["neo4j"] == (None, True) and sum(f for _, f in got.values()) == 2
    assert store.count("link_cache") == 6
    again = {r.label: r.qid for r in agentic.link_into(store, names, 1, searching(), judging()).collect()}
    assert again == {"js": "Q6", "neo4j": "Q4"}


@pytest.mark.parametrize(
    ("raw", "last", "want"),
    [
        ('{"qid": "Q1", "confidence": 2}', False, ("Q1", 1.0, "", "", "", None)),
        ('{"qid": "Q1", "search": "more"}', False, (None, 0.0, "", "", "", "more")),
        ('{"qid": "Q1", "search": "more"}', True, ("Q1", 0.0, "", "", "", None)),
        ('{"qid": "ERROR"}', True, (None, 0.0, "", "", "", None)),
        ('{"qid": 5, "confidence": null}', True, (None, 0.0, "", "", "", None)),
        ('{"qid": "Q1", "confidence": "high"}', True, None),
        ("no object", True, None),
        ("[1]", True, None),
    ],
)
def test_reading_answers(raw, last, want):
    assert agentic.verdict(raw, {"Q1"}, last) == want


