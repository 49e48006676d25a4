import itertools
import random
from collections import defaultdict

import pytest

from tessera.plans import connections, reasoning

EDGES = "subj_name string, predicate string, obj_name string"


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    """Random edges with cycles, and a chain of twenty."""
    r = random.Random(seed)
    pairs = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(14)} | {(f"c{i}", f"c{i + 1}") for i in range(20)}
    want = set(pairs)
    while True:
        more = {(a, d) for a, b in want for c, d in pairs if b == c} - want
        if not more:
            break
        want |= more
    rows = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "from_name string, to_name string")
    assert {tuple(x) for x in reasoning.closure(rows.unionByName(rows)).collect()} == want
    assert reasoning.closure(rows.limit(0)).count() == 0


def test_entailed(spark):
    rows = [("wheel", "isPartOf", "car"), ("car", "isPartOf", "fleet"), ("cat", "broader", "animal"), ("animal", "narrower", "dog"), ("a", "relatedTo", "b"), ("x", "uses", "y")]
    got = {tuple(r) for r in reasoning.entailed(spark.createDataFrame(rows * 2, EDGES)).collect()}
    part, broader = {("wheel", "car"), ("car", "fleet"), ("wheel", "fleet")}, {("cat", "animal"), ("dog", "animal")}
    want = set(rows) | {(a, "dcterms:isPartOf", b) for a, b in part} | {(b, "dcterms:hasPart", a) for a, b in part}
    want |= {(a, p, b) for a, b in broader for p in ("skos:broader", "skos:broaderTransitive")} | {(b, "skos:narrower", a) for a, b in broader}
    want |= {("a", "skos:related", "b"), ("b", "skos:related", "a")}
    assert got == want


def brute(rows, start, goal, directed):
    steps = [(a, p, b, True) for a, p, b in set(rows) if a != b] + ([] if directed else [(b, p, a, False) for a, p, b in set(rows) if a != b])
    out = defaultdict(set)
    for a, _, b, _ in steps:
        out[a].add(b)

    def distances(source, step):
        known, front = {source: 0}, [source]
        for d in itertools.count(1):
            front = [x for x in {y for f in front for y in step[f]} if x not in known]
            if not front:
                return known
            known |= dict.fromkeys(front, d)

    back = defaultdict(set)
    for a, targets in list(out.items()):
        for b in targets:
            back[b].add(a)
    near, far = distances(start, out), distances(goal, back)
    if goal not in near or near[goal] > 6 or start == goal:
        return set()
    return {(near[a] + 1, a, p, b, f) for a, p, b, f in steps if a in near and b in far and near[a] + 1 + far[b] == near[goal]}


@pytest.mark.parametrize(("seed", "directed"), [(1, False), (2, True), (3, False), (4, True)])
def test_shortest_connections(spark, seed, directed):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(14)}", r.choice(["uses", "has"]), f"n{r.randrange(14)}") for _ in range(22)]
    df = spark.createDataFrame(rows, EDGES)
    for start, goal in (("n0", "n1"), ("n3", "n7")):
        assert {tuple(x) for x in connections.shortest(df, start, goal, directed=directed).collect()} == brute(rows, start, goal, directed)


def test_no_connection(spark):
    chain = spark.createDataFrame([(f"n{i}", "uses", f"n{i + 1}") for i in range(8)], EDGES)
    assert connections.shortest(chain, "n0", "n7").count() == 0  # longer than the bound
    assert connections.shortest(chain, "n0", "n6").count() == 6
    assert connections.shortest(chain, "n0", "n0").count() == connections.shortest(chain, "n0", "other").count() == 0
    assert connections.shortest(chain, "n5", "n2", directed=True).count() == 0
