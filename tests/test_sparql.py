"""The SPARQL subset against plain expectations and against the named questions."""

import pytest

from tessera.functions.identifiers import CATALOGUE, DATA, TERM
from tessera.plans import graph_model, graph_queries
from tessera.plans.sparql import Compiler, Parser, SparqlError, encoded, sparql, stored

PREFIXES = f"""PREFIX kg: <{TERM}>
PREFIX data: <{DATA}>
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
PREFIX dc: <http://purl.org/dc/terms/>
PREFIX owl: <http://www.w3.org/2002/07/owl#>
"""
SAME = "http://www.w3.org/2002/07/owl#sameAs"
FACTS = [("a", "uses", "b", "m1", "s1"), ("a", "uses", "b", "m2", "s2"), ("b", "uses", "a", "m2", "s2"), ("a", "isPartOf", "a", "m1", "s1"), ("c d", "uses", "b", "m3", "s3")]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(s, s.replace(" ", "-"), p, o, o.replace(" ", "-"), f"t{i}", m, n, f"content of {m}") for i, (s, p, o, m, n) in enumerate(FACTS)]
    return spark.createDataFrame(rows, "subj_name string, subj string, predicate string, obj_name string, obj string, triple_id string, message_id string, session string, content string")


@pytest.fixture(scope="module")
def triples(spark, facts):
    iri, lit = "iri", "literal"
    extra = [
        (f"{DATA}session/s1", graph_model.RDF_TYPE, f"{TERM}Session", iri, None, None), (f"{DATA}session/s2", graph_model.RDF_TYPE, f"{TERM}Session", iri, None, None),
        (f"{DATA}session/s3", graph_model.RDF_TYPE, f"{TERM}Session", iri, None, None), (f"{DATA}session/s1", f"{TERM}hasSourcePlatform", "grok", lit, None, None),
        (f"{DATA}session/s2", f"{TERM}hasSourcePlatform", "warp", lit, None, None), (f"{DATA}session/s1", graph_model.CREATED, "2025-01-02T00:00:00Z", lit, graph_model.DATE_TIME, None),
        (f"{DATA}session/s2", graph_model.CREATED, "2025-01-01T00:00:00Z", lit, graph_model.DATE_TIME, None), (f"{DATA}message/m1", graph_model.CONTENT, 'content of "m1"', lit, None, None),
        (f"{DATA}entity/a", graph_model.LABEL, "a", lit, None, "en"), (f"{DATA}entity/a", SAME, f"{CATALOGUE}Q1", iri, None, None), (f"{DATA}entity/b", SAME, f"{DATA}entity/a", iri, None, None),
    ]
    more = spark.createDataFrame(extra, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    return encoded(graph_model.fact_rows(facts).unionByName(more, allowMissingColumns=True)).cache()


def ask(triples, text, services=None):
    return [tuple(r) for r in sparql(triples, PREFIXES + text, services).collect()]


def test_optional_and_order(triples):
    got = ask(triples, "SELECT ?s ?p ?c WHERE { ?s a kg:Session . OPTIONAL { ?s kg:hasSourcePlatform ?p } OPTIONAL { ?s dc:created ?c } } ORDER BY ?c")
    assert got == [(f"{DATA}session/s3", None, None), (f"{DATA}session/s2", "warp", "2025-01-01T00:00:00Z"), (f"{DATA}session/s1", "grok", "2025-01-02T00:00:00Z")]


def test_count_group_order(triples):
    assert ask(triples, "SELECT ?p (COUNT(?s) AS ?n) WHERE { ?s a kg:Session ; kg:hasSourcePlatform ?p . } GROUP BY ?p ORDER BY DESC(?n)") == [("grok", 1), ("warp", 1)]
    assert ask(triples, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }") == [(triples.count(),)]
    assert ask(triples, "SELECT (COUNT(*) AS ?n) WHERE { ?s a kg:Nothing }") == [(0,)]


def test_language_tags_tell_literals_apart(triples, facts):
    plain = "SELECT ?l (COUNT(DISTINCT ?t) AS ?n) WHERE { { ?t a kg:KnowledgeTriple ; kg:tripleSubject ?e . ?e rdfs:label ?l . FILTER(LANG(?l) = \"\") } UNION { ?t a kg:KnowledgeTriple ; kg:tripleObject ?e . ?e rdfs:label ?l . FILTER(LANG(?l) = \"\") } } GROUP BY ?l ORDER BY DESC(?n) ?l LIMIT 20"
    assert ask(triples, plain) == [tuple(r) for r in graph_queries.hubs(facts).collect()]
    assert len(ask(triples, "SELECT ?l WHERE { data:x rdfs:label ?l }")) == 0
    assert sorted(ask(triples, f"SELECT ?l WHERE {{ <{DATA}entity/a> rdfs:label ?l }}")) == [("a",), ("a",)]
    assert ask(triples, 'SELECT ?e WHERE { ?e rdfs:label "a"@en }') == [(f"{DATA}entity/a",)]


def test_relations_with_provenance(triples):
    text = """SELECT ?p ?ol ?snip WHERE {
      ?t a kg:KnowledgeTriple ; kg:tripleSubject ?s ; kg:triplePredicateLabel ?p ; kg:tripleObject ?o ; kg:extractedFrom ?m .
      ?s rdfs:label ?sl . ?o rdfs:label ?ol .
      OPTIONAL { ?m <http://rdfs.org/sioc/ns#content> ?c . BIND(SUBSTR(?c, 1, 7) AS ?snip) }
      FILTER(LCASE(?sl) = "a" && LANG(?sl) = "" && LANG(?ol) = "") } ORDER BY ?p ?snip"""
    assert ask(triples, text) == [("isPartOf", "a", "content"), ("uses", "b", None), ("uses", "b", "content")]


def test_cooccurrence(triples, facts):
    text = """SELECT ?l1 ?l2 (COUNT(DISTINCT ?t) AS ?n) WHERE { ?t a kg:KnowledgeTriple ; kg:tripleSubject ?x ; kg:tripleObject ?y . ?x rdfs:label ?l1 . ?y rdfs:label ?l2 .
      FILTER(?x != ?y) FILTER(LANG(?l1) = "" && LANG(?l2) = "") } GROUP BY ?l1 ?l2 ORDER BY DESC(?n) LIMIT 20"""
    assert ask(triples, text) == [tuple(r) for r in graph_queries.cooccurrence(facts).collect()]


def test_having_and_group_concat(triples):
    text = """SELECT ?l (GROUP_CONCAT(DISTINCT ?p; separator=", ") AS ?ps) (COUNT(DISTINCT ?p) AS ?n) WHERE { ?t a kg:KnowledgeTriple ; kg:tripleSubject ?e ; kg:extractedInSession ?s .
      ?s kg:hasSourcePlatform ?p . ?e rdfs:label ?l FILTER(LANG(?l) = "") } GROUP BY ?l HAVING(COUNT(DISTINCT ?p) > 1) ORDER BY DESC(?n)"""
    assert ask(triples, text) == [("a", "grok, warp", 2)]


def test_links_and_service(spark, triples):
    text = 'SELECT ?l ?w WHERE { ?e a kg:Entity ; rdfs:label ?l ; owl:sameAs ?w . FILTER(STRSTARTS(STR(?w), "http://www.wikidata.org")) FILTER(CONTAINS(LCASE(STR(?l)), "a") && LANG(?l) = "") }'
    assert ask(triples, text) == [("a", f"{CATALOGUE}Q1")]
    remote = encoded(spark.createDataFrame([(f"{CATALOGUE}Q1", "http://schema.org/description", "a letter", "literal", None, "en")], "s string, p string, o string, o_kind string, o_datatype string, o_lang string"))
    text = 'SELECT ?w ?d WHERE { ?e owl:sameAs ?w . SERVICE <http://remote/> { ?w <http://schema.org/description> ?d . FILTER(LANG(?d) = "en") } }'
    assert ask(triples, text, {"http://remote/": remote}) == [(f"{CATALOGUE}Q1", "a letter")]


def test_filters_in_and_arithmetic(triples):
    assert ask(triples, "SELECT DISTINCT ?t WHERE { ?x a ?t . FILTER(?t IN (kg:Session, kg:None)) }") == [(f"{TERM}Session",)]
    assert len(ask(triples, "SELECT DISTINCT ?t WHERE { ?x a ?t . FILTER(?t NOT IN (kg:Session)) }")) == 2
    assert ask(triples, 'SELECT ?p (STRLEN(?p) * 2 + 1 AS ?n) WHERE { ?s kg:hasSourcePlatform ?p . FILTER(REGEX(?p, "^G", "i") || !BOUND(?p)) }') == [("grok", 9)]
    assert ask(triples, 'SELECT ?s WHERE { ?s dc:created ?c . FILTER(?c > "2025-01-01T12:00:00Z") } LIMIT 5') == [(f"{DATA}session/s1",)]


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x foo:bar ?y }", "SELECT ?x WHERE { ?x }", "ASK { ?s ?p ?o }", "SELECT ?x { ?x a <b> } LIMIT 1 junk"])
def test_errors(text):
    with pytest.raises(SparqlError):
        Parser(text).select()


def test_unconnected_patterns_are_refused(triples):
    with pytest.raises(SparqlError):
        sparql(triples, "SELECT ?x WHERE { ?x a <b> . ?y a <c> }")


def test_stored_by_predicate(spark, triples, tmp_path):
    """Each pattern reads its predicate's folder alone, the smallest first; results are those of the view."""
    kept = stored(triples, str(tmp_path / "terms"))
    assert sum(kept.sizes.values()) == triples.count()
    for text in (
        "SELECT ?l (COUNT(DISTINCT ?f) AS ?n) WHERE { ?f a kg:KnowledgeTriple ; kg:tripleSubject ?e . ?e rdfs:label ?l } GROUP BY ?l ORDER BY ?l",
        "SELECT DISTINCT ?p ?l WHERE { ?f kg:extractedInSession ?s ; kg:tripleObject ?e . ?s kg:hasSourcePlatform ?p . ?e rdfs:label ?l } ORDER BY ?p ?l",
        f"SELECT ?o WHERE {{ <{DATA}entity/a> ?p ?o }} ORDER BY ?o",
    ):
        assert ask(kept, text) == ask(triples, text)
    compiler = Compiler(kept.triples, None, kept.sizes)
    compiled = compiler.select(Parser(PREFIXES + "SELECT ?l WHERE { ?f kg:tripleSubject ?e . ?e rdfs:label ?l . ?f kg:triplePredicateLabel \"isPartOf\" }").select())
    plan = compiled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(p") == 3
    assert compiler.size((("var", "f"), ("term", f"<{TERM}triplePredicateLabel>"), ("term", '"isPartOf"'))) < 1


def brute(triples, *steps):
    """Solutions of ("join" | "left", pattern) steps or ("union", patterns) under compatibility, as dictionaries."""

    def matches(pattern):
        for t in triples:
            found = {}
            for want, got in zip(pattern, t, strict=True):
                if want.startswith("?"):
                    if found.setdefault(want, got) != got:
                        break
                elif want != got:
                    break
            else:
                yield found

    def meet(a, b):
        return {**a, **b} if all(a[k] == b[k] for k in a.keys() & b.keys()) else None

    out = [{}]
    for kind, what in steps:
        sides = list(what) if kind == "union" else list(matches(what))
        met = [[m for m in (meet(a, b) for b in sides) if m is not None] or ([a] if kind == "left" else []) for a in out]
        out = [m for found in met for m in found]
    return out


def test_unbound_variables_are_compatible(spark):
    """OPTIONAL or UNION first, then a join: against solutions worked out one by one."""
    base = [("<a>", "<p>", "<b>"), ("<a>", "<p>", "<c>"), ("<d>", "<p>", "<b>"), ("<b>", "<q>", "<x>"), ("<a>", "<r>", "<x>"), ("<a>", "<r>", "<y>"), ("<d>", "<r>", "<x>"), ("<d>", "<r>", "<z>"), ("<e>", "<r>", "<w>")]
    terms = spark.createDataFrame(base, "s string, p string, o string")

    def run(text, *names):
        return sorted(((tuple(r[n] for n in names)) for r in sparql(terms, text).collect()), key=repr)

    def want(solutions, *names):
        strip = lambda x: None if x is None else x.strip("<>")
        return sorted((tuple(strip(s.get(f"?{n}")) for n in names) for s in solutions), key=repr)

    left = brute(base, ("join", ("?s", "<p>", "?o")), ("left", ("?o", "<q>", "?v")))
    other = brute(base, ("join", ("?s", "<p>", "?o")))
    got = run("SELECT ?s ?o ?v WHERE { { ?s <p> ?o OPTIONAL { ?o <q> ?v } } UNION { ?s <p> ?o } ?s <r> ?v }", "s", "o", "v")
    assert got == want(brute(base, ("union", left + other), ("join", ("?s", "<r>", "?v"))), "s", "o", "v")
    assert len(got) == 10
    got = run("SELECT ?s ?o ?v WHERE { ?s <p> ?o OPTIONAL { ?o <q> ?v } OPTIONAL { ?s <r> ?v } }", "s", "o", "v")
    assert got == want(brute(base, ("join", ("?s", "<p>", "?o")), ("left", ("?o", "<q>", "?v")), ("left", ("?s", "<r>", "?v"))), "s", "o", "v")
    # two variables that may both be unbound join nothing by themselves
    with pytest.raises(SparqlError, match="may be unbound"):
        run("SELECT ?s WHERE { ?s <p> ?o OPTIONAL { ?o <q> ?v } OPTIONAL { ?o <r> ?u } OPTIONAL { ?u <p> ?v } }", "s")
