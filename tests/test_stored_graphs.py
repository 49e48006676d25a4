import pytest

from tessera.plans import graph_model
from tessera.sources import stored_graphs
from tessera.sources.stored_graphs import XSD, Unreadable, turtle

ROWS = [
    ("http://x/s", "http://x/p", "http://x/o", "iri", None), ("http://x/s", "http://x/p", "plain", "literal", None), ("http://x/s", "http://x/p", "", "literal", None),
    ("http://x/s", "http://x/p", 'a "quoted" \\n back\\slash\nnew line\r\ttab <x> @en ^^', "literal", None), ("http://x/s", "http://x/p", "2025-01-01T00:00:00Z", "literal", graph_model.DATE_TIME),
    ("http://x/s", "http://x/q", "été 日本 \\\\", "literal", None), ("http://x/s", "http://x/q", "\\u0041 \\\\u0041", "literal", None),
]


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "s string, p string, o string, o_kind string, o_datatype string")
    graph_model.n_triples(rows).write.text(str(tmp_path / "out"))
    read, refused = stored_graphs.read_n_triples(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, read.drop("o_lang").collect()), key=repr) == sorted(ROWS, key=repr)
    assert refused.count() == 0


def test_lines_of_other_writers(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# note\n\n_:b1 <http://x/p> "caf\\u00e9"@fr .\n<http://x/s>\t<http://x/p>  _:b1 . # end\nnonsense\n<http://x/s> <http://x/p> "open .\n')
    read, refused = stored_graphs.read_n_triples(spark, str(tmp_path / "a.nt"))
    assert set(map(tuple, read.collect())) == {("_:b1", "http://x/p", "café", "literal", None, "fr"), ("http://x/s", "http://x/p", "_:b1", "iri", None, None)}
    assert refused.count() == 2


TURTLE = '''@prefix kg: <http://x/kg#> .
@prefix : <http://x/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment
<http://x/data/s1> a kg:Session,
        kg:Thing ;
    kg:count 3 ;
    kg:share 0.5, 1e3 ;
    kg:open true ;
    rdfs:label "Title \\"one\\""@en, """long
text with "quotes" and \\\\ """ ;
    kg:at "2025-01-01T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> ;
    .

:e.1 rdfs:label "caf\\u00E9" ; kg:near _:n1 .
'''


def test_turtle():
    s, kg, label = "http://x/data/s1", "http://x/kg#", "http://www.w3.org/2000/01/rdf-schema#label"
    assert list(turtle(TURTLE)) == [
        (s, stored_graphs.RDF_TYPE, f"{kg}Session", "iri", None, None), (s, stored_graphs.RDF_TYPE, f"{kg}Thing", "iri", None, None), (s, f"{kg}count", "3", "literal", f"{XSD}integer", None),
        (s, f"{kg}share", "0.5", "literal", f"{XSD}decimal", None), (s, f"{kg}share", "1e3", "literal", f"{XSD}double", None), (s, f"{kg}open", "true", "literal", f"{XSD}boolean", None),
        (s, label, 'Title "one"', "literal", None, "en"), (s, label, 'long\ntext with "quotes" and \\ ', "literal", None, None), (s, f"{kg}at", "2025-01-01T00:00:00Z", "literal", f"{XSD}dateTime", None),
        ("http://x/e.1", label, "café", "literal", None, None), ("http://x/e.1", f"{kg}near", "_:n1", "iri", None, None),
    ]


@pytest.mark.parametrize("text", ["<http://x/s> <http://x/p> ", "<http://x/s> x:p 1 .", "<a> <b> <c>", '<http://x/s> <http://x/p> "open .', "hello", "<http://x/s> a b ."])
def test_unreadable(text):
    with pytest.raises(Unreadable):
        list(turtle(text))


def test_files(spark, tmp_path):
    (tmp_path / "good.ttl").write_text(TURTLE)
    (tmp_path / "bad.ttl").write_text("<a> <b>")
    rows, refused = stored_graphs.read_turtle(spark, str(tmp_path))
    assert rows.count() == 11 and [r.source.rsplit("/", 1)[1] for r in refused.collect()] == ["bad.ttl"]
