import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import EXPRESSIONS, entities, identifiers, register, responses, timestamps
from tessera.functions.vocabulary import ALL_PREDICATES, CANONICAL, EXTENSIONS, LINK_EXTENSIONS, WHITELIST


def evaluate(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_list_sizes():
    assert (len(ALL_PREDICATES), len(WHITELIST), len(CANONICAL), len(set(CANONICAL.values())), len(EXTENSIONS), len(LINK_EXTENSIONS)) == (24, 49, 149, 74, 43, 40)
    assert all(CANONICAL.get(name, name) == name for name in CANONICAL.values())


def test_slug(spark):
    cases = {"C++ / Node.js é ": "c-node-js", "日本": "", "A--B": "a-b", "x": "x", "": "", "Red Plate": "red-plate"}
    assert evaluate(spark, list(cases), identifiers.slug) == list(cases.values())


def test_triple_id_matches_md5(spark):
    import hashlib

    got = spark.range(1).select(identifiers.triple_id(F.lit("a"), F.lit("uses"), F.lit("b"), F.lit("m1"))).first()[0]
    assert got == hashlib.md5(b"a|uses|b|http://tessera.local/data/message/m1").hexdigest()[:12]


def test_cut(spark):
    assert evaluate(spark, ["x" * 5, "x" * 6, "é" * 6, None], lambda c: identifiers.cut(c, 5)) == ["x" * 5, "x" * 5 + "...", "é" * 5 + "...", None]


NORMAL = {"  React  ": "react", "foo .": "foo ", "A  B;": "a b", "x.,;:": "x", "": "", "　Go ": "go"}


def test_normalize_entity(spark):
    assert evaluate(spark, list(NORMAL), entities.normalize_entity) == list(NORMAL.values())


def plain_normalize(name):
    return re.sub(r"\s+", " ", name.strip().lower()).rstrip(".,;:")


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), max_size=20), min_size=1, max_size=40))
def test_normalize_entity_like_python(spark, names):
    assert evaluate(spark, names, entities.normalize_entity) == [plain_normalize(n) for n in names]


PREDICATES = {
    "uses": "uses", "Depends On": "dependsOn", "DEPENDSON": "dependsOn", "depends_on": "dependsOn", "is-part-of": "isPartOf", "de_pends_on": "relatedTo",
    "_uses": "uses", "built__with": "builtWith", "likes": "relatedTo", "": "relatedTo", "serves as": "servesAs",
}


def test_normalize_predicate(spark):
    assert evaluate(spark, list(PREDICATES), entities.normalize_predicate) == list(PREDICATES.values())


# name, first filter, second filter
JUDGED = [
    ("react", True, True), ("ai", True, True), ("aa", False, False), ("x", False, False), ("", False, False), ("yes", False, True), ("#fff", False, False),
    ("/usr/bin", False, False), ("a\\b", False, True), ("config.json", False, False), ("node.js", False, False), ("__init__.py", False, False),
    ("a021", False, False), ("k25.0", False, False), ("ansied_022_001", False, False), ("dengue_008", False, False), ("anthropic_api_key", False, False),
    ("0 bytes", False, False), ("0.75 confidence", False, False), ("1400px", False, False), ("42", False, False), ("10.158.0.38", False, False),
    ("120s", False, True), ("7f9ef80", False, True), ("80 tests", False, False), ("7th character", False, True), ("8/8h", False, False),
    ("height 280px", False, False), ("50% off", False, False), ("a[0]", False, False), ("f()", False, False), ("one two three four", False, True),
    ("tcp/ip", True, False), ("-v", False, False), ("ab1", True, True), ("a=b", True, False), ("facade", False, True), ("x86", False, False),
    ("knowledge graph", True, True), ("'quoted'", True, False), ("1184x864", True, False), ("a*b", True, False), ("é٣ px", True, True),
]


def test_filters(spark):
    names = [n for n, _, _ in JUDGED]
    first, second = evaluate(spark, names, entities.is_valid_entity), evaluate(spark, names, entities.is_linkable_entity)
    assert [(n, a, b) for n, a, b in zip(names, first, second, strict=True) if (n, a, b) not in JUDGED] == []
    assert evaluate(spark, [None], entities.is_valid_entity) == [False]
    assert evaluate(spark, [None], entities.is_linkable_entity) == [False]


def test_labels(spark):
    assert evaluate(spark, [" K8S ", "Unknown Thing ", "NodeJS"], entities.normalize_label) == ["kubernetes", "Unknown Thing", "node.js"]


def test_tech_keyword_is_a_substring(spark):
    assert evaluate(spark, ["capital city", "a city", None], entities.has_tech_keyword) == [True, False, False]


def fact(s, p="uses", o="pydantic"):
    return {"subject": s, "predicate": p, "object": o}


def parse(spark, raws):
    got = evaluate(spark, raws, responses.parse_response)
    return [None if x is None else [tuple(f) for f in x] for x in got]


def test_parse_clean_wrapped_and_prose(spark):
    listed = json.dumps([fact("FastAPI", "depends on")])
    want = [("fastapi", "dependsOn", "pydantic")]
    raws = [listed, json.dumps({"n": 1, "triples": [fact("FastAPI", "depends on")]}), f"Sure: {listed} ok", "[]", json.dumps({"a": 1}), "nothing", "42", None]
    assert parse(spark, raws) == [want, want, want, [], None, None, None, None]


def test_parse_is_strict(spark):
    raws = [json.dumps([{"subject": 42, "predicate": "uses", "object": "x1y"}]), "[{'subject': 'a'}]", json.dumps([fact("flask"), None, "x", {"subject": "a"}]), json.dumps([fact("flask", "")])]
    assert parse(spark, raws) == [[], None, [("flask", "uses", "pydantic")], []]


def test_cap_comes_after_filtering(spark):
    twelve = [fact(f"thing {'abcdefghijkl'[i]}x") for i in range(12)]
    mixed = [fact("yes")] * 4 + twelve[:8]
    got = parse(spark, [json.dumps(twelve), json.dumps(mixed)])
    assert [len(x) for x in got] == [10, 8]
    assert got[0][0][0] == "thing ax"


def test_truncated_at_every_offset(spark):
    whole = json.dumps([fact("flask"), fact("django")])
    got = parse(spark, [whole[:i] for i in range(1, len(whole))])
    flags = evaluate(spark, [whole[:i] for i in range(1, len(whole))], responses.is_truncated)
    first_end = whole.index("}") + 1
    for i, x, cut in zip(range(1, len(whole)), got, flags, strict=True):
        assert cut
        assert (x is None) == (i < first_end) and len(x or []) == (0 if i < first_end else 2 if i >= len(whole) - 1 else 1)


def test_salvage(spark):
    got = evaluate(spark, [json.dumps([fact("a"), fact("b")])[:-5]], responses.salvage)
    assert [f.subject for f in got[0]] == ["a"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025-01-15T10:00:00.123456+02:00", "2025-01-15T08:00:00Z"), ("2025-01-15T10:00:00Z", "2025-01-15T10:00:00Z"), ("soon", "soon"), (None, None)],
)
def test_utc_seconds(spark, text, want):
    assert evaluate(spark, [text], timestamps.utc_seconds) == [want]


def test_mongo_time(spark):
    raws = ["2025-01-01T00:00:00Z", '{"$date": "2025-01-02T00:00:00Z"}', '{"$date": {"$numberLong": "1735689600000"}}', None]
    assert evaluate(spark, raws, timestamps.mongo_time) == ["2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z", None]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT kg_slug('A b') AS s, kg_normalize_entity(' A  b. ') AS n, length(kg_triple_id('a', 'uses', 'b', 'm')) AS t").first()
    assert tuple(row) == ("a-b", "a b", 12)


def test_sql_functions_of_expressions(spark):
    register(spark)
    names = ["flask", "#x", "foo.py", "K8S", " postgres ", "x/y/z", "it's", "a b c d", "10%", "dépôt", "js", "zz", "a_b_c", "a=b", "a software", "", None]
    spark.createDataFrame([(n,) for n in names], "name string").createOrReplaceTempView("names")
    for function, (_, expression) in EXPRESSIONS.items():
        rows = spark.table("names").select(F.expr(f"{function}(name)").alias("a"), expression(F.col("name")).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], function
