import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions.responses import FACTS
from tessera.operators import batches, extraction, incremental, linking
from tessera.plans import graph_model, graph_queries
from tessera.streaming import ingest


def facts(spark, data):
    rows = [(s, s.replace(" ", "-"), p, o, o.replace(" ", "-"), f"t{i}", m, n, f"content of {m}") for i, (s, p, o, m, n) in enumerate(data)]
    return spark.createDataFrame(rows, "subj_name string, subj string, predicate string, obj_name string, obj string, triple_id string, message_id string, session string, content string")


DATA = [("a", "uses", "b", "m1", "s1"), ("a", "uses", "b", "m2", "s2"), ("b", "uses", "a", "m2", "s2"), ("a", "isPartOf", "a", "m1", "s1"), ("c d", "uses", "b", "m3", "s3")]


def test_cooccurrence_is_directed(spark):
    got = [tuple(r) for r in graph_queries.cooccurrence(facts(spark, DATA)).collect()]
    assert got == [("a", "b", 2), ("b", "a", 1), ("c d", "b", 1)]


def test_hubs_count_a_fact_once_per_entity(spark):
    assert [tuple(r) for r in graph_queries.hubs(facts(spark, DATA)).collect()] == [("a", 4), ("b", 4), ("c d", 1)]


def test_topics_count_messages(spark):
    assert {r.label: r.mentions for r in graph_queries.topic_counts(facts(spark, DATA)).collect()} == {"a": 2, "b": 3, "c d": 1}


def test_fact_rows(spark):
    got = graph_model.fact_rows(facts(spark, DATA))
    # 5 facts of 6, 4 edges, 6 mentions, 3 entities of 2 (m1: a, b; m2: a, b; m3: c d, b)
    assert got.count() == 30 + 4 + 6 + 6
    assert graph_queries.triple_count(got).first()[0] == 46


def test_paths_are_simple(spark):
    got = [tuple(r) for r in graph_model.paths(facts(spark, DATA), "c d").orderBy("hops").collect()]
    assert got == [(1, "c d uses b", "b"), (2, "c d uses b uses a", "a")]


def test_empty_tables(spark):
    none = facts(spark, [])
    assert graph_queries.hubs(none).count() == 0
    assert graph_queries.triple_count(graph_model.fact_rows(none)).first()[0] == 0


def messages(spark, texts):
    return spark.createDataFrame([(f"m{i}", f"s{i}", "assistant", t) for i, t in enumerate(texts)], "message_id string, session string, role string, content string")


TEXT = "The web server. flask uses werkzeug. And more words follow here."


def test_extract_and_cache(spark):
    m = messages(spark, [TEXT, "short", TEXT + " x"])
    got = {r.message_id: [tuple(f) for f in r.facts] for r in extraction.extract(m).collect()}
    assert got == {"m0": [("flask", "uses", "werkzeug")], "m2": [("flask", "uses", "werkzeug")]}

    def refuse():
        raise AssertionError("the provider must not be asked")

    cache = extraction.extract(m)
    again = extraction.extract(m, spark.createDataFrame(cache.collect(), cache.schema), provider=refuse)
    assert again.count() == 2


def test_changed_text_is_asked_again(spark):
    cache = spark.createDataFrame([("m0", "0" * 16, [], 0)], "message_id string, text_hash string, facts array<struct<subject:string,predicate:string,object:string>>, truncations int")
    assert [len(r.facts) for r in extraction.extract(messages(spark, [TEXT]), cache).collect()] == [1]


def test_retries_shrink(spark):
    class Failing:
        """Fails, answers cut off, then answers with the length it was sent."""

        def __init__(self):
            self.sent = []

        def generate(self, prompt):
            self.sent.append(prompt.rpartition("TEXT:")[2].count("x"))
            if len(self.sent) == 1:
                raise OSError("no answer")
            return "[{" if len(self.sent) == 2 else json.dumps([{"subject": "flask", "predicate": "uses", "object": f"size{'-'.join(map(str, self.sent))}"}])

    got = extraction.extract(messages(spark, ["x" * 2000]), provider=Failing).first()
    assert [f.object for f in got.facts] == ["size1500-1000-800"]


def test_facts_of(spark):
    m = messages(spark, [TEXT, TEXT])
    got = extraction.facts_of(extraction.extract(m), m)
    assert got.count() == 2 and got.select("triple_id").distinct().count() == 2


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert {r.k: r.v for r in extraction.latest(df, "k", "at").collect()} == {"a": "y", "b": "z"}


def test_batch_round_trip(spark):
    m = messages(spark, [TEXT]).withColumn("source_file", F.lit("f1"))
    request = json.loads(batches.request_lines(m).first().value)
    assert json.loads(request["metadata"]) == {"message_id": "m0", "session_id": "s0", "source_file": "f1"}
    assert request["request"]["contents"][0]["parts"][0]["text"].endswith(TEXT)
    answer = lambda text, meta: json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}, "metadata": meta})
    good = json.dumps([{"subject": "flask", "predicate": "uses", "object": "jinja"}])
    lines = spark.createDataFrame([(answer(good, request["metadata"]),), (answer("[]", json.loads(request["metadata"])),), ("junk",), (answer("?", request["metadata"]),)], "value string")
    assert sorted(len(r.facts) for r in batches.read_answers(lines).collect()) == [0, 1]
    assert batches.read_answers(lines, drop_empty=True).count() == 1
    assert tuple(batches.by_source(batches.read_answers(lines)).first()) == ("f1", 2, 1)


CANDIDATES = [
    ("python", 1, "Q1", "python family", "snakes", ["pythons"]), ("python", 2, "Q2", "monty python", "a group", ["Python"]), ("python", 3, "Q3", "Python", "a language", []),
    ("alias", 1, "Q4", "other", "x", []), ("alias", 2, "Q5", "thing", "y", ["ALIAS"]),
    ("keyword", 1, "Q6", "x", "capital of France", []), ("keyword", 2, "Q7", "x", "a software", []), ("nothing", 1, "Q8", "x", "a town", None),
    ("twin", 1, "Q3", "twin", "a language", ["a", "b", "c", "d", "e", "f"]),
]


def test_best_match_tiers(spark):
    df = spark.createDataFrame(CANDIDATES, linking.CANDIDATE)
    best = {r.query_label: (r.qid, r.confidence) for r in linking.best_match(df).collect()}
    assert best == {"python": ("Q3", 1.0), "alias": ("Q5", 0.5), "keyword": ("Q6", 0.8), "nothing": ("Q8", 0.5), "twin": ("Q3", 1.0)}
    assert {r.query_label: r.qids for r in linking.ambiguous(df).collect()} == {"keyword": ["Q6", "Q7"]}
    more = spark.createDataFrame([*CANDIDATES, *[("keyword", n, f"Q{n}", "x", "a tool", []) for n in range(20, 30)]], linking.CANDIDATE)
    assert [tuple(r) for r in linking.ambiguity_report(more).collect()] == [("keyword", "Q6", ["Q7", "Q20", "Q21"])]  # "capital" holds "api"
    links = linking.linked(linking.best_match(df))
    assert sorted(r.query_label for r in links.collect()) == ["keyword", "python", "twin"]
    assert [tuple(r) for r in linking.same_item(links).collect()] == [("twin", "python", "Q3")]
    assert [len(r.aliases) for r in linking.best_match(df).filter("query_label = 'twin'").collect()] == [5]


def test_counts_are_the_largest_of_the_spellings(spark):
    labels = spark.createDataFrame([("js", 3), ("javascript", 2), ("rare", 1)], "label string, sources long")
    assert {r.canonical: r.sources for r in linking.canonical_sources(labels).collect()} == {"javascript": 3, "rare": 1}
    assert linking.frequent(labels).count() == 1


def test_contexts(spark):
    got = {r.label: r.context for r in linking.contexts(facts(spark, DATA + [("a", "uses", x, "m9", "s9") for x in "pqrst"])).collect()}
    assert got["a"] == 'appears in facts: "a isPartOf a", "a uses b", "a uses p", "a uses q", "a uses r"'


def test_cache_and_snapshot(spark):
    labels = spark.createDataFrame([("K8s",), ("new",), ("miss",)], "label string")
    cache = spark.createDataFrame([("k8s", "Q1", 0.9), ("miss", None, 0.0)], "label string, qid string, confidence double")
    assert {r.label: (r.qid, r.cached) for r in linking.cache_split(labels, cache).collect()} == {"K8s": ("Q1", True), "new": (None, False), "miss": (None, True)}
    assert tuple(linking.snapshot(labels, cache).first()) == (3, 2, 1, 1, 0)


def test_search_provider(spark):
    def provider():
        def find(label):
            if label == "bad":
                raise OSError
            return [{"id": "Q1", "label": label, "description": "a tool", "aliases": []}]

        return find

    labels = spark.createDataFrame([("x",), ("bad",)], "label string")
    assert [tuple(r)[:4] for r in linking.search(labels, provider).collect()] == [("x", 1, "Q1", "x")]


def test_link(spark):
    f = facts(spark, [("python", "uses", "a=b", f"m{i}", f"s{i}") for i in range(2)] + [("twin", "uses", "keyword", "m5", "s5")])
    got = linking.link(f, spark.createDataFrame(CANDIDATES, linking.CANDIDATE), minimum=2)
    assert [tuple(r) for r in got.collect()] == [("python", "Q3", 1.0)]


def test_ledger(spark):
    sources = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, sha256 string")
    ledger = spark.createDataFrame([("a", "1"), ("b", "9")], incremental.LEDGER_SCHEMA)
    assert sorted(r.source for r in incremental.changed(sources, ledger).collect()) == ["b", "c"]


@pytest.mark.parametrize(("path", "want"), [("/home/u/projects/p/f", "/data/p/f"), ("/home/u/x", "/home/u/x"), ("/other/projects/x", "/data/x")])
def test_translate_path(spark, path, want):
    assert spark.range(1).select(incremental.translate_path(F.lit(path), "/data")).first()[0] == want


def session(kind, n, text):
    return json.dumps({"type": kind, "uuid": f"u{n}", "sessionId": f"S {n}", "message": {"content": text}})


def test_stream_equals_batch_and_replays(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "subagents").mkdir(parents=True)
    for n in range(3):
        (inbox / f"s{n}.jsonl").write_text(session("user", n, f"text {n}"))
    (inbox / "bad.jsonl").write_text("nonsense")
    (inbox / "subagents" / "x.jsonl").write_text(session("user", 9, "no"))
    store = ingest.Store(spark, str(tmp_path / "store"))
    run = lambda: ingest.start(spark, str(inbox), store, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    texts = lambda: {r.session: r.content for r in store.current("messages").collect()}
    assert texts() == {f"s-{n}": f"text {n}" for n in range(3)}
    assert [r.source.rsplit("/", 1)[1] for r in store.read("dead_letter").collect()] == ["bad.jsonl"]
    run()  # nothing new
    assert store.read("ledger").count() == 4
    (inbox / "s1-again.jsonl").write_text(session("user", 1, "changed"))
    run()
    assert texts()["s-1"] == "changed" and store.current("messages").count() == 3
    # a replayed batch replaces itself
    files = spark.createDataFrame([("f", session("user", 7, "seven"))], "source string, text string")
    for _ in range(2):
        ingest.process(files, store, 50)
    assert store.read("messages").filter("batch = 50").count() == 1


def test_windows_of_a_stream_or_table(spark):
    calls = spark.createDataFrame([("2025-01-01 00:10:00", "a"), ("2025-01-01 00:50:00", "a"), ("2025-01-01 01:00:00", "b")], "t string, tool_name string").select(F.to_timestamp("t").alias("created"), "tool_name")
    assert sorted((r.tool_name, r.uses) for r in ingest.tool_usage_windows(calls).collect()) == [("a", 2), ("b", 1)]


def test_facts_schema():
    assert FACTS.elementType.names == ["subject", "predicate", "object"]


class Recorder:
    """Answers in order; keeps the lengths of the texts it was asked about."""

    def __init__(self, *answers):
        self.answers, self.lengths = list(answers), []

    def generate(self, prompt):
        assert prompt.startswith(extraction.PROMPT_HEAD)
        self.lengths.append(len(prompt) - len(extraction.PROMPT_HEAD))
        answer = self.answers.pop(0)
        if answer is None:
            raise TimeoutError
        return answer


FACT = '{"subject": "spark", "predicate": "uses", "object": "scala"}'


@pytest.mark.parametrize(
    ("answers", "lengths", "kept", "cut_off"),
    [
        ([f"[{FACT}]"], [1500], True, 0),
        ([None, f"[{FACT}]"], [1500, 1000], True, 0),
        (["no json", "still none", "[]"], [1500, 1000, 1000], True, 0),
        ([f"[{FACT}, {{"], [1500], True, 1),
        ([None, None, None], [1500, 1000, 1000], False, 0),
        (["[{", "[{", "no"], [1500, 800, 800], False, 2),
    ],
)
def test_retries(answers, lengths, kept, cut_off):
    provider = Recorder(*answers)
    answer, truncations = extraction.ask(provider, "x" * 4000)
    assert (provider.lengths, answer is not None, truncations) == (lengths[: len(provider.lengths)], kept, cut_off)


def test_answers_are_asked_for_once(spark, tmp_path):
    def refuse():
        raise AssertionError("the provider must not be asked")

    store = ingest.Store(spark, str(tmp_path))
    m = messages(spark, [TEXT, TEXT + " More text here."])
    first = sorted(map(tuple, extraction.extract_into(store, m, 0).collect()))
    assert len(first) == 2 and first == sorted(map(tuple, extraction.extract_into(store, m, 1, provider=refuse).collect()))
    assert store.read("cache").filter("batch = 1").count() == 0


def test_provider_order():
    there = lambda: True
    assert extraction.detect_provider({}) == "scripted" and extraction.detect_provider({"TESSERA_PROVIDER": "x"}) == "x"
    assert extraction.detect_provider({"OPENAI_API_KEY": "k", "ANTHROPIC_API_KEY": "k"}) == "openai"
    assert extraction.detect_provider({"ANTHROPIC_API_KEY": "k", "TESSERA_MODEL": "m"}, there) == "anthropic"
    assert extraction.detect_provider({"TESSERA_MODEL": "m"}, there) == "ollama"
    assert extraction.list_providers() == ["scripted", "gemini", "openai", "anthropic", "ollama"]
    with pytest.raises(ValueError, match="unknown provider"):
        extraction.get_provider("none")
    with pytest.raises(ValueError, match="gemini needs GEMINI_API_KEY and TESSERA_MODEL"):
        extraction.get_provider("gemini", {})


ANSWER = '[{"subject": "flask", "predicate": "uses", "object": "werkzeug"}]'
REPLIES = {
    "/v1beta/models/m:generateContent": {"candidates": [{"content": {"parts": [{"text": ANSWER}]}}]},
    "/v1/chat/completions": {"choices": [{"message": {"content": f'{{"facts": {ANSWER}}}'}}]},
    "/v1/messages": {"content": [{"type": "text", "text": ANSWER}]},
    "/api/generate": {"response": ANSWER},
}


@pytest.fixture
def model_service():
    """A local stand-in of all services: (address, requests met)."""
    met = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            met.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(REPLIES[self.path]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", met
    server.shutdown()


@pytest.mark.parametrize("service", ["gemini", "openai", "anthropic", "ollama"])
def test_hosted_providers(spark, model_service, service):
    address, met = model_service
    settings = {"TESSERA_PROVIDER": service, "TESSERA_MODEL": "m", "TESSERA_ADDRESS": address, "GEMINI_API_KEY": "key", "OPENAI_API_KEY": "key", "ANTHROPIC_API_KEY": "key"}
    provider = extraction.get_provider(environment=settings)
    rows = extraction.extract(messages(spark, [TEXT]), provider=provider).collect()
    assert [(f.subject, f.predicate, f.object) for r in rows for f in r.facts] == [("flask", "uses", "werkzeug")]
    ((_, headers, body),) = met
    assert TEXT in json.dumps(body) and "0.2" in json.dumps(body) and "8192" in json.dumps(body)
    assert (service == "ollama") != any("key" in v for v in headers.values())


def test_link_into(spark, tmp_path):
    """Misses are searched once, empty answers are remembered, labels of one item share the least."""
    store = ingest.Store(spark, str(tmp_path))
    f = facts(spark, [("python", "uses", "golang", f"m{i}", f"s{i}") for i in range(3)] + [("python", "uses", "nothing", f"n{i}", f"s{i}") for i in range(3)])

    def provider():
        return lambda label: [] if label == "nothing" else [{"id": "Q1", "label": label, "description": "software", "aliases": []}]

    def forbidden():
        raise AssertionError("asked again")

    links, counts = linking.link_into(store, f, provider, 0)
    assert sorted((r.label, r.canonical, r.qid, r.same) for r in links.collect()) == [("golang", "golang", "Q1", False), ("python", "golang", "Q1", True)]
    assert tuple(counts.first()) == (3, 3, 0, 2, 1)
    assert {r.label: r.qid for r in store.read("link_cache").collect()} == {"python": "Q1", "golang": "Q1", "nothing": None}
    again, _ = linking.link_into(store, f, lambda: lambda label: forbidden(), 1)
    assert again.count() == 2 and store.read("link_cache").filter("batch = 1").count() == 0


def test_search_with_context(spark):
    labels = spark.createDataFrame([("spark", "appears in facts")], "label string, context string")
    got = linking.search(labels, lambda: lambda label, context: [{"id": "Q1", "label": context}]).first()
    assert (got.query_label, got.label) == ("spark", "appears in facts")


def test_collect_jobs(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    m = spark.createDataFrame([("m1", "s1", "text one"), ("m2", "s2", "text two")], "message_id string, session string, content string")
    line = lambda i, text: json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}, "metadata": json.dumps({"message_id": i, "session_id": "s", "source_file": "f"})})
    lines = spark.createDataFrame([("j1", line("m1", f"[{FACT}]")), ("j1", line("m2", "[]")), ("j2", "{}"), ("j3", line("m2", f"[{FACT}]"))], "job_id string, value string")
    jobs = spark.createDataFrame([("j1", "succeeded", 2), ("j2", "succeeded", 1), ("j3", "running", 1)], "job_id string, state string, requests long")
    states = {r.job_id: (r.state, r.answers) for r in batches.collect_jobs(store, jobs, lines, m, 0).collect()}
    assert states == {"j1": ("collected", 2), "j2": ("failed", 0), "j3": ("running", 0)}
    assert [(r.subj_name, r.session) for r in store.read("facts").collect()] == [("spark", "s1")]


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    assert store.read("ledger", "source string").count() == 0
    store.append(spark.createDataFrame([("a",)], "source string"), "ledger", 0)
    for path in (tmp_path / "ledger").rglob("*.parquet"):
        path.write_bytes(b"not parquet")
        (path.parent / f".{path.name}.crc").unlink()
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        store.read("ledger", "source string").count()
