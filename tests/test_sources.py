import io
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from tessera.plans import graph_model
from tessera.sources import exports, jsonl, lines, terminal


def line(**x):
    return json.dumps(x)


def message(kind, uuid, parent, text, time, model=None):
    return line(type=kind, uuid=uuid, parentUuid=parent, sessionId="demo-1", timestamp=time, message={"content": [{"type": "text", "text": text}]} | ({"model": model} if model else {}))


GOLDEN = "\n".join(
    [
        message("user", "u1", None, "How do I start?", "2025-01-15T10:00:00.000Z"),
        message("assistant", "a1", "u1", "Use a framework.", "2025-01-15T10:00:10.000Z", "model-x"),
        message("user", "u2", "a1", "And storage?", "2025-01-15T10:01:00.000Z"),
        message("assistant", "a2", "u2", "A database.", "2025-01-15T10:01:10.000Z", "model-x"),
        message("assistant", "a3", "a2", "And a cache.", "2025-01-15T10:01:30.000Z", "model-x"),
    ]
)


def files(spark, *texts, names=None):
    names = names or [f"/data/s{i}.jsonl" for i in range(len(texts))]
    return spark.createDataFrame(list(zip(names, texts, strict=True)), "source string, text string")


def test_five_messages_give_48_statements(spark):
    assert jsonl.graph_rows(jsonl.entries(files(spark, GOLDEN))).count() == 48


def test_unknown_types_leave_the_developer_only(spark):
    text = "\n".join(line(type=t, sessionId="x") for t in ("session_start", "message", "session_end"))
    assert jsonl.graph_rows(jsonl.entries(files(spark, text))).count() == 2


ODD = "\n".join(
    [
        "",
        "not json",
        line(type="system", uuid="s"),
        line(type="user", uuid="m0", parentUuid="m2", message={"content": "plain text"}),
        line(type="assistant", message={"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": " "}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t1", "name": "run", "input": {"k": [1, 2], "é": "x"}}, {"type": "tool_use", "input": {}}], "model": "m"}),
        line(type="user", uuid="m2", parentUuid="m0", sessionId="late", timestamp="T1", message={"content": [{"type": "tool_use", "id": "no", "input": {}}, {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "r1"}, {"type": "image"}, {"type": "text", "text": "r2"}]}]}),
        line(type="user", uuid="m3", message={"content": [{"type": "tool_result", "tool_use_id": "t2", "content": "z" * 501}]}),
    ]
)


def test_odd_lines(spark):
    entries = jsonl.entries(files(spark, ODD))
    got = {r.message_id: r for r in jsonl.messages(entries).collect()}
    assert list(sorted(got)) == ["m0", "m2", "m3", "unknown-1"]
    assert {r.session for r in got.values()} == {"late"}
    assert (got["m0"].full_text, got["unknown-1"].full_text, got["m2"].full_text) == ("plain text", "a\nb", "")
    assert (got["m0"].parent_id, got["m2"].parent_id) == (None, "m0")
    calls = {r.tool_id: r for r in jsonl.tool_calls(entries).collect()}
    assert {k: (r.tool_name, r.description) for k, r in calls.items()} == {"t1": ("run", '{"k": [1, 2], "é": "x"}'), "tool-2": ("unknown", "{}")}
    results = {r.tool_id: r.content for r in jsonl.tool_results(entries).collect()}
    assert results == {"t1": "r1 r2", "t2": "z" * 500 + "..."}
    session = jsonl.sessions(entries).first()
    assert (session.created, session.modified) == ("T1", None)


def test_session_id_falls_back_to_the_file(spark):
    text = line(type="user", uuid="a", message={"content": "x"})
    got = jsonl.sessions(jsonl.entries(files(spark, text, names=["/home/projects/my-app/abc.jsonl"]))).first()
    assert (got.session_id, got.project, got.created) == ("abc", "my-app", None)


def test_detect_project(spark):
    cases = {"/a/projects/p1/f.jsonl": "p1", "/a/projects/p1": None, "/a/b.jsonl": None, "/projects/x/projects/y/z": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.p for r in df.select("s", jsonl.detect_project(F.col("s")).alias("p")).collect()} == cases


def test_content_is_cut(spark):
    texts = [line(type="user", uuid=str(n), message={"content": "x" * n}) for n in (2000, 2001)]
    got = {r.message_id: len(r.content) for r in jsonl.messages(jsonl.entries(files(spark, "\n".join(texts)))).collect()}
    assert got == {"2000": 2000, "2001": 2003}


def test_find_sessions(spark, tmp_path):
    for name in ("b.jsonl", "a.jsonl", "subagents/c.jsonl", "d.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(name)
    names = lambda **o: [r.source.rsplit("/", 1)[1] for r in jsonl.find_sessions(spark, str(tmp_path), **o).collect()]
    assert names() == ["a.jsonl", "b.jsonl"]
    assert names(include_subagents=True, limit=2) == ["a.jsonl", "b.jsonl"]
    assert sorted(names(include_subagents=True, sort="newest")) == ["a.jsonl", "b.jsonl", "c.jsonl"]


def node(parent, children, *fragments, model="m", at="2025-01-01T08:00:00.000000+08:00"):
    return {"parent": parent, "children": children, "message": {"model": model, "inserted_at": at, "fragments": [{"type": t, "content": c} for t, c in fragments]} if fragments else None}


def zipped(spark, members, path="/x/export.zip"):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, value in members.items():
            z.writestr(name, json.dumps(value))
    return spark.createDataFrame([(path, bytearray(raw.getvalue()))], "source string, content binary")


def test_tree_export(spark):
    mapping = {
        "root": node(None, ["1", "4"]), "1": node("root", ["2"], ("REQUEST", "q")), "2": node("1", ["3"], ("THINK", "t"), ("RESPONSE", "r"), ("OTHER", "o"), ("RESPONSE", "")),
        "3": node("2", [], ("REQUEST", "q2"), ("RESPONSE", "r2"), at="soon"), "4": node("root", [], ("REQUEST", "branch")),
    }
    zips = zipped(spark, {"user.json": {"name": "Ada"}, "conversations.json": [{"id": "Conv 1", "title": "T", "inserted_at": "2025-01-01T08:00:00+08:00", "updated_at": None, "mapping": mapping}]})
    rows = exports.trees(zips)
    session = exports.tree_sessions(rows).first()
    assert (session.session, session.created, session.developer) == ("conv-1", "2025-01-01T00:00:00Z", "Ada")
    got = [(r.message_id, r.role, r.content, r.parent_id) for r in exports.tree_messages(rows).orderBy("seq").collect()]
    p = "ds-conv-1-"
    assert got == [
        (p + "1-user", "user", "q", None), (p + "2-assistant", "assistant", "t\nr", p + "1-user"), (p + "3-user", "user", "q2", p + "2-assistant"),
        (p + "3-assistant", "assistant", "r2", p + "3-user"), (p + "4-user", "user", "branch", None),
    ]


def test_tree_without_root_and_deep():
    chain = {str(i): node(str(i - 1) if i else None, [str(i + 1)], ("REQUEST", f"q{i}")) for i in range(5000)}
    assert [m["content"] for m in exports.walk(chain)] == [f"q{i}" for i in range(5000)]
    assert exports.walk({}) == []


def test_list_export(spark):
    response = lambda **x: {"response": x}
    conv = {"conversation": {"title": "T", "create_time": {"$date": {"$numberLong": "1735689600000"}}}, "responses": [response(_id="a", sender="human", message="hi"), response(sender="assistant", message=" "), response(sender="ASSISTANT", message="yo", create_time="2025", metadata={"requestModelDetails": {"modelId": "g"}})]}
    rows = exports.responses(zipped(spark, {"x/prod-grok-backend.json": {"conversations": [conv]}}))
    assert exports.response_sessions(rows).first().created == "2025-01-01T00:00:00Z"
    got = [(r.message_id, r.role, r.model, r.parent_id) for r in exports.response_messages(rows).orderBy("seq").collect()]
    assert got == [("a", "user", None, None), ("grok-msg-grok-0-2", "assistant", "g", "a")]
    assert exports.listing(exports.response_messages(rows)).first().messages == 2


def test_sqlite(spark, tmp_path):
    path = tmp_path / "t.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE ai_queries (exchange_id, conversation_id, start_ts, input, working_directory, output_status, model_id)")
        rows = [(f"e{i}", "C 1" if i < 5 else "C 2", "2025", json.dumps([{"Query": {"text": "x" * 31}}, {"ActionResult": {}}]), "/w", "ok", "m") for i in range(9)]
        rows += [("bad", "C 2", "2025", "{", "/w", "ok", "m"), ("two", "C 2", "2025", json.dumps([{"Query": {"text": "a"}}, {"Query": {"text": "b"}}]), "/w", "ok", "m")]
        db.executemany("INSERT INTO ai_queries VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    messages = terminal.messages(terminal.read(spark, str(path), "ai_queries"))
    got = {r.message_id: r.content for r in messages.collect()}
    assert len(got) == 10 and got["two"] == "a\nb" and "bad" not in got
    assert [r.session for r in terminal.worth_keeping(messages).collect()] == ["c-1"]


def test_entity_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\n\n  b \n")
    assert [r.label for r in lines.read_entities(spark, str(tmp_path / "e.txt")).collect()] == ["a", "b"]


def test_ntriples_escape(spark):
    row = spark.createDataFrame([("s", "p", 'a"b\n\\', "literal", None), ("s", "p", "o", "iri", None)], "s string, p string, o string, o_kind string, o_datatype string")
    assert sorted(r.value for r in graph_model.n_triples(row).collect()) == ['<s> <p> "a\\"b\\n\\\\" .', "<s> <p> <o> ."]
