import io
import json
import zipfile

from tessera.__main__ import main
from tessera.operators import linking
from tessera.streaming.store import Store

TEXT = "We looked at it for long. flask uses werkzeug. That was all there is to say."


def session(path, n, text=TEXT):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"type": kind, "uuid": f"{kind}{n}", "sessionId": f"S{n}", "timestamp": f"2025-01-0{n}T00:00:00Z", "message": {"content": text}}) for kind in ("user", "assistant")))


def test_ingest_twice_and_ask(spark, tmp_path, capfd):
    for n in (1, 2):
        session(tmp_path / "in" / f"s{n}.jsonl", n)
    store = str(tmp_path / "store")
    args = ["ingest", str(tmp_path / "in"), store]
    assert main([*args, "--limit", "1"]) == 0
    assert Store(spark, store).read("ledger").count() == 1
    assert main(args) == 0 and main([*args, "--dry-run"]) == 0
    kept = Store(spark, store)
    assert kept.read("ledger").count() == 2
    assert sorted(r.session for r in kept.current("messages").select("session").distinct().collect()) == ["s1", "s2"]
    assert [(r.subj_name, r.predicate, r.obj_name) for r in kept.current("facts").collect()] == [("flask", "uses", "werkzeug")] * 2
    capfd.readouterr()
    main(["sparql", str(tmp_path / "in"), "PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX kg: <http://tessera.local/terms#> SELECT ?l WHERE { ?e a kg:Entity ; rdfs:label ?l } ORDER BY ?l", "--store", store])
    assert "werkzeug" in capfd.readouterr().out


def test_export(spark, tmp_path):
    session(tmp_path / "in" / "s1.jsonl", 1)
    main(["export", str(tmp_path / "in" / "s1.jsonl"), str(tmp_path / "out")])
    lines = [line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert len(lines) == len(set(lines)) > 15 and all(line.endswith(" .") for line in lines)
    main(["export", str(tmp_path / "in" / "s1.jsonl"), str(tmp_path / "sessions"), "--by-session"])
    assert sorted((tmp_path / "sessions" / "s1.ttl").read_text().splitlines()) == sorted(lines)


def test_link_with_a_cache(spark, tmp_path, capfd):
    """A table of candidates once; then the cache answers without it."""
    for n in (1, 2):
        session(tmp_path / "in" / f"s{n}.jsonl", n)
    store = str(tmp_path / "store")
    main(["ingest", str(tmp_path / "in"), store])
    rows = [("flask", 1, "Q1", "flask", "web framework", []), ("flask", 2, "Q2", "bottle", "a vessel tool", [])]
    spark.createDataFrame(rows, linking.CANDIDATE).write.parquet(str(tmp_path / "catalogue"))
    main(["link", store, "--catalogue", str(tmp_path / "catalogue")])
    assert "Q1" in capfd.readouterr().out
    assert {r.label: r.qid for r in Store(spark, store).current("link_cache").collect()} == {"flask": "Q1", "werkzeug": None}
    main(["link", store, "--search", "http://127.0.0.1:9"])  # nobody listens, nothing is asked
    assert [(r.label, r.qid) for r in Store(spark, store).current("links").collect()] == [("flask", "Q1")]
    main(["snapshot", store])
    (tmp_path / "names.txt").write_text("flask\n\n jinja \n")
    main(["link", store, "--catalogue", str(tmp_path / "catalogue"), "--entities", str(tmp_path / "names.txt")])
    assert Store(spark, store).current("link_cache").count() == 3


def test_force_reads_again(spark, tmp_path):
    session(tmp_path / "in" / "s1.jsonl", 1)
    store = str(tmp_path / "store")
    for more in ([], ["--force", "--skip-extraction"]):
        main(["ingest", str(tmp_path / "in"), store, *more])
    assert Store(spark, store).read("messages").count() == 4 and Store(spark, store).count("messages") == 2


def test_jobs_of_ended_sessions(spark, tmp_path, monkeypatch):
    session(tmp_path / "projects" / "s1.jsonl", 1)
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"transcript_path": str(tmp_path / "projects" / "s1.jsonl"), "session_id": "s1"})))
    main(["session-ended", str(tmp_path / "queue")])
    main(["jobs", str(tmp_path / "queue"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), "--once"])
    assert Store(spark, str(tmp_path / "store")).count("facts") == 1


def test_batch_requests_and_answers(spark, tmp_path):
    session(tmp_path / "in" / "s1.jsonl", 1)
    store = str(tmp_path / "store")
    main(["ingest", str(tmp_path / "in"), store, "--skip-extraction"])
    main(["batch", store, str(tmp_path / "requests")])
    requests = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "requests")).collect()]
    assert len(requests) == 2
    text = json.dumps([{"subject": "flask", "predicate": "uses", "object": "jinja"}])
    answers = [json.dumps({"response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}, "metadata": r["metadata"]}) for r in requests]
    (tmp_path / "answers" / "job_id=j1").mkdir(parents=True)
    (tmp_path / "answers" / "job_id=j1" / "a.txt").write_text("\n".join(answers))
    spark.createDataFrame([("j1", "succeeded", 2)], "job_id string, state string, requests long").write.parquet(str(tmp_path / "jobs"))
    main(["collect", store, str(tmp_path / "jobs"), str(tmp_path / "answers")])
    assert [r.obj_name for r in Store(spark, store).current("facts").collect()] == ["jinja"] * 2


def test_import_of_a_zip(spark, tmp_path):
    heads = [{"conversation": {"id": "c1", "title": "T", "create_time": None, "modify_time": None}, "responses": [{"response": {"_id": "r1", "sender": "human", "message": "hello", "create_time": None}}]}]
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("a/prod-grok-backend.json", json.dumps({"conversations": heads}))
    main(["import", "grok", str(tmp_path / "export.zip"), str(tmp_path / "out")])
    assert any("hello" in r.value for r in spark.read.text(str(tmp_path / "out")).collect())
