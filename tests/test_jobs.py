import json
import os
import threading
import time

import pytest

from tessera.operators import extraction
from tessera.streaming import ingest, jobs
from tessera.streaming.store import Store

TEXT = "We looked at it for long. flask uses werkzeug. That was all there is to say."


def line(kind, n, text):
    return json.dumps({"type": kind, "uuid": f"u{n}{kind}", "sessionId": f"S{n}", "message": {"content": text}})


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "projects" / "p").mkdir(parents=True)
    return tmp_path


def transcript(place, n, text=TEXT):
    path = place / "projects" / "p" / f"s{n}.jsonl"
    path.write_text(line("user", n, "hello") + "\n" + line("assistant", n, text))
    return str(path)


def job(path, session=""):
    return json.dumps({"transcript_path": path, "session_id": session})


def run(spark, place, store, **options):
    jobs.start(spark, str(place / "queue"), store, str(place / "checkpoint"), **options).awaitTermination()


def test_numbers_have_no_gaps(tmp_path):
    threads = [threading.Thread(target=lambda: [jobs.publish(str(tmp_path), "{}") for _ in range(20)]) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert jobs._numbers(tmp_path) == list(range(100)) and len(os.listdir(tmp_path)) == 100


def test_what_a_hook_queues(tmp_path):
    path = tmp_path / "s1.jsonl"
    path.write_text("{}")
    ended = lambda **k: jobs.session_ended(str(tmp_path / "queue"), json.dumps(k), str(tmp_path))
    assert ended(session_id="s1") is None and ended(transcript_path=str(tmp_path / "none.jsonl")) is None
    (tmp_path / "subagents").mkdir()
    (tmp_path / "subagents" / "x.jsonl").write_text("{}")
    assert ended(transcript_path=str(tmp_path / "subagents" / "x.jsonl")) is None
    assert ended(transcript_path=str(path), session_id="a") == 0
    output = tmp_path / "s1.ttl"
    output.write_text("")
    os.utime(output, (time.time() + 60,) * 2)
    assert ended(transcript_path=str(path)) is None  # the output is newer
    os.utime(path, (time.time() + 120,) * 2)
    assert ended(transcript_path=str(path)) == 1


def test_jobs_into_the_store(spark, place):
    """Missing, malformed, sub-agents' and unchanged jobs; facts of what changed alone are asked for."""
    store, queue = Store(spark, str(place / "store")), str(place / "queue")
    first, second = transcript(place, 1), transcript(place, 2)
    for body in (job(first, "s1"), "{broken", job(str(place / "projects" / "none.jsonl")), job(""), job(str(place / "projects" / "subagents" / "x.jsonl")), job(first), "[1]", job(second)):
        jobs.publish(queue, body)
    run(spark, place, store, provider=extraction.ScriptedProvider)
    assert sorted(r.session for r in store.current("sessions").collect()) == ["s1", "s2"]
    dead = sorted((r.source.rsplit("/", 1)[1], r.reason) for r in store.read("dead_letter").collect())
    assert dead == [("1", "malformed job"), ("6", "malformed job"), ("none.jsonl", "transcript not found")]
    assert store.count("facts") == 2
    run(spark, place, store)  # nothing new
    jobs.publish(queue, job(first, "s1"))
    transcript(place, 2, TEXT.replace("werkzeug", "jinja"))
    jobs.publish(queue, job(second))
    asked = place / "asked"
    asked.mkdir()
    folder = str(asked)

    def counting():
        class Counting(extraction.ScriptedProvider):
            def generate(self, prompt):
                import tempfile

                tempfile.mkstemp(dir=folder)
                return super().generate(prompt)

        return Counting()

    run(spark, place, store, provider=counting)
    assert sorted(r.obj_name for r in store.current("facts").collect()) == ["jinja", "werkzeug"]
    assert len(os.listdir(asked)) == 1  # the unchanged session is not asked about again
    assert sorted(r.batch for r in store.read("ledger").collect()) == [0, 0, 1]


def test_a_restart_loses_and_repeats_nothing(spark, place, monkeypatch):
    """A batch that fails after it wrote is taken again, with the same jobs, and replaces itself."""
    store, queue = Store(spark, str(place / "store")), str(place / "queue")
    for n in (1, 2):
        jobs.publish(queue, job(transcript(place, n)))
    facts = ingest.add_facts

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ingest, "add_facts", lost)
    with pytest.raises(Exception, match="executor lost"):
        run(spark, place, store, provider=extraction.ScriptedProvider)
    assert jobs._numbers(place / "queue") == [0, 1] and store.count("messages") == 4
    jobs.publish(queue, job(transcript(place, 3)))
    monkeypatch.setattr(ingest, "add_facts", facts)
    for _ in range(2):  # the first may take the failed batch alone
        run(spark, place, store, provider=extraction.ScriptedProvider)
    assert store.count("messages") == 6 and store.read("messages").count() == 6
    assert sorted(r.session for r in store.current("facts").collect()) == ["s1", "s2", "s3"]


def test_acknowledged_jobs_go(tmp_path):
    for _ in range(5):
        jobs.publish(str(tmp_path), "{}")
    reader = jobs.JobReader({"path": str(tmp_path)})
    assert reader.initialOffset() == {"next": 0} and reader.latestOffset() == {"next": 5}
    reader.commit({"next": 3})
    assert jobs._numbers(tmp_path) == [2, 3, 4]
    reader.commit({"next": 5})
    assert jobs._numbers(tmp_path) == [4] and reader.latestOffset() == {"next": 5} and jobs.publish(str(tmp_path), "{}") == 5
    assert [r[0] for p in reader.partitions({"next": 4}, {"next": 6}) for r in reader.read(p)] == [4, 5]


def test_the_folder_of_projects_is_elsewhere(spark, place):
    store = Store(spark, str(place / "store"))
    transcript(place, 1)
    jobs.publish(str(place / "queue"), job("/home/someone/.tool/projects/p/s1.jsonl"))
    run(spark, place, store, container=str(place / "projects"))
    assert store.count("messages") == 2


def test_watch_extracts_and_replay_asks_nothing(spark, place):
    """Files watched are extracted; a batch taken again asks nobody."""

    def forbidden():
        raise AssertionError("asked again")

    store = Store(spark, str(place / "store"))
    transcript(place, 1)
    ingest.start(spark, str(place / "projects"), store, str(place / "checkpoint"), provider=extraction.ScriptedProvider).awaitTermination()
    assert [(r.subj_name, r.obj_name) for r in store.current("facts").collect()] == [("flask", "werkzeug")]
    before = store.current("cache").filter("facts IS NOT NULL").count()
    new = store.read("messages").filter("batch = 0 AND role = 'assistant'").selectExpr("message_id", "session", "full_text AS content")
    assert extraction.extract_into(store, new, 1, forbidden).count() == before == 1
