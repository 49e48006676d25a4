import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction
from tessera.sources import jsonl, session_files, stored_graphs
from tessera.streaming.store import Store

TEXT = "We looked at it for long. flask uses werkzeug. That was all there is to say."


def files(spark, texts):
    def lines(n, text):
        use = {"type": "tool_use", "id": f"t{n}", "name": "grep", "input": {}}
        return [
            {"type": "user", "uuid": f"u{n}", "sessionId": f"S {n}", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": text}},
            {"type": "assistant", "uuid": f"a{n}", "parentUuid": f"u{n}", "sessionId": f"S {n}", "timestamp": "2025-01-01T00:01:00Z", "message": {"content": [use, {"type": "text", "text": 'so "said"\nit'}], "model": "m1"}},
            {"type": "user", "uuid": f"r{n}", "sessionId": f"S {n}", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{n}", "content": "done"}]}},
        ]

    return spark.createDataFrame([(f"in/s{n}.jsonl", "\n".join(map(json.dumps, lines(n, t)))) for n, t in texts], "source string, text string")


def test_a_file_per_session(spark, tmp_path):
    entries = jsonl.entries(files(spark, [(1, "one"), (2, "two")]))
    rows = jsonl.graph_rows(entries, by_session=True)
    session_files.write(rows, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s-1.ttl", "s-2.ttl"]
    read, refused = stored_graphs.read_turtle(spark, str(tmp_path / "*.ttl"))
    all_rows = jsonl.graph_rows(entries)
    assert {tuple(r)[:4] for r in read.select("s", "p", "o", "o_kind").collect()} == {tuple(r)[:4] for r in all_rows.select("s", "p", "o", "o_kind").collect()}
    assert refused.count() == 0
    # a session that comes again replaces its file alone
    before = (tmp_path / "s-1.ttl").read_text()
    session_files.write(jsonl.graph_rows(jsonl.entries(files(spark, [(2, "changed")])), by_session=True), str(tmp_path))
    assert "changed" in (tmp_path / "s-2.ttl").read_text() and '"two"' not in (tmp_path / "s-2.ttl").read_text()
    assert (tmp_path / "s-1.ttl").read_text() == before


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 200, 1, 4).select(
        F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("session"), F.lit("http://x/s").alias("s"), F.lit("http://x/p").alias("p"),
        F.when(F.col("id") == 199, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"),
    )
    with pytest.raises(Exception, match="lost"):
        session_files.write(rows, str(tmp_path))
    assert [p for p in tmp_path.rglob("*.ttl")] == []
    session_files.write(rows.filter("session != 's49'"), str(tmp_path))
    assert len(list(tmp_path.glob("*.ttl"))) == 49 and not [p for p in tmp_path.iterdir() if p.suffix != ".ttl"]
    assert (tmp_path / "s3.ttl").read_text().count("\n") == 4


def test_counters_equal_a_plain_count(spark, tmp_path):
    class Odd:
        """Cut off once for texts with a dollar, never readable for those with a percent sign."""

        def __init__(self):
            self.met = set()

        def generate(self, prompt):
            text = prompt.rpartition("TEXT:\n")[2]
            if "%" in text:
                return "no"
            if "$" in text and text not in self.met:
                self.met |= {text, text[:800]}
                return "[{"
            return extraction.ScriptedProvider().generate(prompt)

    texts = [TEXT, TEXT + " $", TEXT + " %", TEXT + " $ %", "short"]
    m = spark.createDataFrame([(f"m{i}", "s", t) for i, t in enumerate(texts)], "message_id string, session string, content string")
    store = Store(spark, str(tmp_path))
    out = extraction.extract_into(store, m, 0, Odd)
    counted = {r.name: r.n for r in store.current("counters").collect()}
    plain = out.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("facts").isNull()).alias("failed"), F.sum("truncations").alias("truncated"), F.sum(F.size("facts")).alias("facts")).first().asDict()
    plain["facts"] = sum(len(r.facts or []) for r in out.collect())
    assert counted == plain == {"asked": 4, "failed": 2, "truncated": 1, "facts": 2}
    extraction.extract_into(store, m, 1, extraction.ScriptedProvider)
    assert {r.name: r.n for r in store.read("counters").filter("batch = 1").collect()} == {"asked": 2, "failed": 0, "truncated": 0, "facts": 2}
