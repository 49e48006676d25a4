"""Registered queries of the containers: conversations written as exports and read back, with their SQL."""

from __future__ import annotations

import io
import json
import sqlite3
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps
from ..operators import agentic, extraction, incremental, linking
from ..session import ship_package
from ..sources import exports, jsonl, lines, terminal
from ..streaming import ingest, jobs
from . import graph_model
from .oracles import MESSAGES, slug, w
from .registry import scratch
from .star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BEGAN = "2025-10-16T18:58:16"


def query(sql: str) -> Callable:
    def add(function: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[function.__name__] = lambda spark, folder: function(Star(spark, folder))
        ORACLES[function.__name__] = sql
        return function

    return add


#: Turns and events whose texts one task gathers, and conversations that are made into archives at once.
TURNS, EVENTS, AT_ONCE = 50_000, 50_000, 64


def _zips(t: Star, entries: Callable[[int, list], dict[str, str]]) -> DataFrame:
    """(source, content): one zip per conversation, of the named texts that ``entries`` makes of its turns."""
    ship_package(t.spark)
    turns = t.messages().select("session", F.struct("seq", "role", "content").alias("turn")).repartition(t.tasks("conversations", TURNS), "session")
    turns = turns.groupBy("session").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE).to_pydict()
                sources, contents = [], []
                for session, listed in zip(part["session"], part["turns"], strict=True):
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w") as z:
                        for name, text in entries(session, listed).items():
                            z.writestr(name, text)
                    sources.append(f"export-{session}.zip")
                    contents.append(out.getvalue())
                yield pa.RecordBatch.from_pydict({"source": pa.array(sources, pa.string()), "content": pa.array(contents, pa.binary())})

    return turns.mapInArrow(run, "source string, content binary")


def _tree(session: int, turns: list) -> dict[str, str]:
    """A conversation as a chain of nodes below ``root``; other roles have nodes without fragments."""
    mapping = {"root": {"id": "root", "parent": None, "children": ["0"], "message": None}}
    for i, turn in enumerate(turns):
        kind = {"user": "REQUEST", "assistant": "RESPONSE"}.get(turn["role"])
        fragments = [{"type": kind, "content": turn["content"]}] if kind else []
        message = {"model": "m1", "inserted_at": f"{BEGAN}.000000+08:00", "fragments": fragments}
        mapping[str(i)] = {"id": str(i), "parent": str(i - 1) if i else "root", "children": [str(i + 1)] if i + 1 < len(turns) else [], "message": message}
    head = {"id": f"Conv {session}", "title": f"Title {session}", "inserted_at": f"{BEGAN}.107000+08:00", "updated_at": f"{BEGAN}+08:00", "mapping": mapping}
    return {"data/user.json": json.dumps({"name": f"User {session}"} if session % 2 else {}), "data/conversations.json": json.dumps([head])}


_KEPT = "role IN ('user', 'assistant') AND trim(content, ' ') != ''"
_NODE = "'ds-' || trim(regexp_replace(lower(substring('Conv ' || session, 1, 12)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || seq || '-' || role"


@query(w(MESSAGES) + f"""SELECT {slug("'Conv ' || session")} AS session, {_NODE} AS message_id, role, content, strptime('2025-10-16 10:58:16', '%Y-%m-%d %H:%M:%S') AS created,
  CASE WHEN lag(role) OVER t IN ('user', 'assistant') THEN replace({_NODE}, '-' || seq || '-' || role, '-' || (seq - 1) || '-' || lag(role) OVER t) END AS parent_id
FROM messages WINDOW t AS (PARTITION BY session ORDER BY seq) QUALIFY role IN ('user', 'assistant')""")
def a10_tree_messages(t: Star) -> DataFrame:
    """Messages of tree exports: depth-first order, global ids, parents among the messages before."""
    rows = exports.tree_messages(exports.trees(_zips(t, _tree)))
    return rows.select("session", "message_id", "role", "content", F.to_timestamp(F.substring("created", 1, 19), "yyyy-MM-dd'T'HH:mm:ss").cast("timestamp_ntz").alias("created"), "parent_id")


@query(w(MESSAGES) + f"""SELECT DISTINCT {slug("'Conv ' || session")} AS session, 'Title ' || session AS title, CASE WHEN session % 2 = 1 THEN 'User ' || session ELSE 'developer' END AS developer,
  '2025-10-16T10:58:16' AS created, 'export-' || session || '.zip' AS source_file FROM messages""")
def a12_tree_sessions(t: Star) -> DataFrame:
    """Sessions of tree exports, with the developer's name where the export has one."""
    rows = exports.tree_sessions(exports.trees(_zips(t, _tree)))
    return rows.select("session", "title", "developer", F.substring("created", 1, 19).alias("created"), "source_file")


def _listed(session: int, turns: list) -> dict[str, str]:
    when = lambda seconds: {"$date": {"$numberLong": str(1_700_000_000_000 + 1000 * seconds)}}
    responses = [{"response": {"_id": f"r-{session}-{x['seq']}", "sender": "human" if x["role"] == "user" else "ASSISTANT", "message": x["content"], "create_time": when(int(x["seq"]))}} for x in turns]
    head = {"id": f"c-{session}", "title": f"Title {session}", "create_time": when(0), "modify_time": when(session)}
    return {"a/prod-other.json": "{}", "b/prod-grok-backend.json": json.dumps({"conversations": [{"conversation": head, "responses": responses}]})}


@query(w(MESSAGES) + """SELECT 'c-' || session AS session, 'r-' || session || '-' || seq AS message_id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, content,
  strftime(make_timestamp(1700000000000000 + 1000000 * seq::BIGINT), '%Y-%m-%d %H:%M:%S') AS created,
  'r-' || session || '-' || lag(seq) OVER (PARTITION BY session ORDER BY seq) AS parent_id FROM messages WHERE trim(content, ' ') != ''""")
def a13_list_export(t: Star) -> DataFrame:
    """Messages of list exports, found by the member's suffix: linear threads, times in milliseconds."""
    rows = exports.response_messages(exports.responses(_zips(t, _listed)))
    created = F.date_format(F.to_timestamp(F.substring("created", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    return rows.select("session", "message_id", "role", "content", created.alias("created"), "parent_id")


@query("""SELECT raw, strftime(make_timestamp(1700000000000000 + 60000000 * event_id::BIGINT), '%Y-%m-%dT%H:%M:%S') AS at FROM (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"$date": {"$numberLong": "' || (1700000000000 + 60000 * event_id) || '"}}' WHEN 1 THEN '{"$date": "' || strftime(make_timestamp(1700000000000000 + 60000000 * event_id::BIGINT), '%Y-%m-%dT%H:%M:%S') || 'Z"}'
    ELSE strftime(make_timestamp(1700000000000000 + 60000000 * event_id::BIGINT), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS raw FROM events)""")
def a14_mongo_time(t: Star) -> DataFrame:
    """Times of events in the three spellings of document stores."""
    ms = F.lit(1_700_000_000_000) + F.col("tool_id") * 60_000
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("tool_id") % 3 == 0, F.concat(F.lit('{"$date": {"$numberLong": "'), ms.cast("string"), F.lit('"}}'))).when(F.col("tool_id") % 3 == 1, F.concat(F.lit('{"$date": "'), iso, F.lit('Z"}'))).otherwise(F.concat(iso, F.lit("Z")))
    return t.tool_calls().select(raw.alias("raw")).select("raw", F.substring(timestamps.mongo_time(F.col("raw")), 1, 19).alias("at"))


@query(w(MESSAGES) + """SELECT 'w-' || session AS session, message_id, content || chr(10) || 'again ' || seq AS content, CASE WHEN seq % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, '/home/' || session AS working_directory
  FROM messages WHERE seq % 4 != 3""")
def a16_sqlite_messages(t: Star) -> DataFrame:
    """Exchanges written to SQLite and read through the data source: texts of all queries; bad JSON gives none."""
    ship_package(t.spark)
    path = f"{scratch(t.spark)}/sqlite-{uuid.uuid4().hex}.db".removeprefix("file://")
    texts = F.to_json(F.array(F.struct(F.struct(F.col("content").alias("text")).alias("Query")), F.struct(F.struct(F.concat(F.lit("again "), F.col("seq").cast("string")).alias("text")).alias("Query"))))
    rows = t.messages().select(
        F.col("message_id").alias("exchange_id"), F.concat(F.lit("W "), F.col("session").cast("string")).alias("conversation_id"), F.lit("2025-01-01").alias("start_ts"), F.when(F.col("seq") % 4 == 3, "[{broken").otherwise(texts).alias("input"),
        F.concat(F.lit("/home/"), F.col("session").cast("string")).alias("working_directory"), F.lit("ok").alias("output_status"), F.concat(F.lit("m"), (F.col("seq") % 2).cast("string")).alias("model_id"),
    )

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(path) as db:
            db.execute("DROP TABLE IF EXISTS ai_queries")
            db.execute(f"CREATE TABLE ai_queries ({', '.join(x.split()[0] for x in terminal.EXCHANGE.split(', '))})")
            for batch in batches:
                db.executemany("INSERT INTO ai_queries VALUES (?, ?, ?, ?, ?, ?, ?)", batch.itertuples(index=False, name=None))
                yield pd.DataFrame({"n": [len(batch)]})

    rows.coalesce(1).mapInPandas(store, "n long").write.format("noop").mode("overwrite").save()
    return terminal.messages(terminal.read(t.spark, path, "ai_queries")).select("session", "message_id", "content", "model", "working_directory")


def _tool_files(t: Star) -> DataFrame:
    """Session files of tool uses and results, a file per user, a line each per event; lines are spelt out after events are gathered by file."""

    def use(x: Column) -> Column:
        tool = x["tool_id"].cast("string")
        return F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("u"), F.col("session").cast("string")).alias("sessionId"), F.concat(F.lit("m"), tool).alias("uuid"),
                         F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("using").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<k:long,what:string>").alias("input")),
                                          F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("t"), tool).alias("id"), F.when(x["tool_id"] % 5 != 0, x["tool_name"]).alias("name"),
                                                   F.struct(x["tool_id"].alias("k"), F.repeat(x["tool_name"], 150).alias("what")).alias("input"))).alias("content")).alias("message")))

    def result(x: Column) -> Column:
        tool = x["tool_id"].cast("string")
        return F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("u"), F.col("session").cast("string")).alias("sessionId"), F.concat(F.lit("r"), tool).alias("uuid"),
                         F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), tool).alias("tool_use_id"), F.concat(F.lit("done "), x["description"]).alias("content"))).alias("content")).alias("message")))

    source = F.concat(F.lit("inbox/u"), F.col("session").cast("string"), F.lit(".jsonl"))
    calls = t.tool_calls().select(source.alias("source"), "session", F.struct("tool_id", "tool_name", "description").alias("x")).repartition(t.tasks("events", EVENTS), "source")
    listed = calls.groupBy("source").agg(F.min("session").alias("session"), F.sort_array(F.collect_list("x")).alias("calls"))
    return listed.select("source", F.array_join(F.transform("calls", lambda x: F.concat_ws("\n", use(x), result(x))), "\n").alias("text"))


_INPUT = """'{"k": ' || event_id || ', "what": "' || repeat(event_type, 150) || '"}'"""


@query(f"""SELECT 'u' || user_id AS session, 'm' || event_id AS message_id, 't' || event_id AS tool_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS tool_name,
  CASE WHEN length({_INPUT}) > 500 THEN substring({_INPUT}, 1, 500) || '...' ELSE {_INPUT} END AS description FROM events""")
def a03_tool_calls(t: Star) -> DataFrame:
    return jsonl.tool_calls(jsonl.entries(_tool_files(t))).select("session", "message_id", "tool_id", "tool_name", "description")


@query("SELECT 't' || event_id AS tool_id, 'done ' || props AS content FROM events")
def a03_tool_results(t: Star) -> DataFrame:
    return jsonl.tool_results(jsonl.entries(_tool_files(t)))


@query("SELECT DISTINCT 'inbox/' || conv_id || '.jsonl' AS source, 'no readable user or assistant line' AS reason FROM conversations WHERE conv_id % 3 = 0")
def f02_dead_letters(t: Star) -> DataFrame:
    """Every third session file is unreadable; it becomes a dead letter and the others are read."""
    line = F.to_json(F.struct(F.lit("user").alias("type"), F.col("message_id").alias("uuid"), F.struct(F.coalesce("content", F.lit("none")).alias("content")).alias("message")))
    files = t.messages().groupBy("session").agg(F.concat_ws("\n", F.collect_list(F.when(F.col("session") % 3 == 0, "{broken").otherwise(line))).alias("text"))
    store = ingest.Store(t.spark, f"{scratch(t.spark)}/dead-{uuid.uuid4().hex}")
    ingest.process(files.select(F.concat(F.lit("inbox/"), F.col("session").cast("string"), F.lit(".jsonl")).alias("source"), "text"), store, 0)
    return store.read("dead_letter").select("source", "reason")


def _session_files(t: Star) -> DataFrame:
    """Conversations as session files: lines in order, the line before as parent, times by turn, models of assistants."""
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(
        F.col("role").alias("type"), F.concat(F.lit("Conv "), F.col("session").cast("string")).alias("sessionId"), F.col("message_id").alias("uuid"),
        F.when(F.col("seq") > 0, F.concat_ws("-", F.col("session").cast("string"), (F.col("seq") - 1).cast("string"))).alias("parentUuid"), time.alias("timestamp"),
        F.struct("content", F.when(F.col("role") == "assistant", F.concat(F.lit("m"), (F.col("session") % 3).cast("string"))).alias("model")).alias("message"),
    ))
    listed = t.messages().groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    path = F.concat(F.lit("home/projects/p"), (F.col("session") % 5).cast("string"), F.lit("/c"), F.col("session").cast("string"), F.lit(".jsonl"))
    return listed.select(path.alias("source"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


_SPOKEN = "spoken AS (SELECT *, lag(role) OVER (PARTITION BY session ORDER BY seq) AS before FROM messages)"


@query(w(MESSAGES) + f", {_SPOKEN} SELECT message_id, CASE WHEN before IN ('user', 'assistant') THEN session || '-' || (seq - 1) END AS parent_id FROM spoken WHERE role IN ('user', 'assistant')")
def a04_parent_resolution(t: Star) -> DataFrame:
    """The line before is the parent where it is a message; a parent of another kind is not there."""
    return jsonl.messages(jsonl.entries(_session_files(t))).select("message_id", "parent_id")


@query(w(MESSAGES) + """SELECT 'conv-' || session AS session, 'p' || (session % 5) AS project, strftime(make_timestamp((1700000000 + 60 * min(seq)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created,
  CASE WHEN count(*) > 1 THEN strftime(make_timestamp((1700000000 + 60 * max(seq)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS modified FROM messages WHERE role IN ('user', 'assistant') GROUP BY messages.session""")
def a05_session_bounds(t: Star) -> DataFrame:
    """First and last time of a session's lines, the last only of two or more; the project of its path."""
    return jsonl.sessions(jsonl.entries(_session_files(t))).select("session", "project", "created", "modified")


@query("SELECT 'projects/p' || (page_id % 7) || '/f' || page_id AS source, 'p' || (page_id % 7) AS project FROM pages WHERE page_id % 3 = 0")
def a06_projects(t: Star) -> DataFrame:
    """The project in a file's path, for pages as files of every third of which lies in one."""
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("projects/p"), (F.col("page_id") % 7).cast("string"), F.lit("/f"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("other/x"), F.col("page_id").cast("string")))
    return t.table("pages").select(path.alias("source")).select("source", jsonl.detect_project(F.col("source")).alias("project")).filter("project IS NOT NULL")


@query(w(MESSAGES) + "SELECT DISTINCT 'conv-' || session AS session, 'm' || (session % 3) AS model FROM messages WHERE role = 'assistant'")
def a07_models(t: Star) -> DataFrame:
    return jsonl.models(jsonl.messages(jsonl.entries(_session_files(t))))


@query(w(MESSAGES) + f"""SELECT {slug("'Conv ' || session")} AS session, count(*) AS messages, arg_min(substring(content, 1, 60), seq) AS preview FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1""")
def a20_conversation_listing(t: Star) -> DataFrame:
    """Conversations of tree exports: number of messages and the start of the first."""
    return exports.listing(exports.tree_messages(exports.trees(_zips(t, _tree)))).select("session", "messages", "preview")


@query(w(MESSAGES) + f"""SELECT message_id, CASE WHEN role = 'user' THEN 'UserMessage' ELSE 'AssistantMessage' END AS msg_class,
  CASE WHEN length(content) > 2000 THEN substring(content, 1, 2000) || '...' ELSE content END AS content FROM messages WHERE role IN ('user', 'assistant')""")
def a22_message_nodes(t: Star) -> DataFrame:
    """Class and stored content of each message's node among the statements about session files."""
    rows = jsonl.graph_rows(jsonl.entries(_session_files(t)))
    value = lambda p, name: rows.filter(F.col("p") == p).select("s", F.col("o").alias(name))
    ids, kinds, texts = value(f"{graph_model.TERM}hasMessageId", "message_id"), value(graph_model.RDF_TYPE, "kind"), value(graph_model.CONTENT, "content")
    return ids.join(kinds, "s").join(texts, "s", "left").select("message_id", F.element_at(F.split("kind", "[/#]"), -1).alias("msg_class"), "content")


@query(w(MESSAGES) + """, kept AS (SELECT *, 'w-' || session AS wsession FROM messages WHERE trim(content, ' ') != ''),
good AS (SELECT wsession FROM kept GROUP BY 1 HAVING count(*) FILTER (length(trim(content, ' ')) > 30) >= 5)
SELECT count(*) AS messages, count(DISTINCT wsession) AS sessions FROM kept SEMI JOIN good USING (wsession)""")
def a18_terminal_graph(t: Star) -> DataFrame:
    """Messages and sessions among the statements about terminal exchanges worth keeping."""
    kept = t.messages().filter(F.btrim("content") != "").select(F.concat(F.lit("w-"), F.col("session").cast("string")).alias("session"), "message_id", F.lit("user").alias("role"), "content", F.lit("2025-01-01T00:00:00Z").alias("created"), F.lit(None).cast("string").alias("model"), F.lit("/home").alias("working_directory"))
    rows = terminal.graph(kept)
    per = lambda p: F.countDistinct(F.when(F.col("p") == p, F.col("s")))
    return rows.agg(per(f"{graph_model.TERM}hasMessageId").alias("messages"), per(f"{graph_model.TERM}hasSourcePlatform").alias("sessions"))


@query("SELECT DISTINCT lower(p_name) AS label FROM part")
def a27_entity_list(t: Star) -> DataFrame:
    """Part names written as a list, a line each, with blanks around and lines between, and read back."""
    path = f"{scratch(t.spark)}/list-{uuid.uuid4().hex}"
    names = t.table("part").select(F.lower("p_name").alias("n")).distinct()
    names.select(F.concat(F.lit("  "), "n", F.lit(" \t\n  ")).alias("value")).write.text(path)
    return lines.read_entities(t.spark, path)


@query(w(MESSAGES) + "SELECT message_id, length(content) AS length, substring(content, 1, 1500) AS asked FROM messages WHERE role IN ('user', 'assistant') AND length(trim(content, ' ')) >= 30")
def b06_prompts(t: Star) -> DataFrame:
    """The texts of requests: what the model is told stands first, the message's first code points last."""
    m = extraction.extractable(t.messages()).select("message_id", "content", extraction.build_prompt(F.col("content")).alias("prompt"))
    told = m.filter(F.startswith("prompt", F.lit(extraction.PROMPT_HEAD)))
    return told.select("message_id", F.char_length("content").alias("length"), F.substring("prompt", len(extraction.PROMPT_HEAD) + 1, 1_000_000).alias("asked"))


@query(w(MESSAGES) + "SELECT 'conv-' || session AS session, message_id FROM messages WHERE role = 'assistant' AND length(trim(content, ' ')) >= 30")
def b17_extracted_sessions(t: Star) -> DataFrame:
    """Session files into a store, their assistants' messages asked about once: whom the store's cache then knows."""
    store = ingest.Store(t.spark, f"{scratch(t.spark)}/asked-{uuid.uuid4().hex}")
    for _ in range(2):
        ingest.process(_session_files(t), store, 0, provider=extraction.ScriptedProvider)
    known = store.read("cache").filter("facts IS NOT NULL").select("message_id")
    return store.current("messages").join(known, "message_id").select("session", "message_id")


@query("SELECT '/home/u/projects/p' || (page_id % 9) || '/f' || page_id AS path, '/data/p' || (page_id % 9) || '/f' || page_id AS translated FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT '/home/u/f' || page_id, '/home/u/f' || page_id FROM pages WHERE page_id % 2 != 0")
def f03_translate_paths(t: Star) -> DataFrame:
    """Paths of pages below a folder of projects, every second, as a container sees them."""
    number = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/home/u/projects/p"), (F.col("page_id") % 9).cast("string"), F.lit("/f"), number)).otherwise(F.concat(F.lit("/home/u/f"), number))
    return t.table("pages").select(path.alias("path")).select("path", incremental.translate_path(F.col("path"), "/data").alias("translated"))


@query(w(MESSAGES) + """SELECT 'conv-' || session AS session, count(*) FILTER (role IN ('user', 'assistant')) AS messages FROM messages WHERE session % 4 = 0 GROUP BY messages.session HAVING count(*) FILTER (role IN ('user', 'assistant')) > 0
  UNION ALL SELECT 'malformed job', count(DISTINCT session) FROM messages WHERE session % 4 = 1 UNION ALL SELECT 'transcript not found', count(DISTINCT session) FROM messages WHERE session % 4 = 2""")
def f01_jobs(t: Star) -> DataFrame:
    """A job for every conversation: of four, one's transcript is there, one's body is broken, one's transcript is lost, one is of a sub-agent."""
    spark, root = t.spark, f"{scratch(t.spark)}/jobs-{uuid.uuid4().hex}"
    number = F.regexp_extract("source", r"c(\d+)\.jsonl", 1).cast("long")
    files = _session_files(t).withColumn("n", number)
    files.filter("n % 4 = 0").select(F.col("text").alias("value"), F.col("n").cast("string").alias("n")).write.partitionBy("n").text(root)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"n=(\d+)/", 1).cast("long").alias("n"), "path")
    rest = files.filter("n % 4 != 0").select("n", F.concat(F.lit(root), F.when(F.col("n") % 4 == 3, "/subagents/").otherwise("/none/"), F.col("n").cast("string")).alias("path"))
    queued = there.unionByName(rest).select(
        F.col("n").alias("position"), F.lit("{}").alias("body"), F.when(F.col("n") % 4 != 1, F.col("path")).alias("transcript_path"), F.lit("").alias("session_id"), (F.col("n") % 4 == 1).alias("malformed"),
    )
    store = ingest.Store(spark, f"{root}-store")
    jobs.take(queued, store, 0)
    read = store.current("messages").groupBy("session").agg(F.count(F.lit(1)).alias("messages"))
    return read.unionByName(store.read("dead_letter").groupBy(F.col("reason").alias("session")).agg(F.count(F.lit(1)).alias("messages")))


def _round_search() -> Callable[[str], list[dict]]:
    """A search that only finds names of up to two words."""
    import hashlib

    return lambda query: [{"id": "Q" + hashlib.md5(query.encode()).hexdigest()[:8], "label": query, "description": "tool"}] if query.count(" ") < 2 else []


class _RoundJudge:
    """Takes what was found; otherwise searches the name without its first word, then without one more."""

    def generate(self, prompt: str) -> str:
        part = lambda name: prompt.split(f"{name}: ")[1].split("\n")[0]
        searched, found = part("Searched so far").split(", "), prompt.split("Found:\n- ")[1].split("\n")[0]
        if found != "nothing":
            return json.dumps({"qid": found.split(":")[0], "confidence": 1 - 0.1 * len(searched), "label": searched[-1], "description": "tool", "reasoning": "found"})
        return json.dumps({"qid": "none", "confidence": 0, "search": searched[-1].split(" ", 1)[1], "reasoning": "too long"})


@query("""WITH names AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT DISTINCT p_name || ' ' || p_type FROM part),
words AS (SELECT label, string_split(label, ' ') AS w FROM names),
settled AS (SELECT label, greatest(1, len(w) - 1) AS searches, array_to_string(w[greatest(1, len(w) - 1):], ' ') AS query FROM words)
SELECT label, CASE WHEN searches <= 3 THEN 'Q' || substring(md5(query), 1, 8) END AS qid, least(searches, 3)::INT AS searches,
  CASE WHEN searches <= 3 THEN round(10 * (1 - 0.1 * searches))::INT ELSE 0 END AS tenths FROM settled""")
def d11_rounds(t: Star) -> DataFrame:
    """Names of parts linked by rounds of search and judgement; names of five words or more stay open after three searches."""
    part = t.table("part")
    names = part.select(F.col("p_type").alias("label")).distinct().union(part.select(F.concat_ws(" ", "p_name", "p_type").alias("label")).distinct())
    store = ingest.Store(t.spark, f"{scratch(t.spark)}/rounds-{uuid.uuid4().hex}")
    rows = agentic.link_by_rounds(store, names.distinct().withColumn("context", F.lit("a part")), 0, _round_search, _RoundJudge)
    return rows.select("label", "qid", "searches", F.round(F.col("confidence") * 10).cast("int").alias("tenths"))


def _catalogue() -> Callable[[str], list[dict]]:
    """A search service that fails on names with a "q", and otherwise finds two items made of the name."""

    def find(label: str) -> list[dict]:
        if "q" in label:
            raise TimeoutError(label)
        return [{"id": f"Q{len(label)}", "label": label, "description": "software library", "aliases": [label.upper()]}, {"id": "Q1", "label": "other"}]

    return find


@query("""SELECT label AS query_label, rank::INT AS rank, CASE rank WHEN 1 THEN 'Q' || length(label) ELSE 'Q1' END AS qid, CASE rank WHEN 1 THEN label ELSE 'other' END AS label,
  CASE rank WHEN 1 THEN 'software library' END AS description, CASE rank WHEN 1 THEN upper(label) ELSE '' END AS aliases
FROM (SELECT DISTINCT p_type AS label FROM part) , (SELECT unnest([1, 2]) AS rank) WHERE NOT contains(label, 'q')""")
def d08_search(t: Star) -> DataFrame:
    """Candidates of part types from a search service; failed lookups are empty ones."""
    labels = t.table("part").select(F.col("p_type").alias("label")).distinct()
    return linking.search(labels, _catalogue).withColumn("aliases", F.array_join("aliases", "|"))
