"""Sessions as JSON lines: one file per session, one object per line.

Each file is read whole and its lines are numbered, since order matters: the first
session id wins, bounds are the first and last timestamp in file order, and a
parent counts only if it came before. Malformed lines and lines of other types are
skipped. Content is a text or a list of blocks; the JSON type is looked at first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import cut, slug
from ..plans import graph_model as G

CONTENT_LENGTH = 2000
TOOL_LENGTH = 500
BLOCK = "type string, text string, id string, name string, tool_use_id string"


def find_sessions(spark: SparkSession, folder: str, include_subagents: bool = False, sort: str = "name", limit: int | None = None, with_text: bool = False) -> DataFrame:
    """(source, modified, size, sha256) of the session files below ``folder``, with their text if wanted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
    rows = files.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), *[F.decode("content", "UTF-8").alias("text")] * with_text)
    if not include_subagents:
        rows = rows.filter(~F.col("source").contains("/subagents/"))
    order = {"name": [F.col("source").asc()], "newest": [F.col("modified").desc(), F.col("source")], "oldest": [F.col("modified").asc(), F.col("source")]}[sort]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, text) of whole session files."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def detect_project(source: Column) -> Column:
    """The folder after the first ``projects`` part of a path, if a file name follows it."""
    parts = F.split(source, "/")
    at = F.array_position(parts, "projects")
    return F.when((at > 0) & (F.size(parts) >= at + 2), F.get(parts, at.cast("int")))


def entries(files: DataFrame) -> DataFrame:
    """One row per user or assistant line of (source, text) rows, numbered from 0 per file."""
    lines = files.select("source", F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(F.try_parse_json("raw").isNotNull())
    get = lambda p: F.get_json_object("raw", p)
    kept = lines.select(
        "source", "line", "raw", get("$.type").alias("role"), get("$.sessionId").alias("session_raw"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent_uuid"),
        get("$.timestamp").alias("timestamp"), get("$.message.model").alias("model"), F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.message.content", "variant")).alias("content_type"), get("$.message.content").alias("content"),
    ).filter(F.col("role").isin("user", "assistant"))
    file = Window.partitionBy("source").orderBy("line")
    numbered = kept.withColumn("seq", F.row_number().over(file) - 1)
    whole = Window.partitionBy("source")
    first_id = F.min(F.when(F.coalesce(F.col("session_raw"), F.lit("")) != "", F.struct("seq", "session_raw"))).over(whole)
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.jsonl$", "")
    blocks = F.when(F.col("content_type").startswith("ARRAY"), F.from_json("content", f"array<struct<{BLOCK}>>"))
    return (
        numbered.withColumn("session_id", F.coalesce(first_id["session_raw"], stem))
        .withColumn("message_id", F.coalesce("uuid", F.concat(F.lit("unknown-"), F.col("seq").cast("string"))))
        .withColumn("blocks", blocks)
        .withColumn("raw_blocks", F.when(F.col("content_type").startswith("ARRAY"), F.from_json("content", "array<string>")))
    )


def messages(entries: DataFrame) -> DataFrame:
    """Messages with flattened text and their parent, if it came earlier in the file."""
    texts = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    joined = F.array_join(F.filter(texts, lambda t: F.regexp_replace(t, r"(?U)\s+", "") != ""), "\n")
    plain = F.when(F.regexp_replace("content", r"(?U)\s+", "") != "", F.col("content")).otherwise("")
    full = F.when(F.col("content_type") == "STRING", plain).when(F.col("content_type").startswith("ARRAY"), joined).otherwise("")
    base = entries.select("source", "seq", "session_id", slug(F.col("session_id")).alias("session"), "message_id", "parent_uuid", "role", F.col("timestamp").alias("created"), "model", full.alias("full_text"))
    earlier = base.groupBy(F.col("source").alias("p_source"), F.col("message_id").alias("p_id")).agg(F.min("seq").alias("p_seq"))
    has_parent = (F.col("source") == F.col("p_source")) & (F.col("parent_uuid") == F.col("p_id")) & (F.col("p_seq") < F.col("seq"))
    out = base.join(earlier, has_parent, "left")
    content = F.when(F.regexp_replace("full_text", r"(?U)\s+", "") != "", cut(F.col("full_text"), CONTENT_LENGTH))
    return out.select("source", "seq", "session_id", "session", "message_id", "role", "created", "model", "full_text", content.alias("content"), F.col("p_id").alias("parent_id"))


def sessions(entries: DataFrame, platform: str = "claude-code") -> DataFrame:
    """Bounds in file order; modified only where there are two timestamps or more."""
    has_time = F.coalesce(F.col("timestamp"), F.lit("")) != ""
    agg = entries.groupBy("source", "session_id").agg(
        F.min_by("timestamp", F.when(has_time, F.col("seq"))).alias("created"), F.max_by("timestamp", F.when(has_time, F.col("seq"))).alias("last"), F.count(F.when(has_time, 1)).alias("n")
    )
    return agg.select("session_id", slug(F.col("session_id")).alias("session"), F.lit(platform).alias("platform"), "created", F.when(F.col("n") > 1, F.col("last")).alias("modified"), F.col("source").alias("source_file"), detect_project(F.col("source")).alias("project"))


def models(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'assistant' and coalesce(model, '') != ''").select("session", "model").distinct()


@F.pandas_udf(T.StringType())
def _dumped(raw: pd.Series) -> pd.Series:
    """A tool's input as Python writes JSON (", " and ": " between parts); null unless an object."""
    import json

    def one(text: str | None) -> str | None:
        if text is None:
            return "{}"
        value = json.loads(text)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return raw.map(one)


def tool_calls(entries: DataFrame) -> DataFrame:
    """Tool uses of assistants, numbered per session where they have no id."""
    used = entries.filter("role = 'assistant' and raw_blocks is not null").select("source", "seq", slug(F.col("session_id")).alias("session"), "message_id", F.col("timestamp").alias("created"), F.posexplode("raw_blocks").alias("at", "block"))
    used = used.filter(F.get_json_object("block", "$.type") == "tool_use")
    n = F.row_number().over(Window.partitionBy("source").orderBy("seq", "at"))
    return used.select(
        "session", "message_id", "created", F.coalesce(F.get_json_object("block", "$.id"), F.concat(F.lit("tool-"), n.cast("string"))).alias("tool_id"),
        F.coalesce(F.get_json_object("block", "$.name"), F.lit("unknown")).alias("tool_name"), cut(_dumped(F.get_json_object("block", "$.input")), TOOL_LENGTH).alias("description"),
    )


def tool_results(entries: DataFrame) -> DataFrame:
    found = entries.filter("raw_blocks is not null").select("source", "seq", F.posexplode("raw_blocks").alias("at", "block"))
    found = found.filter((F.get_json_object("block", "$.type") == "tool_result") & (F.coalesce(F.get_json_object("block", "$.tool_use_id"), F.lit("")) != ""))
    content = F.get_json_object("block", "$.content")
    listed = F.array_join(F.transform(F.filter(F.from_json(content, "array<struct<type string, text string>>"), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("block"), "$.content", "variant")).startswith("ARRAY"), F.lit(False))
    text = F.when(is_list, listed).otherwise(content)
    return found.select(F.get_json_object("block", "$.tool_use_id").alias("tool_id"), F.when(F.coalesce(text, F.lit("")) != "", cut(text, TOOL_LENGTH)).alias("content"))


def graph_rows(entries: DataFrame, developer: str = "developer", platform: str = "claude-code", by_session: bool = False) -> DataFrame:
    """The statements about sessions, messages, tools, models and the developer, as long rows. A set, or one per session."""
    return session_graph(sessions(entries, platform), messages(entries), developer, tool_calls(entries), tool_results(entries), by_session)


def session_graph(s: DataFrame, m: DataFrame, developer: str = "developer", calls: DataFrame | None = None, results: DataFrame | None = None, by_session: bool = False) -> DataFrame:
    """The same for the sessions and messages of any platform; columns it does not have say nothing.
    ``by_session``: with the session, and what several sessions say is said of each."""
    also = ("session",) if by_session else ()
    rows_ = partial(G._rows, also=also)
    s = s.select(*[F.col(c) if c in s.columns else F.lit(None).cast("string").alias(c) for c in ("session", "platform", "created", "modified", "source_file", "project", "title")])
    m = m.select(*[F.col(c) if c in m.columns else F.lit(None).cast("string").alias(c) for c in ("session", "message_id", "role", "created", "content", "parent_id", "model", "working_directory")])
    term = lambda x: f"{G.TERM}{x}"
    kind = lambda x: F.lit(term(x))
    dev = G.iri("developer", slug(F.lit(developer)))
    session = G.iri("session", F.col("session"))
    message = G.message_iri(F.col("message_id"))
    model = G.iri("model", slug(F.col("model")))
    project = G.iri("project", slug(F.col("project")))
    role = F.when(F.col("role") == "user", kind("UserMessage")).otherwise(kind("AssistantMessage"))
    tool = G.iri("toolcall", F.col("tool_id"))
    parts = [
        rows_(s.select("session").distinct() if by_session else s.sparkSession.range(1), dev, [(G.RDF_TYPE, kind("Developer"), "iri"), (G.LABEL, F.lit(developer), "text")]),
        rows_(s, session, [(G.RDF_TYPE, kind("Session"), "iri"), (term("hasSourcePlatform"), F.col("platform"), "text"), (G.CREATED, F.col("created"), "time"), (G.MODIFIED, F.col("modified"), "time"), (term("hasSourceFile"), F.col("source_file"), "text"), (G.ASSOCIATED, dev, "iri"), (term("belongsToProject"), project, "iri"), (G.TITLE, F.col("title"), "text")]),
        rows_(s.filter("project is not null"), project, [(G.RDF_TYPE, kind("Project"), "iri"), (G.LABEL, F.col("project"), "text")]),
        rows_(models(m), model, [(G.RDF_TYPE, kind("AIModel"), "iri"), (term("hasModel"), F.col("model"), "text"), (G.LABEL, F.col("model"), "text")]),
        rows_(models(m), session, [(G.ASSOCIATED, model, "iri")]),
        rows_(m, message, [(G.RDF_TYPE, role, "iri"), (term("hasMessageId"), F.col("message_id"), "text"), (term("usedInSession"), session, "iri"), (G.CONTAINER, session, "iri"), (G.CREATED, F.col("created"), "time"), (G.CONTENT, F.col("content"), "text"), (term("hasParentMessage"), G.message_iri(F.col("parent_id")), "iri"), (G.CREATOR, F.when(F.col("role") == "user", dev), "iri"), (term("hasWorkingDirectory"), F.col("working_directory"), "text")]),
    ]
    parts += [] if calls is None else [
        rows_(calls, tool, [(G.RDF_TYPE, kind("ToolCall"), "iri"), (term("hasToolName"), F.col("tool_name"), "text"), (term("usedInSession"), session, "iri"), (G.CREATED, F.col("created"), "time"), (G.DESCRIPTION, F.col("description"), "text")]),
        rows_(calls, message, [(term("invokedTool"), tool, "iri")]),
    ]
    if results is not None and by_session:
        results = results.join(calls.select("tool_id", "session").distinct(), "tool_id")
    parts += [] if results is None else [
        rows_(results, G.iri("toolresult", F.col("tool_id")), [(G.RDF_TYPE, kind("ToolResult"), "iri"), (G.CONTENT, F.col("content"), "text")]),
        rows_(results, tool, [(term("hasToolResult"), G.iri("toolresult", F.col("tool_id")), "iri")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


@dataclass(frozen=True)
class SourceParser:
    """What a platform brings: entries of (source, text) rows, and sessions and messages of entries."""

    platform: str
    entries: Callable[[DataFrame], DataFrame]
    sessions: Callable[[DataFrame], DataFrame]
    messages: Callable[[DataFrame], DataFrame]


PARSER = SourceParser("claude-code", entries, sessions, messages)
