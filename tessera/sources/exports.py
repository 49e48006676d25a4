"""Sessions in zipped exports: trees of nodes, and lists of responses.

A container is opened in Python (there is no zip reader in Spark); what comes out
are rows, and everything after is column expressions. A tree is walked per
conversation, since children's order and depth are unbounded.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import slug
from ..functions.timestamps import mongo_time, utc_seconds
from ..session import ship_package
from .jsonl import session_graph

TREE = "source string, user_name string, session_id string, title string, inserted_at string, updated_at string, seq int, node_id string, parent_node string, role string, content string, model string, timestamp string"
LISTED = "source string, conv_index int, session_id string, title string, create_time string, modify_time string, seq int, response_id string, sender string, content string, response_time string, model string"


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")


def member(archive: bytes, suffix: str) -> str | None:
    """The text of the first entry whose name ends with ``suffix``."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        name = next((n for n in z.namelist() if n.endswith(suffix)), None)
        return None if name is None else z.read(name).decode("utf-8")


def walk(mapping: dict) -> list[dict]:
    """Messages of a conversation tree in depth-first order, without recursion.

    A node gives a user message, an assistant message, or both, the second then
    following the first. Other fragments and nodes only pass their place on.
    """
    start = "root" if "root" in mapping else next((k for k, n in mapping.items() if n.get("parent") is None), None)
    stack = [(start, None)] if start is not None else []
    out: list[dict] = []
    while stack:
        node_id, parent = stack.pop()
        node = mapping.get(node_id)
        if node is None:
            continue
        message = node.get("message") or {}
        texts: dict[str, list[str]] = {"user": [], "assistant": []}
        for fragment in message.get("fragments") or []:
            role = {"REQUEST": "user", "RESPONSE": "assistant", "THINK": "assistant"}.get(fragment.get("type", ""))
            if role and fragment.get("content"):
                texts[role].append(fragment["content"])
        above = parent
        for role in ("user", "assistant"):
            if texts[role]:
                here = f"{node_id}-{role}"
                out.append({"node_id": here, "parent_node": above, "role": role, "content": "\n".join(texts[role]), "model": message.get("model"), "timestamp": message.get("inserted_at")})
                above = here
        stack += [(child, node_id) for child in reversed(node.get("children") or [])]
    return out


def trees(zips: DataFrame) -> DataFrame:
    """Messages of tree exports (user.json and conversations.json)."""
    ship_package(zips.sparkSession)
    names = [x.split()[0] for x in TREE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                user, listed = member(content, "user.json"), member(content, "conversations.json")
                name = (json.loads(user) if user else {}).get("name") or None
                for conversation in json.loads(listed) if listed else []:
                    head = (source, name, conversation.get("id", "unknown"), conversation.get("title"), conversation.get("inserted_at"), conversation.get("updated_at"))
                    rows = [(*head, i, *(m[k] for k in names[7:])) for i, m in enumerate(walk(conversation.get("mapping") or {}))]
                    yield pd.DataFrame(rows or [(*head, *[None] * 7)], columns=names).astype({"seq": "Int32"})

    return zips.mapInPandas(run, TREE)


def tree_sessions(rows: DataFrame, developer: str = "developer") -> DataFrame:
    return rows.select("session_id", slug(F.col("session_id")).alias("session"), F.lit("deepseek").alias("platform"), utc_seconds(F.col("inserted_at")).alias("created"), utc_seconds(F.col("updated_at")).alias("modified"), "title", F.col("source").alias("source_file"), F.coalesce("user_name", F.lit(developer)).alias("developer")).distinct()


def tree_messages(rows: DataFrame) -> DataFrame:
    """Messages with global ids; a parent is the node itself, its assistant or its user message, if emitted earlier."""
    base = rows.filter("seq is not null")
    prefix = F.concat(F.lit("ds-"), slug(F.substring("session_id", 1, 12)), F.lit("-"))
    out = base
    emitted = base.groupBy(F.col("source").alias("e_source"), F.col("session_id").alias("e_session"), F.col("node_id").alias("e_id")).agg(F.min("seq").alias("e_seq"))
    for i, suffix in enumerate(("", "-assistant", "-user")):
        side = emitted.select(*[F.col(c).alias(f"{c}{i}") for c in emitted.columns])
        found = (F.col("source") == F.col(f"e_source{i}")) & (F.col("session_id") == F.col(f"e_session{i}")) & (F.concat(F.col("parent_node"), F.lit(suffix)) == F.col(f"e_id{i}")) & (F.col(f"e_seq{i}") < F.col("seq"))
        out = out.join(side, found, "left")
    parent = F.coalesce("e_id0", "e_id1", "e_id2")
    return out.select(slug(F.col("session_id")).alias("session"), "seq", F.concat(prefix, F.col("node_id")).alias("message_id"), "role", F.when(F.btrim("content") != "", F.col("content")).alias("content"), utc_seconds(F.col("timestamp")).alias("created"), "model", F.concat(prefix, parent).alias("parent_id"))


def responses(zips: DataFrame, suffix: str = "prod-grok-backend.json") -> DataFrame:
    """Responses of list exports, in order."""
    ship_package(zips.sparkSession)
    names = [x.split()[0] for x in LISTED.split(", ")]
    text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                found = member(content, suffix)
                for i, entry in enumerate((json.loads(found) if found else {}).get("conversations", [])):
                    c = entry.get("conversation", {})
                    head = (source, i, c.get("id") or f"grok-{i}", c.get("title"), text(c.get("create_time")), text(c.get("modify_time")))
                    rows = []
                    for j, item in enumerate(entry.get("responses", [])):
                        r = item.get("response", {})
                        model = ((r.get("metadata") or {}).get("requestModelDetails") or {}).get("modelId")
                        rows.append((*head, j, r.get("_id") or f"grok-msg-{head[2]}-{j}", r.get("sender"), r.get("message") or "", text(r.get("create_time")), model))
                    yield pd.DataFrame(rows or [(*head, *[None] * 6)], columns=names).astype({"conv_index": "int32", "seq": "Int32"})

    return zips.mapInPandas(run, LISTED)


def response_sessions(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", slug(F.col("session_id")).alias("session"), F.lit("grok").alias("platform"), mongo_time(F.col("create_time")).alias("created"), mongo_time(F.col("modify_time")).alias("modified"), "title", F.col("source").alias("source_file")).distinct()


def response_messages(rows: DataFrame) -> DataFrame:
    """A linear thread: each message follows the one before."""
    kept = rows.filter(F.col("seq").isNotNull() & (F.btrim("content") != ""))
    before = F.lag("response_id").over(Window.partitionBy("source", "conv_index").orderBy("seq"))
    return kept.select(slug(F.col("session_id")).alias("session"), "seq", F.col("response_id").alias("message_id"), F.when(F.col("sender") == "human", "user").otherwise("assistant").alias("role"), "content", mongo_time(F.col("response_time")).alias("created"), "model", before.alias("parent_id"))


def listing(messages: DataFrame, preview: int = 60) -> DataFrame:
    """Conversations with their number of messages, first and last time and the start of the first text."""
    return messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.min("created").alias("first_at"), F.max("created").alias("last_at"), F.substring(F.min_by("content", "seq"), 1, preview).alias("preview")).orderBy("session")


def tree_graph(rows: DataFrame, developer: str = "developer") -> DataFrame:
    """The statements about tree exports, as long rows."""
    return session_graph(tree_sessions(rows, developer), tree_messages(rows), developer)


def response_graph(rows: DataFrame, developer: str = "developer") -> DataFrame:
    """The statements about list exports, as long rows."""
    return session_graph(response_sessions(rows), response_messages(rows), developer)
