"""Continuous ingestion of session files.

A file source offers new files; each micro-batch parses them, replaces their
sessions in the tables, sends what cannot be read to dead letters and notes the files
in the ledger, all in one change of the store (``store.py``). A batch that is replayed
after a failure replaces itself: with the stream's checkpoint this gives every file
exactly one effect. Readers see, per session, the rows of its latest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extraction
from ..operators.incremental import LEDGER_SCHEMA, changed, without_subagents
from ..sources import jsonl
from .store import Store

FILES_PER_BATCH = 1000


def process(files: DataFrame, store: Store, batch: int, refused: DataFrame | None = None, provider: Callable[[], extraction.Provider] | None = None, force: bool = False, **options) -> None:
    """One micro-batch of (source, text) rows into the store.

    ``refused``: (source, sha256, reason) of what never became a file. ``provider``: who is
    asked for facts of the sessions' messages, with ``options`` of ``extraction.extract``; the
    cache of answers is the store's, so only messages that are new or changed are asked
    about, also when a batch comes again. ``force``: read what the ledger knows too.
    """
    sources = without_subagents(files.withColumn("sha256", F.sha2("text", 256)))
    fresh = sources if force else changed(sources, store.current("ledger", LEDGER_SCHEMA, before=batch))
    fresh = fresh.select("source", "text", "sha256").persist()
    try:
        entries = jsonl.entries(fresh.select("source", "text"))
        bad = fresh.select("source", "sha256").join(entries.select("source").distinct(), "source", "left_anti").withColumn("reason", F.lit("no readable user or assistant line"))
        messages = jsonl.messages(entries)
        with store.change(batch) as change:
            change.replace(messages, "messages")
            change.replace(jsonl.sessions(entries), "sessions")
            change.append(bad if refused is None else bad.unionByName(refused), "dead_letter")
            change.replace(fresh.select("source", "sha256"), "ledger")
    finally:
        fresh.unpersist()
    if provider is not None:
        add_facts(store, batch, provider, **options)


def add_facts(store: Store, batch: int, provider: Callable[[], extraction.Provider], platform: str = "claude-code", **options) -> None:
    """Facts of the messages that ``batch`` brought, in place of those their sessions had."""
    new = store.read("messages").filter(F.col("batch") == batch)
    asked = new.filter(F.col("role").isin(*extraction.EXTRACT_ROLES[platform])).select("message_id", "session", F.col("full_text").alias("content"))
    answers = extraction.extract_into(store, asked, batch, provider, **options)
    with store.change(batch) as change:
        change.replace(extraction.facts_of(answers, asked), "facts", new.select("session").distinct())


def start(spark: SparkSession, inbox: str, store: Store, checkpoint: str, once: bool = True, files_per_batch: int = FILES_PER_BATCH, **options) -> StreamingQuery:
    """Watch ``inbox`` for session files; ``once`` takes what is there and stops. ``options``: of ``process``."""
    stream = (
        spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch)
        .load(inbox).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    )
    writer = stream.writeStream.foreachBatch(lambda df, n: process(df, store, n, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def tool_usage_windows(calls: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: uses of each tool in event-time windows; rows later than ``late`` are left out."""
    return calls.withWatermark("created", late).groupBy(F.window("created", length), "tool_name").agg(F.count(F.lit(1)).alias("uses")).select(F.col("window.start").alias("start"), "tool_name", "uses")
