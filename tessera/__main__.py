"""Command line: ``python -m tessera COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agentic, batches, extraction, linking
from .operators.hosted import catalogue_search
from .operators.incremental import LEDGER_SCHEMA, changed
from .plans import graph_model
from .plans.sparql import encoded, sparql, stored
from .session import local_session, scratch
from .sources import exports, jsonl, lines, session_files, terminal
from .streaming import jobs
from .streaming.ingest import process, start
from .streaming.store import Store


def model(command: argparse.ArgumentParser) -> None:
    command.add_argument("--skip-extraction", action="store_true", help="do not ask a provider for facts")
    command.add_argument("--provider", default="scripted", help="who is asked for facts: scripted (offline), auto (by the settings), or a service's name")
    command.add_argument("--rate", type=float, help="requests a second of each task")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description="Session knowledge graph on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read session files that are new or changed into a store")
    ingest.add_argument("folder")
    ingest.add_argument("store")
    ingest.add_argument("--limit", type=int, help="read so many files at most")
    ingest.add_argument("--sort", choices=("name", "newest", "oldest"), default="name")
    ingest.add_argument("--include-subagents", action="store_true")
    ingest.add_argument("--force", action="store_true", help="read files the ledger knows too")
    ingest.add_argument("--dry-run", action="store_true", help="only list what would be read")
    model(ingest)
    watch = commands.add_parser("watch", help="keep reading session files as they arrive")
    watch.add_argument("inbox")
    watch.add_argument("store")
    watch.add_argument("checkpoint")
    watch.add_argument("--once", action="store_true", help="take what is there and stop")
    model(watch)
    jobs_ = commands.add_parser("jobs", help="work on the jobs of a queue that a hook fills as sessions end")
    jobs_.add_argument("queue")
    jobs_.add_argument("store")
    jobs_.add_argument("checkpoint")
    jobs_.add_argument("--once", action="store_true", help="take what is there and stop")
    jobs_.add_argument("--container", help="where the folder of projects is mounted, if not where the hook saw it")
    model(jobs_)
    ended = commands.add_parser("session-ended", help="queue a job for a finished session; its description comes as JSON on standard input")
    ended.add_argument("queue")
    ended.add_argument("--outputs", help="folder of the sessions' files: none is queued whose file is newer")
    link = commands.add_parser("link", help="link the entities of a store's facts, or of a list, to items of a catalogue")
    link.add_argument("store")
    link.add_argument("--catalogue", help="Parquet table of candidates (query_label, rank, qid, ...)")
    link.add_argument("--search", help="address of a catalogue's search service, asked where no table is given")
    link.add_argument("--entities", help="text file of names, a line each, in place of the store's")
    link.add_argument("--agentic", action="store_true", help="let the provider judge what is found, in rounds")
    link.add_argument("--min-sessions", type=int, default=linking.MIN_SESSIONS)
    link.add_argument("--threshold", type=float, default=linking.CONFIDENCE)
    link.add_argument("--provider", default="auto")
    link.add_argument("--rate", type=float, help="requests a second of each task")
    snapshot = commands.add_parser("snapshot", help="counts of a store's links")
    snapshot.add_argument("store")
    batch = commands.add_parser("batch", help="write requests about a store's messages for an offline batch run")
    batch.add_argument("store")
    batch.add_argument("out")
    collected = commands.add_parser("collect", help="read the answers of finished batch jobs into a store")
    collected.add_argument("store")
    collected.add_argument("jobs", help="Parquet table of jobs: job_id, state, requests")
    collected.add_argument("answers", help="folder with a folder job_id=... of lines for each job")
    imported = commands.add_parser("import", help="read the exports of other platforms into a store's statements")
    imported.add_argument("platform", choices=("deepseek", "grok", "warp"))
    imported.add_argument("source", help="zips, or a terminal's database")
    imported.add_argument("out")
    imported.add_argument("--developer", default="developer")
    imported.add_argument("--min-exchanges", type=int, default=terminal.MIN_EXCHANGES)
    listing = commands.add_parser("list", help="conversations of a zipped tree export")
    listing.add_argument("zip")
    export = commands.add_parser("export", help="write the statements about session files as N-Triples")
    export.add_argument("files")
    export.add_argument("out")
    export.add_argument("--developer", default="developer")
    export.add_argument("--by-session", action="store_true", help="a file per session, which replaces the session's former one")
    ask = commands.add_parser("sparql", help="run a SELECT over the statements about session files and a store's facts")
    ask.add_argument("files")
    ask.add_argument("query")
    ask.add_argument("--store")
    return parser


def asking(options: argparse.Namespace) -> dict:
    """Who is asked for facts, if anyone: never an outside service unless it is named."""
    if options.skip_extraction:
        return {}
    return {"provider": extraction.get_provider(None if options.provider == "auto" else options.provider), "rate": options.rate}


def read_new(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """The session files to read: found, in order, less what the ledger knows, up to the limit."""
    store = Store(spark, options.store)
    found = jsonl.find_sessions(spark, options.folder, options.include_subagents, options.sort, with_text=True)
    if not options.force:
        found = changed(found, store.current("ledger", LEDGER_SCHEMA))
    order = {"name": [F.col("source")], "newest": [F.col("modified").desc(), F.col("source")], "oldest": [F.col("modified"), F.col("source")]}[options.sort]
    found = found.orderBy(*order)
    return found.limit(options.limit) if options.limit is not None else found


def ingest(spark: SparkSession, options: argparse.Namespace) -> int:
    store = Store(spark, options.store)
    found = read_new(spark, options)
    if options.dry_run:
        found.select("source", "size").show(1000, truncate=False)
        return 0
    process(found.select("source", "text"), store, store.next_batch(), force=options.force, **asking(options))
    return 0


def link(spark: SparkSession, options: argparse.Namespace) -> int:
    """Names linked through the store's cache; its link table becomes what the cache then holds."""
    store = Store(spark, options.store)
    batch = store.next_batch()
    facts = None if options.entities else store.current("facts")
    names = lines.read_entities(spark, options.entities).distinct() if options.entities else linking.link_names(facts, options.min_sessions)
    if options.agentic:
        told = names.withColumn("context", F.lit(agentic.NO_CONTEXT)) if facts is None else names.join(linking.contexts(facts).withColumnRenamed("label", "lowered"), F.lower("label") == F.col("lowered"), "left").drop("lowered")
        agentic.link_into(store, told, batch, catalogue_search(options.search), extraction.get_provider(None if options.provider == "auto" else options.provider), rate=options.rate)
    else:
        found = spark.read.parquet(options.catalogue) if options.catalogue else None
        linking.search_into(store, names, batch, None if options.catalogue else catalogue_search(options.search), found, rate=options.rate)
    links, counts = linking.cached_links(store, names, options.threshold)
    with store.change(batch) as change:
        change.overwrite(links, "links")
    store.current("links").orderBy("label").show(1000, truncate=False)
    if not options.agentic:
        linking.ambiguity_report(store.current("candidates").filter("rank IS NOT NULL")).show(100, truncate=False)
    counts.show()
    return 0


def other_platform(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """The statements about another platform's export."""
    if options.platform == "deepseek":
        return exports.tree_graph(exports.trees(exports.read_zips(spark, options.source)), options.developer)
    if options.platform == "grok":
        return exports.response_graph(exports.responses(exports.read_zips(spark, options.source)), options.developer)
    return terminal.graph(terminal.messages(terminal.read(spark, options.source, "ai_queries")), options.developer, options.min_exchanges)


def main(args: list[str] | None = None) -> int:
    options = arguments().parse_args(args)
    if options.command == "session-ended":  # a hook's: no Spark
        jobs.session_ended(options.queue, sys.stdin.read(), options.outputs)
        return 0
    spark = SparkSession.getActiveSession() or local_session()
    if options.command == "ingest":
        return ingest(spark, options)
    if options.command == "link":
        return link(spark, options)
    if options.command == "jobs":
        jobs.start(spark, options.queue, Store(spark, options.store), options.checkpoint, options.once, options.container, **asking(options)).awaitTermination()
        return 0
    if options.command == "collect":
        store = Store(spark, options.store)
        messages = store.current("messages").select("message_id", "session", F.col("full_text").alias("content"))
        answers = spark.read.schema("value string, job_id string").text(options.answers)
        batches.collect_jobs(store, spark.read.parquet(options.jobs), answers, messages, store.next_batch()).show(1000, truncate=False)
        return 0
    if options.command == "import":
        graph_model.n_triples(other_platform(spark, options)).write.text(options.out)
        return 0
    if options.command == "snapshot":
        links = Store(spark, options.store).current("links")
        links.agg(F.count(F.lit(1)).alias("linked"), F.countDistinct("qid").alias("items"), (F.count(F.lit(1)) - F.countDistinct("qid")).alias("duplicates")).show()
        return 0
    if options.command == "batch":
        messages = extraction.extractable(Store(spark, options.store).current("messages").withColumnRenamed("source", "source_file"))
        batches.request_lines(messages).write.text(options.out)
        return 0
    if options.command == "watch":
        start(spark, options.inbox, Store(spark, options.store), options.checkpoint, once=options.once, **asking(options)).awaitTermination()
        return 0
    if options.command == "list":
        exports.listing(exports.tree_messages(exports.trees(exports.read_zips(spark, options.zip)))).show(1000, truncate=60)
        return 0
    entries = jsonl.entries(jsonl.read_files(spark, options.files))
    if options.command == "export" and options.by_session:
        session_files.write(jsonl.graph_rows(entries, options.developer, by_session=True), options.out)
        return 0
    rows = jsonl.graph_rows(entries, getattr(options, "developer", "developer"))
    if options.command == "export":
        graph_model.n_triples(rows).write.text(options.out)
        return 0
    if options.store:
        rows = rows.unionByName(graph_model.fact_rows(Store(spark, options.store).current("facts")))
    terms = stored(encoded(rows), f"{scratch(spark)}/terms-{uuid.uuid4().hex}")
    sparql(terms, options.query).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
