"""Linking names by rounds of searching and judging.

The names still open are a table, which shrinks by round: what each asks is searched,
a judge sees the name, where it appears, and all that was found for it so far, and
either settles on an item, settles on none, or says what to search next. Names get
``ROUNDS`` searches at most; after the last the judge has to settle. Each round's table
is written to the store before the next begins, so a lost executor costs one round and
nobody is asked twice for what is written.

An item counts only if a search for that name returned it. A search that fails, or a judge
that cannot be asked or read, leaves its name failed: null, and to be asked again by a later batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import calls
from .calls import IN_FLIGHT, ConfigurationError, bucket
from .extraction import Provider

ROUNDS = 3
#: Answers of a judge that may be unreadable before its name has failed.
ATTEMPTS = 2
#: Candidates of one search that the judge sees.
SHOWN = 5
NO_CONTEXT = "an entity of a developer's knowledge graph"
ITEM = "struct<qid:string,label:string,description:string>"
OPEN = f"label string, context string, query string, searched array<string>, seen array<{ITEM}>"
VERDICT = "qid string, confidence double, item string, description string, reasoning string, next string, failed boolean"

PROMPT = (
    "Decide which catalogue item a technical name means.\nName: {name}\nContext: {context}\nSearched so far: {searched}\nFound:\n{found}\n"
    "Items on software, programming, protocols, tools and technology are likelier. Choose only among the items found, and only one whose label means the name. {next}"
    'Answer with one JSON object: {{"qid": the item\'s id or "none", "confidence": 0 to 1, "label": string, "description": string, "reasoning": string{search}}}.'
)
MAY_SEARCH = "If none fits, you may ask for another search with other or fuller words. "


def judge_prompt(name: str, context: str, searched: list[str], seen: list[dict], last: bool) -> str:
    found = "\n".join(f"- {x['qid']}: {x['label']} ({x['description'] or 'no description'})" for x in seen) or "- nothing"
    return PROMPT.format(name=name, context=context or NO_CONTEXT, searched=", ".join(searched), found=found, next="" if last else MAY_SEARCH, search="" if last else ', "search": the next words or null')


def verdict(raw: str, seen: set[str], last: bool) -> tuple | None:
    """(qid, confidence, label, description, reasoning, next search) of an answer, or None if it can't be read."""
    start, end = raw.find("{"), raw.rfind("}")
    try:
        answer = json.loads(raw[start : end + 1])
        confidence = float(answer.get("confidence") or 0.0)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None
    text = lambda k: answer.get(k) if isinstance(answer.get(k), str) else ""
    again = text("search").strip()
    if again and not last:
        return None, 0.0, "", "", text("reasoning"), again
    qid = text("qid").strip()
    if qid.lower() in ("", "none", "null", "error") or qid not in seen:
        return None, 0.0, "", "", text("reasoning"), None
    return qid, min(1.0, max(0.0, confidence)), text("label"), text("description"), text("reasoning"), None


def _searching(provider: Callable[[], Callable], rate: float | None, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, turns = None, bucket("search", rate)
        for batch in batches:
            find = find or provider()

            def one(query, find=find):
                turns.take()
                return [{"qid": x.get("id"), "label": x.get("label"), "description": x.get("description")} for x in find(query)[:SHOWN]]

            found = [(answer or [], failure is not None) for _, answer, failure in calls.in_flight(batch["query"], one, turns, most)]
            yield batch.assign(found=[f for f, _ in found], lost=[x for _, x in found])

    return run


def _judging(provider: Callable[[], Provider], last: bool, rate: float | None, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, turns = None, bucket("model", rate)
        for batch in batches:
            judge = judge or provider()

            def one(row, judge=judge):
                name, context, searched, seen, lost = row
                if lost:  # the search failed: nothing to judge by
                    return None, None, None, None, None, None, True
                items = [dict(x) if isinstance(x, dict) else x.asDict() for x in seen]
                for _ in range(ATTEMPTS):
                    turns.take()
                    try:
                        found = verdict(judge.generate(judge_prompt(name, context, list(searched), items, last)), {x["qid"] for x in items}, last)
                    except ConfigurationError:
                        raise
                    except calls.BusyError as busy:
                        turns.pause(busy.seconds)
                        continue
                    except Exception:  # costs this attempt
                        continue
                    if found is not None:
                        return (*found, False)
                return None, None, None, None, None, None, True

            rows = batch[["label", "context", "searched", "seen", "lost"]].itertuples(index=False, name=None)
            answers = [answer for _, answer, _ in calls.in_flight(rows, one, turns, most)]
            out = pd.DataFrame(answers, columns=["qid", "confidence", "item", "description", "reasoning", "next", "failed"], index=batch.index)
            yield pd.concat([batch, out], axis=1)

    return run


def link_by_rounds(store, names: DataFrame, batch: int, search: Callable[[], Callable[[str], list[dict]]], judge: Callable[[], Provider], concurrency: int | None = None, rate: float | None = None, in_flight: int = IN_FLIGHT) -> DataFrame:
    """(label, qid, confidence, description, reasoning, searches, failed) of every name of ``names`` (label, context).

    The rounds are tables ``round_1`` ... of the store, written as ``batch``.
    """
    ship_package(names.sparkSession)
    still = names.select("label", "context", F.col("label").alias("query"), F.array().cast("array<string>").alias("searched"), F.array().cast(f"array<{ITEM}>").alias("seen"))
    settled = []
    for n in range(1, ROUNDS + 1):
        asked = still.repartition(concurrency) if concurrency else still
        found = asked.mapInPandas(_searching(search, rate, in_flight), f"{OPEN}, found array<{ITEM}>, lost boolean")
        found = found.select("label", "context", "query", F.concat("searched", F.array("query")).alias("searched"), F.array_distinct(F.concat("seen", "found")).alias("seen"), "lost")
        judged = found.mapInPandas(_judging(judge, n == ROUNDS, rate, in_flight), f"{OPEN}, lost boolean, {VERDICT}").drop("lost")
        store.replace(judged, f"round_{n}", batch)
        done = store.read(f"round_{n}").filter(F.col("batch") == batch).drop("batch")
        settled.append(done.filter("next IS NULL").withColumn("searches", F.lit(n)))
        still = done.filter("next IS NOT NULL").select("label", "context", F.col("next").alias("query"), "searched", "seen")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("label", "qid", "confidence", "description", "reasoning", "searches", "failed")


def link_into(store, names: DataFrame, batch: int, search: Callable[[], Callable], judge: Callable[[], Provider], **options) -> DataFrame:
    """Names (label, context) that the link cache of ``store`` doesn't know, linked by rounds and
    written to the cache as ``batch``; what came of each. Failed names stay unknown."""
    from .linking import unknown

    open_ = unknown(store, names, batch)
    results = link_by_rounds(store, open_, batch, search, judge, **options)
    kept = results.filter("NOT failed").select(F.lower("label").alias("label"), "qid", "confidence", "description", F.array().cast("array<string>").alias("aliases"))
    store.replace(kept, "link_cache", batch)
    return results
