"""Linking entity names to catalogue items, as one plan over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entities import has_tech_keyword, is_linkable_entity, normalize_label, strip
from ..session import ship_package
from . import calls
from .calls import IN_FLIGHT, bucket

MIN_SESSIONS = 2
CONFIDENCE = 0.7
CONTEXT_FACTS = 5
KEPT_ALIASES = 5
KEPT_OTHERS = 3
CANDIDATE = T.StructType([T.StructField("query_label", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("qid", T.StringType()), T.StructField("label", T.StringType()), T.StructField("description", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])


def label_sources(facts: DataFrame, source: str = "session", tasks: int | None = None) -> DataFrame:
    """(label, sources): in how many sources each entity label occurs, in either role; sources are dealt to ``tasks`` tasks, if given."""
    named = facts.select(F.col(source).alias("source"), "subj_name", "obj_name")
    named = named.repartition(tasks, "source") if tasks else named
    roles = named.select("source", F.explode(F.array("subj_name", "obj_name")).alias("label")).distinct()
    return roles.groupBy("label").agg(F.count(F.lit(1)).alias("sources"))


def canonical_sources(labels: DataFrame) -> DataFrame:
    """Per canonical name the largest count among its labels (not their sum)."""
    return labels.select(normalize_label(F.col("label")).alias("canonical"), "sources").groupBy("canonical").agg(F.max("sources").alias("sources"))


def frequent(labels: DataFrame, minimum: int = MIN_SESSIONS) -> DataFrame:
    return canonical_sources(labels).filter(F.col("sources") >= minimum)


def contexts(facts: DataFrame, keep: int = CONTEXT_FACTS) -> DataFrame:
    """(label, context): for each lower-cased label its first facts in order, as a phrase."""
    text = F.concat_ws(" ", strip(F.col("subj_name")), "predicate", strip(F.col("obj_name")))
    # the same fact of many messages is one before it is spelt out
    said = facts.select("subj_name", "predicate", "obj_name").distinct()
    roles = said.select(text.alias("fact"), F.explode(F.array(F.lower(strip(F.col("subj_name"))), F.lower(strip(F.col("obj_name"))))).alias("label")).filter("label != ''").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("fact"))
    first = roles.withColumn("place", place).filter(F.col("place") <= keep)
    quoted = F.transform(F.sort_array(F.collect_list("fact")), lambda f: F.concat(F.lit('"'), f, F.lit('"')))
    return first.groupBy("label").agg(F.concat(F.lit("appears in facts: "), F.array_join(quoted, ", ")).alias("context"))


def cache_split(labels: DataFrame, cache: DataFrame) -> DataFrame:
    """(label, qid, cached): a row of the cache counts as known even if it holds no item."""
    known = cache.select(F.col("label").alias("cache_label"), "qid", "confidence", F.lit(True).alias("hit"))
    joined = labels.join(known, F.lower("label") == F.col("cache_label"), "left")
    return joined.select("label", "qid", "confidence", F.coalesce("hit", F.lit(False)).alias("cached"))


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates with tier (exact label, alias, keyword, other) and confidence."""
    name = F.lower("query_label")
    exact = F.lower("label") == name
    alias = F.exists("aliases", lambda a: F.lower(a) == name)
    tech = has_tech_keyword(F.col("description"))
    tier = F.when(exact, 1).when(F.coalesce(alias, F.lit(False)), 2).when(tech, 3).otherwise(4)
    confidence = F.when(exact, 1.0).when(tech, 0.8).otherwise(0.5)
    return candidates.withColumn("tier", tier).withColumn("confidence", confidence).withColumn("tech", tech)


def best_match(candidates: DataFrame) -> DataFrame:
    """The best candidate of each label: by tier, then rank; with its confidence and first aliases."""
    order = Window.partitionBy("query_label").orderBy("tier", "rank")
    best = scored(candidates).withColumn("place", F.row_number().over(order)).filter("place = 1")
    return best.select("query_label", "qid", "label", "description", "confidence", F.slice("aliases", 1, KEPT_ALIASES).alias("aliases"))


def ambiguous(candidates: DataFrame) -> DataFrame:
    """Labels with more than one technical candidate, and their items by rank."""
    tech = scored(candidates).filter("tech").groupBy("query_label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "qid"))), lambda x: x["qid"]).alias("qids"))
    return tech.filter(F.size("qids") > 1)


def ambiguity_report(candidates: DataFrame, keep: int = KEPT_OTHERS) -> DataFrame:
    """(query_label, selected, others): the selected item of each ambiguous label and the first other ones."""
    chosen = best_match(candidates).select("query_label", F.col("qid").alias("selected"))
    others = F.slice(F.filter("qids", lambda q: q != F.col("selected")), 1, keep)
    return ambiguous(candidates).join(chosen, "query_label").select("query_label", "selected", others.alias("others"))


def linked(best: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    return best.filter(F.col("qid").isNotNull() & (F.col("confidence") >= threshold))


def same_item(links: DataFrame) -> DataFrame:
    """(label, canonical, qid): labels of one item point to the least of them."""
    least = F.min("query_label").over(Window.partitionBy("qid"))
    return links.withColumn("canonical", least).filter("query_label != canonical").select(F.col("query_label").alias("label"), "canonical", "qid")


def snapshot(labels: DataFrame, cache: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """One row of counts: names, cached, not cached, linked, and links that share an item."""
    split = cache_split(labels, cache)
    is_linked = F.col("qid").isNotNull() & (F.col("confidence") >= threshold)
    return split.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("cached"), 1)).alias("cached"), F.count(F.when(~F.col("cached"), 1)).alias("uncached"),
        F.count(F.when(is_linked, 1)).alias("linked"), (F.count(F.when(is_linked, 1)) - F.countDistinct(F.when(is_linked, F.col("qid")))).alias("duplicates"),
    )


def search(labels: DataFrame, provider: Callable[[], Callable], concurrency: int | None = None, rate: float | None = None, in_flight: int = IN_FLIGHT, with_failures: bool = False) -> DataFrame:
    """Candidates from a search provider, one made per partition, with ``in_flight`` requests
    at once and ``rate`` a second; failures give none, or a row without a rank if wanted.

    Where ``labels`` has a column ``context`` (see ``contexts``), the provider is
    called with the label and its context, as an agent needs it.
    """
    ship_package(labels.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, turns = None, bucket("search", rate)
        for batch in batches:
            find = find or provider()

            def one(asked, find=find):
                turns.take()
                return find(*asked)

            rows = []
            for asked, found, failure in calls.in_flight(batch.itertuples(index=False, name=None), one, turns, in_flight):
                rows += [(asked[0], i, x.get("id"), x.get("label"), x.get("description"), x.get("aliases", [])) for i, x in enumerate(found or [], 1)]
                if failure is not None and with_failures:
                    rows.append((asked[0], None, None, None, None, None))
            out = pd.DataFrame(rows, columns=CANDIDATE.names)
            yield out.assign(rank=out["rank"].astype("Int32"))

    asked = labels.select("label", *["context"] * ("context" in labels.columns))
    return (asked.repartition(concurrency) if concurrency else asked).mapInPandas(run, CANDIDATE)


LINK_CACHE = "label string, qid string, confidence double, description string, aliases array<string>"


def link_names(facts: DataFrame, minimum: int = MIN_SESSIONS, tasks: int | None = None) -> DataFrame:
    """The frequent canonical names that a catalogue could hold."""
    return frequent(label_sources(facts, tasks=tasks), minimum).filter(is_linkable_entity(F.col("canonical"))).select(F.col("canonical").alias("label"))


def unknown(store, names: DataFrame, batch: int) -> DataFrame:
    """Names that the link cache of ``store`` doesn't hold, as ``batch`` finds it."""
    old = store.current("link_cache", LINK_CACHE, before=batch)
    return names.join(old.select(F.col("label").alias("known")), F.lower("label") == F.col("known"), "left_anti")


def cached_links(store, names: DataFrame, threshold: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(links, counters) from the cache of ``store``: links (label, canonical, qid, confidence,
    same) above the threshold; ``canonical`` is the least label of the item, ``same`` whether it is another label."""
    cache = store.current("link_cache", LINK_CACHE)
    found = linked(cache_split(names, cache), threshold)
    links = found.withColumn("canonical", F.min("label").over(Window.partitionBy("qid"))).select("label", "canonical", "qid", "confidence", (F.col("label") != F.col("canonical")).alias("same"))
    return links, snapshot(names, cache, threshold)


def search_into(store, names: DataFrame, batch: int, provider: Callable[[], Callable[[str], list[dict]]] | None = None, candidates: DataFrame | None = None, **options) -> None:
    """Names that the link cache of ``store`` doesn't know, searched once, or looked up in a
    table of candidates; what was found is written as ``batch`` before anything is read from it, and the
    best candidate of each, or null where there is none, becomes the cache's. A failed
    search is no answer: its name is searched again by a later batch."""
    misses = unknown(store, names, batch)
    found = candidates.join(misses.select(F.col("label").alias("query_label")), "query_label", "left_semi").select(*CANDIDATE.names) if provider is None else search(misses, provider, with_failures=True, **options)
    store.replace(found, "candidates", batch)
    found = store.read("candidates").filter(F.col("batch") == batch).drop("batch")
    failed = found.filter("rank IS NULL").select(F.lower("query_label").alias("label"))
    best = best_match(found.filter("rank IS NOT NULL")).select(F.lower("query_label").alias("label"), "qid", "confidence", "description", "aliases")
    lowered = misses.select(F.lower("label").alias("label")).distinct().join(failed, "label", "left_anti")
    store.replace(lowered.join(best, "label", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), "link_cache", batch)


def link_into(store, facts: DataFrame, provider: Callable[[], Callable[[str], list[dict]]], batch: int, minimum: int = MIN_SESSIONS, threshold: float = CONFIDENCE, **options) -> tuple[DataFrame, DataFrame]:
    """Linking of the names in facts with the cache table of ``store``: (links, counters) as ``cached_links``."""
    names = link_names(facts, minimum)
    search_into(store, names, batch, provider, **options)
    return cached_links(store, names, threshold)


def link(facts: DataFrame, candidates: DataFrame, cache: DataFrame | None = None, minimum: int = MIN_SESSIONS, threshold: float = CONFIDENCE, tasks: int | None = None) -> DataFrame:
    """The whole of linking: frequent canonical names that a catalogue could hold, the
    cache's answers, the best candidates of the rest, above the threshold."""
    names = link_names(facts, minimum, tasks)
    columns = ("query_label", "qid", "confidence")
    fresh = names
    parts = []
    if cache is not None:
        split = cache_split(names, cache)
        parts.append(split.filter("cached").select(F.col("label").alias("query_label"), "qid", "confidence"))
        fresh = split.filter("not cached").select("label")
    wanted = candidates.join(fresh.select(F.col("label").alias("query_label")), "query_label", "left_semi")
    out = best_match(wanted).select(*columns)
    for part in parts:
        out = out.unionByName(part)
    return linked(out, threshold)
