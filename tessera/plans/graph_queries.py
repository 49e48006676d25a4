"""The graph questions, as functions of model tables.

Solutions are bags and base tables are sets, so nothing is made distinct after a
join unless the question says so. Unbound values sort first. Questions that stop
at a number of rows break ties by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import CATALOGUE

TOP = 20


def _dealt(rows: DataFrame, tasks: int | None, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to so many tasks, if a number is given: what is distinct or grouped by the key and more needs no other shuffle."""
    return rows.repartition(tasks, key) if tasks else rows


def sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("session", "platform", "created", "modified").orderBy(F.col("created").asc_nulls_first(), "session")


def tool_calls(calls: DataFrame) -> DataFrame:
    return calls.select("tool_id", "tool_name", "created").orderBy(F.col("created").asc_nulls_first(), "tool_id")


def topic_counts(facts: DataFrame) -> DataFrame:
    """Messages that mention a label, in either role; a message mentions an entity once."""
    mentions = facts.select("message_id", F.explode(F.array(F.struct(F.col("subj").alias("entity"), F.col("subj_name").alias("label")), F.struct(F.col("obj").alias("entity"), F.col("obj_name").alias("label")))).alias("m"))
    return mentions.select("message_id", "m.*").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.col("mentions").desc(), "label")


def thread(messages: DataFrame, length: int = 100) -> DataFrame:
    """Turns of user and assistant in order, with the start of their content."""
    return messages.filter(F.col("role").isin("user", "assistant")).select("session", "seq", "message_id", "role", F.substring("content", 1, length).alias("snippet")).orderBy("session", "seq")


def tool_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.col("uses").desc(), "tool_name")


def entity_relations(facts: DataFrame, name: str, length: int = 120) -> DataFrame:
    """What an entity relates to, with the source's start."""
    return facts.filter(F.lower("subj_name") == name.lower()).select("predicate", F.col("obj_name").alias("object_label"), F.substring("content", 1, length).alias("snippet")).orderBy("predicate", "object_label")


def relation_between(facts: DataFrame, subject: str, object_: str, length: int = 120) -> DataFrame:
    both = (F.lower("subj_name") == subject.lower()) & (F.lower("obj_name") == object_.lower())
    return facts.filter(both).select("predicate", F.substring("content", 1, length).alias("snippet"))


def cooccurrence(facts: DataFrame, top: int = TOP, tasks: int | None = None) -> DataFrame:
    """Directed pairs of different entities, by the number of facts."""
    pairs = _dealt(facts.filter("subj != obj").select("triple_id", F.col("subj_name").alias("label1"), F.col("obj_name").alias("label2")), tasks, "triple_id").distinct()
    return pairs.groupBy("label1", "label2").agg(F.count("triple_id").alias("cooccurrences")).orderBy(F.col("cooccurrences").desc(), "label1", "label2").limit(top)


def sessions_by_platform(sessions: DataFrame) -> DataFrame:
    return sessions.filter("platform is not null").groupBy("platform").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.col("sessions").desc(), "platform")


def _subject_platforms(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    return facts.select("session", F.col("subj_name").alias("label")).distinct().join(sessions.filter("platform is not null").select("session", "platform"), "session").select("label", "platform").distinct()


def cross_platform(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Subjects known on more than one platform."""
    return _subject_platforms(facts, sessions).groupBy("label").agg(F.count(F.lit(1)).alias("platforms")).filter("platforms > 1").orderBy(F.col("platforms").desc(), "label")


def facts_by_platform(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    per_session = facts.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return per_session.join(sessions.filter("platform is not null").select("session", "platform"), "session").groupBy("platform").agg(F.sum("n").alias("triples")).orderBy(F.col("triples").desc(), "platform")


def catalogue_links(links: DataFrame) -> DataFrame:
    """Entities linked to the catalogue; links between entities do not count."""
    return links.filter(F.col("same_as").startswith(CATALOGUE)).select("label", "same_as").orderBy("label", "same_as")


def source_files(sessions: DataFrame) -> DataFrame:
    return sessions.filter("platform is not null and source_file is not null").select("session", "platform", "source_file").orderBy("platform", "session")


def sessions_by_project(sessions: DataFrame) -> DataFrame:
    return sessions.filter("project is not null").groupBy(F.col("project").alias("project_label")).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.col("sessions").desc(), "project_label")


def hubs(facts: DataFrame, top: int = TOP, tasks: int | None = None) -> DataFrame:
    """The entities in most facts, in either role: both roles from one scan."""
    dealt = _dealt(facts.select("triple_id", "subj_name", "obj_name"), tasks, "triple_id")
    roles = dealt.select("triple_id", F.explode(F.array("subj_name", "obj_name")).alias("label")).distinct()
    return roles.groupBy("label").agg(F.count("triple_id").alias("degree")).orderBy(F.col("degree").desc(), "label").limit(top)


def relates_contains(facts: DataFrame, subject: str, object_: str, length: int = 150) -> DataFrame:
    """Distinct relations between names that contain the given texts."""
    both = F.lower("subj_name").contains(subject.lower()) & F.lower("obj_name").contains(object_.lower())
    return facts.filter(both).select("predicate", F.substring("content", 1, length).alias("snippet")).distinct()


def platform_lists(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Subjects on more than one platform, with the platforms in order."""
    return (
        _subject_platforms(facts, sessions).groupBy("label")
        .agg(F.array_join(F.sort_array(F.collect_set("platform")), ", ").alias("platforms"), F.count(F.lit(1)).alias("platform_count"))
        .filter("platform_count > 1").orderBy(F.col("platform_count").desc(), "label")
    )


def catalogue_lookup(links: DataFrame, part: str) -> DataFrame:
    return catalogue_links(links).filter(F.lower("label").contains(part.lower()))


def federated_description(links: DataFrame, catalogue: DataFrame, part: str) -> DataFrame:
    """Linked entities whose label contains ``part``, with the catalogue's own description.

    ``catalogue`` (qid, description) stands in for the remote service.
    """
    linked = catalogue_lookup(links, part).withColumn("qid", F.substring("same_as", len(CATALOGUE) + 1, 100))
    return linked.join(catalogue.select("qid", "description").distinct(), "qid").select("label", "same_as", "description")


def triple_count(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count(F.lit(1)).alias("triples"))
