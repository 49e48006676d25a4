"""Asking a provider for facts of messages, with a cache table."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import content_hash, slug, triple_id
from ..functions.responses import FACTS, candidate_facts, parsed, truncated
from ..functions.vocabulary import ALL_PREDICATES
from ..session import ship_package
from .calls import IN_FLIGHT, BusyError, ConfigurationError, TokenBucket, bucket, in_flight
from .hosted import SERVICES, hosted, is_there

#: Shorter messages hold no facts.
MIN_LENGTH = 30
#: Code points of a message sent at first, after a failure, and after a truncated answer.
FIRST_LENGTH, RETRY_LENGTH, TRUNCATED_LENGTH = 1500, 1000, 800
ATTEMPTS = 3
#: Roles whose messages are asked about, by platform.
EXTRACT_ROLES = {"claude-code": ("assistant",), "deepseek": ("user", "assistant"), "grok": ("user", "assistant"), "warp": ("user",)}


@runtime_checkable
class Provider(Protocol):
    def generate(self, prompt: str) -> str:
        """The model's answer to ``prompt``."""


class ScriptedProvider:
    """Deterministic offline provider: facts from sentences "X predicate Y" of the prompt's last part."""

    def generate(self, prompt: str) -> str:
        text = prompt.rpartition("TEXT:\n")[2]
        facts = []
        for sentence in text.replace("\n", ".").split("."):
            words = sentence.split()
            for i, word in enumerate(words):
                if word in ALL_PREDICATES and 0 < i < len(words) - 1:
                    facts.append({"subject": " ".join(words[:i]), "predicate": word, "object": " ".join(words[i + 1 :])})
                    break
        return json.dumps(facts)


PROVIDERS: dict[str, Callable[[], Provider]] = {"scripted": ScriptedProvider}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    """A provider of the application's own; it takes the place of a hosted one of that name."""
    PROVIDERS[name] = factory


def list_providers() -> list[str]:
    return [*PROVIDERS, *(name for name in SERVICES if name not in PROVIDERS)]


def detect_provider(environment: dict[str, str] | None = None, local: Callable[[], bool] = is_there) -> str:
    """Which provider the settings speak of: the one named by TESSERA_PROVIDER, else the first hosted one whose key is set, else
    the local service if a model is named and it answers, else the offline one."""
    known = os.environ if environment is None else environment
    if known.get("TESSERA_PROVIDER"):
        return known["TESSERA_PROVIDER"]
    by_key = next((name for name, (_, _, key) in SERVICES.items() if key and known.get(key)), None)
    return by_key or ("ollama" if known.get("TESSERA_MODEL") and local() else "scripted")


def get_provider(name: str | None = None, environment: dict[str, str] | None = None) -> Callable[[], Provider]:
    name = (name or detect_provider(environment)).lower()
    if name in PROVIDERS:
        return PROVIDERS[name]
    if name in SERVICES:
        return hosted(name, environment)
    raise ValueError(f"unknown provider {name}; known: {', '.join(list_providers())}")


#: What is asked of a model; the text of the message follows.
PROMPT_HEAD = (
    "List the technical facts stated in the text as a JSON array of objects with the string fields "
    '"subject", "predicate" and "object". Subjects and objects are names of one to three words in lower case. '
    f"Predicates: {', '.join(ALL_PREDICATES)}. At most ten facts, the most important first. "
    "Give [] if there are none.\nTEXT:\n"
)


def build_prompt(text, length: int = FIRST_LENGTH):
    """The request for facts of one message, as a column; the text comes last."""
    return F.concat(F.lit(PROMPT_HEAD), F.substring(text, 1, length))


def ask(provider: Provider, text: str, turns: TokenBucket | None = None) -> tuple[str | None, int]:
    """(the first readable answer about ``text`` or null, truncated answers met).

    A failed call or an answer that cannot be read is asked again with less text, with
    less still if the answer was cut off. A service that is busy is waited for.
    """
    turns = turns or TokenBucket(None)
    length, cut_off = FIRST_LENGTH, 0
    for _ in range(ATTEMPTS):
        turns.take()
        try:
            answer = provider.generate(PROMPT_HEAD + text[:length]).strip()
        except ConfigurationError:
            raise
        except BusyError as error:
            turns.pause(error.seconds)
            continue
        except Exception:  # a provider's failure costs this attempt only
            length = RETRY_LENGTH
            continue
        was_cut = truncated(answer)
        cut_off += was_cut
        if candidate_facts(answer, was_cut) is not None:
            return answer, cut_off
        length = TRUNCATED_LENGTH if was_cut else RETRY_LENGTH
    return None, cut_off


def _asked(make: Callable[[], Provider], rate: float | None, most: int):
    """Iterator of answers: one provider per partition, several requests in flight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, turns = None, bucket("model", rate)
        for batch in batches:
            provider = provider or make()
            answers = [answer for _, answer, failure in in_flight(batch["content"], lambda text: ask(provider, text, turns), turns, most)]
            yield batch[["message_id", "text_hash"]].assign(raw=[a for a, _ in answers], truncations=[n for _, n in answers])

    return run


CACHE = f"message_id string, text_hash string, facts {FACTS.simpleString()}, truncations int"


def extract(
    messages: DataFrame, cache: DataFrame | None = None, provider: Callable[[], Provider] = ScriptedProvider, concurrency: int | None = None, rate: float | None = None, in_flight: int = IN_FLIGHT
) -> DataFrame:
    """(message_id, text_hash, facts, truncations) of every message long enough; null facts: no attempt gave a readable answer.

    Answers in ``cache`` (the same columns) are used where the text is the same, unless
    they are null; only the rest reaches the provider, ``concurrency`` partitions at a
    time, each with ``in_flight`` requests at once and ``rate`` requests a second. Every
    action on the result asks anew: ``extract_into`` keeps the answers.
    """
    ship_package(messages.sparkSession)
    asked = messages.filter(F.char_length(F.btrim("content")) >= MIN_LENGTH).select("message_id", "content", content_hash(F.col("content")).alias("text_hash"))
    hits = None
    if cache is not None:
        cache = cache.filter("facts IS NOT NULL")
        hits = cache.join(asked.select("message_id", "text_hash"), ["message_id", "text_hash"], "left_semi").select("message_id", "text_hash", "facts", "truncations")
        asked = asked.join(cache.select("message_id", "text_hash"), ["message_id", "text_hash"], "left_anti")
    if concurrency:
        asked = asked.repartition(concurrency)
    schema = T.StructType([asked.schema["message_id"], T.StructField("text_hash", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("truncations", T.IntegerType())])
    answers = asked.mapInPandas(_asked(provider, rate, in_flight), schema)
    fresh = parsed(answers, "message_id", "text_hash", "truncations").select("message_id", "text_hash", F.col("facts").cast(FACTS).alias("facts"), "truncations")
    return fresh if hits is None else hits.unionByName(fresh)


def counters() -> list[Column]:
    """What is counted of answers while they pass: messages asked about, failures, truncated answers, facts."""
    return [
        F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum(F.col("facts").isNull().cast("long")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("truncations"), F.lit(0)).alias("truncated"), F.coalesce(F.sum(F.when(F.col("facts").isNotNull(), F.size("facts"))), F.lit(0)).alias("facts"),
    ]


def extract_into(store, messages: DataFrame, batch: int, provider: Callable[[], Provider] = ScriptedProvider, **options) -> DataFrame:
    """``extract`` with the cache table of ``store``: new answers are written to it, once, as
    ``batch``; then the answers about ``messages``, known and new, are read back.

    A failure is written too, as null facts, but counts as no answer: a later batch asks again.
    What the batch did is counted as its answers are written, without another scan, and kept in the
    table ``counters``.
    """
    known = store.current("cache", CACHE, before=batch).filter("facts IS NOT NULL")
    fresh = extract(messages.join(_same_text(messages, known), "message_id", "left_anti"), None, provider, **options)
    met = Observation("asked")
    store.replace(fresh.observe(met, *counters()), "cache", batch)
    store.append(store.spark.createDataFrame([(name, n) for name, n in met.get.items()], "name string, n long"), "counters", batch)
    wanted = messages.select("message_id", content_hash(F.col("content")).alias("text_hash"))
    return store.current("cache").join(wanted, ["message_id", "text_hash"], "left_semi")


def _same_text(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids of messages whose present text the cache knows."""
    return messages.select("message_id", content_hash(F.col("content")).alias("text_hash")).join(cache, ["message_id", "text_hash"], "left_semi").select("message_id")


def latest(cache: DataFrame, key: str | list[str], at: str) -> DataFrame:
    """Upsert reading of an append-only table: the last row of each key."""
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(at).desc())
    return cache.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def facts_of(extracted: DataFrame, messages: DataFrame) -> DataFrame:
    """Knowledge facts with provenance: one row per distinct fact of a message."""
    rows = extracted.select("message_id", F.explode("facts").alias("f")).select("message_id", F.col("f.subject").alias("subj_name"), F.col("f.predicate").alias("predicate"), F.col("f.object").alias("obj_name")).distinct()
    named = rows.withColumn("subj", slug(F.col("subj_name"))).withColumn("obj", slug(F.col("obj_name"))).withColumn("triple_id", triple_id(F.col("subj_name"), F.col("predicate"), F.col("obj_name"), F.col("message_id").cast("string")))
    return named.join(messages.select("message_id", "session", "content"), "message_id")


def extractable(messages: DataFrame) -> DataFrame:
    """Messages of user and assistant long enough to ask about."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.char_length(F.btrim("content")) >= MIN_LENGTH))
