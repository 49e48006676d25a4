"""Requests and answers of offline batch runs, and their ledger of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.responses import parsed
from .extraction import build_prompt, facts_of

TEMPERATURE = 0.2


def request_lines(messages: DataFrame, max_tokens: int = 8192, metadata_as_text: bool = True) -> DataFrame:
    """One JSON request per message; ``value`` can be written as text."""
    metadata = F.struct("message_id", F.col("session").alias("session_id"), "source_file")
    parts = F.array(F.struct(build_prompt(F.col("content")).alias("text")))
    request = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts"))).alias("contents"),
        F.struct(F.lit(TEMPERATURE).alias("temperature"), F.lit(max_tokens).alias("maxOutputTokens"), F.lit("application/json").alias("responseMimeType")).alias("generationConfig"),
    )
    return messages.select(F.to_json(F.struct(request.alias("request"), (F.to_json(metadata) if metadata_as_text else metadata).alias("metadata"))).alias("value"))


def read_answers(lines: DataFrame, drop_empty: bool = False) -> DataFrame:
    """(message_id, session_id, source_file, facts) from output lines; bad lines give no row.

    Metadata may be an object or its JSON text; the first candidate's first part counts.
    """
    raw = F.get_json_object("value", "$.response.candidates[0].content.parts[0].text")
    meta = F.get_json_object("value", "$.metadata")
    keys = ("message_id", "session_id", "source_file")
    out = lines.select(*[F.get_json_object(meta, f"$.{k}").alias(k) for k in keys], raw.alias("raw")).filter("message_id is not null and raw is not null")
    # lines are told apart by their place: the same message may be answered twice
    out = parsed(out.withColumn("line", F.monotonically_increasing_id()), "line", *keys).filter("facts is not null").drop("line")
    return out.filter(F.size("facts") > 0) if drop_empty else out


def by_source(answers: DataFrame) -> DataFrame:
    return answers.groupBy("source_file").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size("facts")).alias("facts"))


def collect(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """Knowledge facts of batch answers, with the session and text of the messages they are about."""
    answers = read_answers(lines, drop_empty=True).select("message_id", "facts")
    return facts_of(answers, messages.withColumn("message_id", F.col("message_id").cast("string")))


def collect_jobs(store, jobs: DataFrame, lines: DataFrame, messages: DataFrame, batch: int) -> DataFrame:
    """Facts of finished jobs into ``store``, and the jobs' state after it.

    ``jobs``: job_id, state, requests; ``lines``: job_id and value. Only jobs that
    succeeded are collected; one without any readable answer has failed.
    """
    done = lines.join(jobs.filter("state = 'succeeded'").select("job_id"), "job_id", "left_semi")
    store.append(collect(done, messages), "facts", batch)
    answered = done.filter(F.get_json_object("value", "$.response.candidates[0].content.parts[0].text").isNotNull()).groupBy("job_id").agg(F.count(F.lit(1)).alias("answers"))
    state = F.when(F.col("state") != "succeeded", F.col("state")).when(F.coalesce("answers", F.lit(0)) > 0, "collected").otherwise("failed")
    return jobs.join(answered, "job_id", "left").select("job_id", state.alias("state"), "requests", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"))


def record_job(spark: SparkSession, path: str, job_id: str, state: str, requests: int) -> None:
    """Append the state of a job to the ledger at ``path``."""
    spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(state).alias("state"), F.lit(requests).cast("long").alias("requests"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)
