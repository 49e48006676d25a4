"""Queued jobs as a stream: what sessions end, one job each, in the order they were queued.

A queue is a folder in which job n is the file ``n.json``. Publishing takes the next
free number by a link that fails if the number is taken, so numbers have no gaps and a
job once queued is never lost; it needs neither Spark nor a broker, so that a hook that
runs after a session can do it in some milliseconds. The stream's offsets are job
numbers. With the stream's checkpoint each job has one effect: a batch that comes again
covers the same numbers, and the store lets a batch replace itself. Numbers are
acknowledged when a batch is committed, as the next one begins: their files go, but for
the last one, which tells what the next number is.

A job is an object with ``transcript_path`` and, if known, ``session_id``. Bodies that
cannot be read and jobs whose transcript is not there are refused into the dead
letters; jobs without a path, of sub-agents' sessions, or whose transcript has not
changed are done without any work.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.incremental import translate_path
from ..session import ship_package
from .ingest import process
from .store import Store

#: Jobs that one task reads.
JOBS_PER_TASK = 64
JOB = "position long, body string, transcript_path string, session_id string, malformed boolean"
SUBAGENTS = "/subagents/"


def _local(folder: str) -> Path:
    return Path(folder.removeprefix("file://"))


def _numbers(folder: Path) -> list[int]:
    return sorted(int(n[:-5]) for n in os.listdir(folder) if n.endswith(".json") and n[:-5].isdigit()) if folder.is_dir() else []


def publish(folder: str, body: str) -> int:
    """Queue a job; its number."""
    queue = _local(folder)
    queue.mkdir(parents=True, exist_ok=True)
    draft = queue / f".{uuid.uuid4().hex}"
    draft.write_text(body)
    try:
        while True:
            number = max(_numbers(queue), default=-1) + 1
            try:
                os.link(draft, queue / f"{number}.json")
                return number
            except FileExistsError:  # another was first
                continue
    finally:
        draft.unlink()


def wanted(job: dict, outputs: str | None = None) -> bool:
    """Whether a finished session is worth a job: its transcript is there, is no sub-agent's, and
    no file ``<session>.ttl`` in ``outputs`` is newer than it."""
    path = job.get("transcript_path") or ""
    if not path or not os.path.isfile(path) or SUBAGENTS in path:
        return False
    output = Path(outputs or ".") / f"{job.get('session_id') or Path(path).stem}.ttl"
    return not (outputs and output.is_file() and output.stat().st_mtime > os.stat(path).st_mtime)


def session_ended(folder: str, hook_input: str, outputs: str | None = None) -> int | None:
    """What a hook does with its input when a session ends: the number of the job it queues, if any."""
    job = json.loads(hook_input)
    kept = {k: job.get(k) or "" for k in ("transcript_path", "session_id")}
    return publish(folder, json.dumps(kept)) if wanted(kept, outputs) else None


class _Span(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class JobReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _local(options["path"])

    def initialOffset(self) -> dict:
        """Before the oldest job that is still there."""
        found = _numbers(self.folder)
        return {"next": found[0] if found else 0}

    def latestOffset(self) -> dict:
        found = _numbers(self.folder)
        return {"next": found[-1] + 1 if found else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(n, min(n + JOBS_PER_TASK, end["next"])) for n in range(start["next"], end["next"], JOBS_PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(*partition.value):
            body = (self.folder / f"{n}.json").read_bytes().decode("utf-8", "replace")
            try:
                job = json.loads(body)
                path, session = (job.get(k) or "" for k in ("transcript_path", "session_id"))
                good = isinstance(path, str) and isinstance(session, str)
            except (ValueError, AttributeError, RecursionError):
                good = False
            yield (n, body, path, session, False) if good else (n, body, None, None, True)

    def commit(self, end: dict) -> None:
        """Acknowledged jobs go; the last number stays."""
        for n in _numbers(self.folder):
            if n < end["next"] - 1:
                (self.folder / f"{n}.json").unlink(missing_ok=True)


class JobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_jobs"

    def schema(self) -> str:
        return JOB

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JobReader(dict(self.options))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs of a queue as a stream."""
    ship_package(spark)
    _local(folder).mkdir(parents=True, exist_ok=True)
    spark.dataSource.register(JobSource)
    return spark.readStream.format("tessera_jobs").load(folder)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(position, source, text): the text is null where there is no such file."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column(1).to_pylist():
            plain = re.sub("^file:/+", "/", path)
            system, at = fs.FileSystem.from_uri(plain if "://" in plain else Path(plain).absolute().as_uri())
            try:
                with system.open_input_file(at) as file:
                    out.append(file.read().decode("utf-8", "replace"))
            except (FileNotFoundError, IsADirectoryError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["position", "source", "text"])


def take(jobs: DataFrame, store: Store, batch: int, container: str | None = None, **options) -> None:
    """One micro-batch of jobs into the store.

    ``container``: where the folder of all projects is mounted, if not where the hook saw
    it. A session queued more than once in a batch is read once. ``options``: of ``process``.
    """
    ship_package(store.spark)
    path = F.col("transcript_path")
    refused = F.when(F.col("malformed"), "malformed job")
    idle = F.when(path == "", "no transcript").when(F.contains(path, F.lit(SUBAGENTS)), "sub-agent session")
    judged = jobs.withColumn("refused", refused).withColumn("idle", idle).withColumn("source", translate_path(path, container) if container else path).persist()
    try:
        work = judged.filter("refused IS NULL AND idle IS NULL").select("position", "source")
        first = work.groupBy("source").agg(F.min("position").alias("position"))
        read = first.select("position", "source").mapInArrow(_texts, "position long, source string, text string").persist()
        lost = read.filter("text IS NULL").select("source", F.lit(None).cast("string").alias("sha256"), F.lit("transcript not found").alias("reason"))
        bad = judged.filter("refused IS NOT NULL").select(F.concat(F.lit("job/"), F.col("position").cast("string")).alias("source"), F.sha2("body", 256).alias("sha256"), F.col("refused").alias("reason"))
        process(read.filter("text IS NOT NULL").select("source", "text"), store, batch, refused=lost.unionByName(bad), **options)
        read.unpersist()
    finally:
        judged.unpersist()


def start(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True, container: str | None = None, **options) -> StreamingQuery:
    """Work on the jobs of a queue as they come; ``once`` takes what is there and stops."""
    writer = stream(spark, folder).writeStream.foreachBatch(lambda df, n: take(df, store, n, container, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
