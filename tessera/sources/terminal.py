"""Terminal agent sessions in SQLite, through a Python data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.identifiers import slug
from ..session import ship_package
from .jsonl import session_graph

EXCHANGE = "exchange_id string, conversation_id string, start_ts string, input string, working_directory string, output_status string, model_id string"
CONVERSATION = "id long, conversation_id string, last_modified_at string"
TABLES = {"ai_queries": EXCHANGE, "agent_conversations": CONVERSATION}
MIN_EXCHANGES = 5
SUBSTANTIVE_LENGTH = 30
MIN_FACTS = 1


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of row ids are read apart."""

    ROWS = 100_000

    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.columns = options["path"], options["table"], schema.names
        if self.table not in TABLES:
            raise ValueError(f"unknown table {self.table}")

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path.removeprefix('file:')}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [_Range(a, a + self.ROWS) for a in range(low, high + 1, self.ROWS)] if low is not None else [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._connect() as db:
            yield from db.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terminal_sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("terminal_sqlite").option("table", table).load(path)


def query_text(exchanges: DataFrame) -> DataFrame:
    """Adds ``content``: the texts of all queries in the JSON input, joined by line feeds; bad JSON gives ''."""
    parsed = F.from_json("input", "array<struct<Query struct<text string>>>")
    texts = F.filter(F.transform(parsed, lambda x: x["Query"]["text"]), lambda t: t.isNotNull() & (t != ""))
    return exchanges.withColumn("content", F.coalesce(F.array_join(texts, "\n"), F.lit("")))


def messages(exchanges: DataFrame) -> DataFrame:
    """User messages only: the container has no assistant text. Blank queries are dropped."""
    rows = query_text(exchanges).filter(F.btrim("content") != "")
    return rows.select(slug(F.col("conversation_id")).alias("session"), F.col("exchange_id").alias("message_id"), F.lit("user").alias("role"), "content", F.col("start_ts").alias("created"), F.col("model_id").alias("model"), "working_directory")


def worth_keeping(messages: DataFrame, min_exchanges: int = MIN_EXCHANGES) -> DataFrame:
    """Sessions with enough messages of substance."""
    good = messages.groupBy("session").agg(F.count(F.when(F.char_length(F.btrim("content")) > SUBSTANTIVE_LENGTH, 1)).alias("n")).filter(F.col("n") >= min_exchanges)
    return good.select("session")


def productive(sessions: DataFrame, facts: DataFrame, min_facts: int = MIN_FACTS) -> DataFrame:
    """Sessions whose extraction gave enough facts."""
    return sessions.join(facts.groupBy("session").count().filter(F.col("count") >= min_facts).select("session"), "session", "left_semi")


def sessions(kept: DataFrame) -> DataFrame:
    """Sessions of messages: first and last time."""
    return kept.groupBy("session").agg(F.min("created").alias("created"), F.max("created").alias("modified")).withColumn("platform", F.lit("warp"))


def graph(kept: DataFrame, developer: str = "developer", min_exchanges: int = MIN_EXCHANGES) -> DataFrame:
    """The statements about the messages of sessions worth keeping, as long rows."""
    good = kept.join(worth_keeping(kept, min_exchanges), "session", "left_semi")
    return session_graph(sessions(good), good, developer)
