"""Sessions' statements as files: one per session, replaced by name, all or none of a run.

A task writes the sessions it gets, line by line, to files of its own attempt in a
hidden folder; only when every task has succeeded are the files of the successful
attempts moved to their names, each by one rename. A run that fails, and an attempt
that is lost, leave no file under a session's name. Lines are N-Triples, which is
Turtle too. A session's lines are written by one task in constant memory.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans import graph_model
from ..session import ship_package

SUFFIX = ".ttl"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class SessionWriter(DataSourceWriter):
    """Rows (session, value), those of a session next to each other."""

    def __init__(self, options: dict):
        self.folder = Path(options["path"].removeprefix("file://"))
        self.run = self.folder / f".run-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        place = self.run / uuid.uuid4().hex
        place.mkdir(parents=True)
        session, file = None, None
        try:
            for row in rows:
                if row[0] != session:
                    if file is not None:
                        file.close()
                    session, file = row[0], open(place / f"{row[0]}{SUFFIX}", "a", encoding="utf-8")  # noqa: SIM115
                file.write(row[1] + "\n")
        finally:
            if file is not None:
                file.close()
        return Attempt(str(place))

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        for message in messages:
            for name in os.listdir(message.folder):
                os.replace(Path(message.folder) / name, self.folder / name)
        shutil.rmtree(self.run, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class SessionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_session_files"

    def schema(self) -> str:
        return "session string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SessionWriter(dict(self.options))


def write(rows: DataFrame, folder: str) -> None:
    """Long rows with their session, into a file per session; names are slugs, so they are good as file names."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(SessionFiles)
    lines = graph_model.n_triples(rows, "session").filter("session IS NOT NULL")
    dealt = lines.repartition("session").sortWithinPartitions("session", "value")
    dealt.write.format("tessera_session_files").mode("append").save(folder)
