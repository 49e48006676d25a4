"""Places and small helpers that every corpus operator needs."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows of an Arrow batch of texts; the bytes of one are cut further in Python.
BATCH_ROWS = 256
#: A side of a join is broadcast only if it was counted to have no more rows.
BROADCAST_ROWS = 1_000_000
#: Rows that a file of a narrow intermediate table holds at least, beyond two files a core.
FILE_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may name none; a temporary folder is
    made and set then. On a cluster such a folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Bytes of texts for which a table gets one file, beyond two files a core.
FILE_BYTES = 64 << 20


def fewer_files(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df``, made of the table ``docs``, in no more partitions than the bytes of ``docs`` need
    as files, so that many small partitions don't become many small files. Partitions of Spark's
    usual size hold more, so of a large table none are put together."""
    spark = df.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / FILE_BYTES)))


def written(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders by the column ``by`` if given: cuts lineage, survives lost executors.

    ``rows``: about how many narrow rows there will be. The table then gets no more
    files than that needs, so that many shuffle partitions do not become many tiny files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df if rows is None else df.coalesce(max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS)))
    out.write.parquet(path, partitionBy=by)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.table_path = path
    return kept


def join_counted(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", weight: Column | None = None) -> DataFrame:
    """``df`` joined with a narrow ``side`` (a written table, so that counting is cheap):
    by broadcast up to ``BROADCAST_ROWS`` counted rows, by shuffle beyond. ``weight``: for how
    many rows one counts, where it holds a list."""
    rows = side.count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def erase(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df.table_path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python stages: bound the rows of an Arrow batch, since texts may be
    very long, and see that workers can import this package. Every operator that
    returns a lazy plan leaves the session at ``BATCH_ROWS``."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another batch size for the actions inside, which must not be lazy."""
    small_batches(spark, rows)
    try:
        yield
    finally:
        small_batches(spark)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning."""
    return F.crc32(doc_id.cast("string")) % 5


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of finished steps: they are deleted once the driver's
    collector finds that nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
