"""A store of tables whose readers see, without looking at history, what is current.

Each table is hashed into buckets by its key. A manifest names the files that make up
every table; a change writes its files first and then the next manifest, which is the
one step that makes it visible: all tables of a change at once, or none. Manifests are
numbered, and one is put in place by a rename that fails if its number is taken, so two
writers cannot lose each other's changes.

A change belongs to a batch. If a batch comes again, as a stream replays it after a
failure, its files take the place of those it wrote before. ``replace`` also notes the
keys it brings, so that rows of earlier batches with such a key are no longer current;
rows are not rewritten for that. Once a bucket consists of more than ``PARTS`` parts,
the next change first rewrites that bucket alone, without the rows that are gone.
Files that no manifest of the last ones names are left by lost tasks or older versions;
``vacuum`` deletes them.

Extra columns: ``batch`` in what is read with ``read``. Tables keep their first schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Parts of a bucket before the next change rewrites it.
PARTS = 8
#: Rows that name replaced keys up to which the keys are sent to every task; more are shuffled.
BROADCAST_KEYS = 1_000_000
#: Attempts to put a manifest in place beside other writers.
COMMITS = 20
#: What a table is hashed and replaced by.
KEYS = {"ledger": "source", "dead_letter": "source", "cache": "message_id", "link_cache": "label", "links": "label", "candidates": "query_label", "round": "label", "counters": "name"}


class Conflict(Exception):
    """Another writer changed the same batch of the same table."""


@dataclass
class Part:
    """Files of one batch, or of several after a rewrite: a folder per bucket."""

    folder: str
    batch: int
    buckets: list[int]
    gone: str | None = None  # folder of rows with the keys that the batch replaces
    gone_buckets: list[int] = field(default_factory=list)
    gone_rows: int = 0
    rewritten: bool = False


@dataclass
class Change:
    """What one batch does to the tables; collected while files are written."""

    store: Store
    batch: int
    parts: dict[str, tuple[str, Part]] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)

    def append(self, df: DataFrame, table: str) -> None:
        self._write(df, table, None)

    def replace(self, df: DataFrame, table: str, keys: DataFrame | None = None) -> None:
        """Rows that take the place of all earlier ones with their key; ``keys``: also of these, though they have no row."""
        self._write(df, table, keys, True)

    def overwrite(self, df: DataFrame, table: str) -> None:
        """Rows that take the place of the whole table."""
        self._write(df, table, None)
        self.whole.add(table)

    def _write(self, df: DataFrame, table: str, keys: DataFrame | None, replaces: bool = False) -> None:
        store, key = self.store, self.store.key(table)
        folder = store.path(f"{table}/{self.batch}-{uuid.uuid4().hex}")
        written = store._write(df.withColumn("batch", F.lit(self.batch).cast("long")), table, folder)
        part = Part(folder, self.batch, written)
        if replaces and keys is None:  # its own rows tell which keys it replaces
            part.gone, part.gone_buckets = folder, written
        elif replaces:
            own = df.select(key).limit(0) if not written else store.spark.read.schema(df.select(key).schema).option("recursiveFileLookup", "true").parquet(folder)
            part.gone = f"{folder}-keys"
            part.gone_buckets = store._write(own.unionByName(keys.select(key)).distinct().withColumn("batch", F.lit(self.batch).cast("long")), table, part.gone)
        if part.gone_buckets:
            part.gone_rows = store.spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(part.gone).count()
        self.parts[table] = df.schema.json(), part


@dataclass
class Store:
    """Tables under one folder."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def key(self, table: str) -> str:
        return KEYS.get(table.rsplit("_", 1)[0] if table.startswith("round_") else table, "session")

    # manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(self.path("_manifests")) if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a version, by default of the last: schema and parts of each."""
        found = self.versions()
        if not found:
            return {"version": -1, "tables": {}}
        version = found[-1] if version is None else version
        fs, at = self._fs(self.path(f"_manifests/{version}.json"))
        stream = fs.open(at)
        try:
            read = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        for t in read["tables"].values():
            t["parts"] = [Part(**p) for p in t["parts"]]
        return read

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest in place, if its number is free."""
        data = json.dumps(manifest, default=vars).encode()
        target = self.path(f"_manifests/{manifest['version']}.json")
        fs, temporary = self._fs(self.path(f"_manifests/.{uuid.uuid4().hex}"))
        out = fs.create(temporary, True)
        out.write(bytearray(data))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, self._fs(target)[1], options)
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def ensure(self) -> bool:
        """Whether the store was there; an empty one is made otherwise."""
        return bool(self.versions()) or not self._publish({"version": 0, "tables": {}})

    # writing

    def _write(self, df: DataFrame, table: str, folder: str) -> list[int]:
        """``df`` in a folder per bucket; large buckets are split into several files, small ones are one."""
        bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key(table)).cast("string")), F.lit(self.buckets)).cast("int"))
        bucketed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return sorted(int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket="))

    @contextmanager
    def change(self, batch: int) -> Iterator[Change]:
        """The changes of one batch to any tables, visible together when the block ends; nothing is if it fails."""
        self.compact()
        made, first = Change(self, batch), self.manifest()
        yield made
        before = {t: self._of_batch(first, t, batch) for t in made.parts}
        for _ in range(COMMITS):
            now = self.manifest()
            for table, (schema, part) in made.parts.items():
                if self._of_batch(now, table, batch) != before[table]:
                    raise Conflict(f"batch {batch} of {table} was written by another")
                if table in made.whole:
                    now["tables"][table] = {"schema": schema, "parts": [part]}
                    continue
                known = now["tables"].setdefault(table, {"schema": schema, "parts": []})
                if T.StructType.fromJson(json.loads(known["schema"])).simpleString() != T.StructType.fromJson(json.loads(schema)).simpleString():
                    raise ValueError(f"{table} has other columns: {known['schema']}")
                if any(p.rewritten and p.batch >= batch for p in known["parts"]):
                    raise ValueError(f"batch {batch} of {table} came before a rewritten one")
                known["parts"] = [p for p in known["parts"] if p.batch != batch] + [part]
            if self._publish({**now, "version": now["version"] + 1}):
                return
        raise Conflict("too many writers")

    @staticmethod
    def _of_batch(manifest: dict, table: str, batch: int) -> list[str]:
        return [p.folder for p in manifest["tables"].get(table, {"parts": []})["parts"] if p.batch == batch]

    def append(self, df: DataFrame, table: str, batch: int) -> None:
        with self.change(batch) as change:
            change.append(df, table)

    def replace(self, df: DataFrame, table: str, batch: int) -> None:
        with self.change(batch) as change:
            change.replace(df, table)

    def compact(self, parts: int = PARTS) -> list[tuple[str, int]]:
        """Rewrite the buckets that consist of more than ``parts`` parts; which ones."""
        done = []
        for table, t in self.manifest()["tables"].items():
            held = [b for p in t["parts"] for b in p.buckets]
            large = sorted({b for b in held if held.count(b) > parts})
            if not large:
                continue
            # the last batch may come again, so it stays as it is
            last = max(p.batch for p in t["parts"])
            old = [p for p in t["parts"] if p.batch < last]
            folder = self.path(f"{table}/rewritten-{uuid.uuid4().hex}")
            rows = self._current(table, t, old, large)
            written = self._write(rows, table, folder)
            part = Part(folder, max(p.batch for p in old), written, rewritten=True)
            for _ in range(COMMITS):
                now = self.manifest()
                known = now["tables"][table]["parts"]
                if {p.folder for p in old} - {p.folder for p in known}:
                    break  # another writer rewrote them
                for p in known:
                    if p.folder in {x.folder for x in old}:
                        p.buckets = [b for b in p.buckets if b not in large]
                        p.gone_buckets = [b for b in p.gone_buckets if b not in large]
                now["tables"][table]["parts"] = [part, *(p for p in known if p.buckets or p.gone_buckets)]
                if self._publish({**now, "version": now["version"] + 1}):
                    done += [(table, b) for b in large]
                    break
        return done

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests before the last ``keep`` and all files that those left don't name; how many folders went."""
        found = self.versions()
        kept = [self.manifest(v) for v in found[-keep:]]
        named = {f.rsplit("/", 1)[1] for m in kept for t in m["tables"].values() for p in t["parts"] for f in (p.folder, p.gone) if f}
        for v in found[:-keep]:
            fs, at = self._fs(self.path(f"_manifests/{v}.json"))
            fs.delete(at, False)
        count = 0
        for table in self._names(self.folder):
            if table.startswith("_"):
                continue
            for name in self._names(self.path(table)):
                if name not in named:
                    fs, at = self._fs(self.path(f"{table}/{name}"))
                    count += fs.delete(at, True)
        return count

    # reading

    def _rows(self, t: dict, parts: list[Part], buckets: list[int] | None = None) -> DataFrame:
        """All rows of the parts, with their batch."""
        schema = T.StructType.fromJson(json.loads(t["schema"])).add("batch", T.LongType())
        paths = [f"{p.folder}/bucket={b}" for p in parts for b in p.buckets if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _current(self, table: str, t: dict, parts: list[Part], buckets: list[int] | None = None) -> DataFrame:
        rows = self._rows(t, parts, buckets)
        key = self.key(table)
        # keys that came again only matter to rows of earlier batches
        first = min((p.batch for p in parts if p.buckets and not p.rewritten), default=None)
        rewritten = any(p.rewritten and p.buckets for p in parts)
        later = [p for p in parts if p.gone_buckets and (rewritten or (first is not None and p.batch > first))]
        paths = [f"{p.gone}/bucket={b}" for p in later for b in p.gone_buckets if buckets is None or b in buckets]
        if not paths:
            return rows
        schema = T.StructType([rows.schema[key], T.StructField("batch", T.LongType())])
        gone = self.spark.read.schema(schema).parquet(*paths).groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_since"))
        gone = F.broadcast(gone) if sum(p.gone_rows for p in later) <= BROADCAST_KEYS else gone
        return rows.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left").filter("_since IS NULL OR batch >= _since").drop("_key", "_since")

    def _table(self, table: str, schema: str | None) -> dict | None:
        found = self.manifest()["tables"].get(table)
        if found is None and schema is None:
            raise KeyError(f"the store has no table {table}")
        return found

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """All rows that any batch wrote, with their ``batch``; of a table that isn't there none, with ``schema``."""
        t = self._table(table, schema)
        return self.spark.createDataFrame([], schema) if t is None else self._rows(t, t["parts"])

    def current(self, table: str, schema: str | None = None, before: int | None = None) -> DataFrame:
        """The rows that no later batch replaced; ``before``: as a batch found them, so that it does the same when it comes again."""
        t = self._table(table, schema)
        if t is None:
            return self.spark.createDataFrame([], schema)
        return self._current(table, t, [p for p in t["parts"] if before is None or p.batch < before]).drop("batch")

    def count(self, table: str) -> int:
        return self.current(table).count()

    def next_batch(self) -> int:
        return 1 + max((p.batch for t in self.manifest()["tables"].values() for p in t["parts"]), default=-1)
