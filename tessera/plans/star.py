"""The star-schema tables seen as tables of the knowledge model.

A session is a customer's orders, a knowledge fact a delivery (supplier provides
part), a tool call an event, a message a turn of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import CATALOGUE, slug, triple_id


#: Deliveries that one task groups; so a task's memory does not depend on the size of the tables.
TASK_ROWS = 250_000
#: Rows of a dimension up to which it is sent to every executor.
BROADCAST_ROWS = 1_000_000


class Star:
    """Lazily built views over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, name: str = "lineitem", rows: int | None = None) -> int:
        """How many tasks share the rows of a table (counted in its files' footers). Adaptive execution merges
        partitions by compressed bytes, which keys and repeated names have few of; a number given stays."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table(name).count() // (rows or TASK_ROWS)))

    def _looked_up(self, rows: DataFrame, key: str, names: DataFrame, name_key: str, large: bool, tasks: int) -> DataFrame:
        """``rows`` with what ``names`` says of their key; a large dimension is shuffled."""
        if large:
            rows, names = rows.repartition(tasks, key), names.repartition(tasks, name_key)
        return rows.join(names if large else F.broadcast(names), F.col(key) == F.col(name_key))

    def sessions(self) -> DataFrame:
        """One row per customer with orders."""
        bounds = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("modified"))
        people = self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        return bounds.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_custkey").alias("session"),
            F.col("c_mktsegment").alias("platform"),
            "created",
            "modified",
            F.col("n_name").alias("project"),
            F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("source_file"),
        )

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
        )

    def tool_calls(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("tool_id"), F.col("event_type").alias("tool_name"), F.col("user_id").alias("session"), F.col("ts").alias("created"), F.col("props").alias("description"))

    def _named(self, table: str, key: str, name: str, role: str, only: Column | None = None) -> DataFrame:
        """Per key of a dimension (where ``only`` holds of its name): one key for all that share its name, the name and its slug."""
        rows = self.table(table).select(key, F.col(name).alias(f"{role}_name"))
        rows = rows if only is None else rows.filter(only)
        names = rows.groupBy(f"{role}_name").agg(F.min(key).alias(f"{role}_key"))
        return rows.join(names, f"{role}_name").select(f"{role}_key", f"{role}_name", slug(F.col(f"{role}_name")).alias(role), key)

    def facts(self, subjects: Column | None = None, objects: Column | None = None) -> DataFrame:
        """Knowledge facts: distinct by triple id (subject, predicate, object and message);
        only those whose ``subj_name`` and ``obj_name`` meet the conditions, if given.

        Facts are made distinct as three numbers, before they get their names and texts;
        conditions on names select keys before that, so that they reach the deliveries.
        Dimensions of up to ``BROADCAST_ROWS`` rows, and names if there are no more
        of them, are broadcast.
        """
        large = {t: self.table(t).count() > BROADCAST_ROWS for t in ("supplier", "part")}
        subjects, objects = self._named("supplier", "s_suppkey", "s_name", "subj", subjects), self._named("part", "p_partkey", "p_name", "obj", objects)
        tasks = self.tasks()
        rows = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
        rows = self._looked_up(rows, "l_suppkey", subjects.select("s_suppkey", "subj_key"), "s_suppkey", large["supplier"], tasks)
        rows = self._looked_up(rows, "l_partkey", objects.select("p_partkey", "obj_key"), "p_partkey", large["part"], tasks)
        # dealt by message once: what is distinct or grouped within messages needs no other shuffle
        keys = rows.select("l_orderkey", "subj_key", "obj_key").repartition(tasks, "l_orderkey").distinct()
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").repartition(tasks, "o_orderkey")
        rows = keys.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        for names, key, role, table in ((subjects, "s_suppkey", "subj", "supplier"), (objects, "p_partkey", "obj", "part")):
            own = names.filter(F.col(key) == F.col(f"{role}_key")).select(F.col(f"{role}_key").alias("own_key"), f"{role}_name", role)
            few = not large[table] or own.count() <= BROADCAST_ROWS
            rows = self._looked_up(rows, f"{role}_key", own, "own_key", not few, tasks).drop("own_key")
        return rows.select(
            "subj_name",
            F.lit("provides").alias("predicate"),
            "obj_name",
            "subj",
            "obj",
            F.col("l_orderkey").alias("message_id"),
            F.col("o_custkey").alias("session"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"),
        ).withColumn("triple_id", triple_id(F.col("subj_name"), F.col("predicate"), F.col("obj_name"), F.col("message_id").cast("string")))

    def static_facts(self) -> DataFrame:
        """Facts outside messages: places, makers and kinds (subject, predicate, object)."""
        nation, region, part, supplier = (self.table(t) for t in ("nation", "region", "part", "supplier"))
        triple = lambda s, p, o: (F.col(s).alias("subj_name"), F.lit(p).alias("predicate"), F.col(o).alias("obj_name"))
        return (
            nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*triple("n_name", "isPartOf", "r_name"))
            .unionByName(part.select(*triple("p_name", "isTypeOf", "p_type")))
            .unionByName(part.select(*triple("p_name", "builtWith", "p_brand")))
            .unionByName(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*triple("s_name", "deployedOn", "n_name")))
            .distinct()
        )

    def candidates(self) -> DataFrame:
        """Link candidates of each part name: its first five parts by key, with made-up attributes."""
        rank = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
        key = F.col("p_partkey")
        return (
            self.table("part").withColumn("rank", rank).filter("rank <= 5")
            .select(
                F.col("p_name").alias("query_label"),
                "rank",
                F.concat(F.lit("Q"), (key % 97).cast("string")).alias("qid"),
                F.when(key % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("label"),
                F.when(key % 2 == 0, F.concat(F.col("p_brand"), F.lit(" software framework"))).otherwise(F.concat(F.col("p_brand"), F.lit(" thing"))).alias("description"),
                F.when(key % 5 == 0, F.array("p_type", "p_name")).otherwise(F.array("p_type")).alias("aliases"),
            )
        )

    def links(self) -> DataFrame:
        """Links of object entities: to the catalogue, and between entities of one catalogue item."""
        names = self.table("part").select("p_name").distinct()
        first = self.candidates().filter("rank = 1").select("query_label", "qid")
        outer = names.join(first, F.col("p_name") == F.col("query_label")).select(slug(F.col("p_name")).alias("entity"), F.col("p_name").alias("label"), F.concat(F.lit(CATALOGUE), F.col("qid")).alias("same_as"))
        inner = names.select(slug(F.col("p_name")).alias("entity"), F.col("p_name").alias("label"), F.concat(F.lit("entity/"), slug(F.col("p_name"))).alias("same_as"))
        return outer.unionByName(inner)
