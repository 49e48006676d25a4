"""Prefix trie of conversations, its subtree totals by messages from the leaves.

A node is a distinct sequence of first turns (role, text); the root is the empty one.
Turns are reduced to digests where they lie; texts do not move.

1. Turns are numbered by a distributed sort: ranges of (conversation, turn) are sorted
   by task, and a conversation that spans tasks gets their offsets, so that one of a
   third of all turns is shared by many tasks.
2. A node's key chains the digests of its turns: within blocks of ``BLOCK`` turns, each
   block a unit of work, and then over a conversation's blocks.
3. Leaf peeling: a node waits for as many children as it has. Nodes that wait for none
   are complete and send their subtree's totals to their parents; the sums of a parent's
   messages are taken where they are sent first. This ends when the root is complete.
4. So that a long unbranched run doesn't take a round a turn, nodes that wait for just one
   child pass their place to it every ``COMPRESS_EVERY`` rounds: pointers double along such
   runs, and the nodes left out get their totals from the run's end afterwards. Any tree
   is done in a number of rounds that grows as the logarithm of its nodes.

Edge cases: a null role or text is empty; a null turn comes first; turns of one number
are ordered by digest; repeated rows are repeated turns; rows without a conv_id are left
out; an empty table has no nodes; a very long text is hashed where it is read; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, erase, join_counted, written
from .textkit import Batches, lean

#: Turns of a block, within which digests are chained by one task.
BLOCK = 1024
#: Rounds of peeling between two steps that shorten unbranched runs.
COMPRESS_EVERY = 4
#: The rebuilding of shared openings: conversations of a family of FAMILY ids open with up to OPENING - 1 turns of its first.
FAMILY = 5
OPENING = 9
#: Bytes of joined ids that are hashed as one piece.
PIECE_BYTES = 1 << 16
ROWS = 1 << 14

ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _short_digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _numbers(batches: Batches) -> Batches:
    """The place of each row in its conversation's run of this task, from 1."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv)))) + 1
        if conv[0] == last:
            place[: start[1] if len(start) > 1 else len(conv)] += count
        last, count = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, digest, n_bytes) of every turn, as a written table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _short_digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes", F.spark_partition_id().alias("part"))
    with batches_of(conversations.sparkSession, ROWS):
        placed = written(dealt.mapInArrow(lean(_numbers), "conv_id long, digest binary, n_bytes long, part int, place long"), "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a task continues one conversation at most, so these are no more rows than there are tasks
    offsets = runs.withColumn("before", before).filter("before is not null").select("conv_id", "part", "before")
    out = placed.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    found = written(out.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "digest", "n_bytes"), "numbered")
    erase(placed)
    return found


def openings(turns: DataFrame, rebuild: bool) -> DataFrame:
    """Per conversation: its base, how many turns of the base open it, how many own ones that drops, and its length then."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    if not rebuild:
        return lengths.select("conv_id", F.col("conv_id").alias("base"), F.lit(0).cast("long").alias("opening"), F.lit(0).cast("long").alias("cut"), F.col("n").alias("total"))
    conv = F.col("conv_id")
    wanted = F.crc32(conv.cast("string").cast("binary")) % OPENING
    plan = lengths.withColumn("base", conv - conv % FAMILY).withColumn("cut", F.when(conv == F.col("base"), F.lit(0)).otherwise(wanted))
    bases = lengths.filter(conv % FAMILY == 0).select(conv.alias("base"), F.col("n").alias("base_n"))
    opening = F.least("cut", F.coalesce("base_n", F.lit(0)))
    return plan.join(bases, "base", "left").select("conv_id", "base", opening.alias("opening"), "cut", (opening + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("total"))


def _chains(size: int):
    """Rows sorted by (conversation, depth): digests chained within blocks; ``before`` is null where a block begins."""

    def run(batches: Batches) -> Batches:
        at, chain = None, None
        for batch in batches:
            before, chained = [], []
            for conv, depth, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = (conv, (depth - 1) // size)
                if block != at:
                    at, chain = block, None
                before.append(chain)
                chain = hashlib.blake2b((chain or b"") + digest, digest_size=16).digest()
                chained.append(chain)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *batch.columns[3:], pa.array(before, pa.binary()), pa.array(chained, pa.binary())], names=["conv_id", "depth", "n_bytes", "last", "before", "chain"]
            )

    return run


def _blocks(batches: Batches) -> Batches:
    """Rows (conversation, block, chain of the whole block), sorted: the key of all turns before the block that follows."""
    at, key = None, None
    for batch in batches:
        keys = []
        for conv, chain in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if conv != at:
                at, key = conv, ROOT
            key = hashlib.sha256(key + chain).digest()[:16]
            keys.append(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + 1), pa.array(keys, pa.binary())], names=["conv_id", "block", "start"])


def paths(turns: DataFrame, plan: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, depth, key, parent, n_bytes, last) of every turn of every conversation, as a written table."""
    spark = turns.sparkSession
    own = join_counted(turns, plan.select("conv_id", "opening", "cut", "total"), "conv_id").filter("position > cut")
    own = own.select("conv_id", (F.col("position") - F.col("cut") + F.col("opening")).alias("depth"), "digest", "n_bytes", "total")
    # of a base no more than OPENING - 1 turns are used, by no more conversations than are in its family
    shared = turns.filter(F.col("position") < OPENING).select(F.col("conv_id").alias("base"), F.col("position").alias("depth"), "digest", "n_bytes")
    opened = shared.join(plan.filter("opening > 0").select("conv_id", "base", "opening", "total"), "base").filter("depth <= opening").select("conv_id", "depth", "digest", "n_bytes", "total")
    rows = own.unionByName(opened).select("conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("total")).alias("last"))
    block = F.expr(f"(depth - 1) div {size}")
    with batches_of(spark, ROWS):
        dealt = rows.repartition("conv_id", block).sortWithinPartitions("conv_id", "depth")
        chained = written(dealt.mapInArrow(lean(_chains(size)), "conv_id long, depth long, n_bytes long, last boolean, before binary, chain binary"), "chained")
        whole = chained.filter(F.col("depth") % size == 0).select("conv_id", block.alias("block"), "chain").repartition("conv_id").sortWithinPartitions("conv_id", "block")
        starts = written(whole.mapInArrow(lean(_blocks), "conv_id long, block long, start binary"), "block-starts")
    first = chained.filter(F.col("depth") <= size).withColumn("start", F.lit(ROOT))
    later = chained.filter(F.col("depth") > size).withColumn("block", block).join(starts, ["conv_id", "block"]).select(*first.columns)
    key = _short_digest(F.col("start"), F.col("chain"))
    parent = F.when(F.col("before").isNull(), F.col("start")).otherwise(_short_digest(F.col("start"), F.col("before")))
    found = written(first.unionByName(later).select("conv_id", "depth", key.alias("key"), parent.alias("parent"), "n_bytes", "last"), "paths")
    erase(chained, starts)
    return found


def _shorten(state: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The state without the nodes that wait for one child, and those nodes with the end of their run, or None if there are none.

    What a run adds (``saved``, ``leaves``) goes with the message of its end (``up_saved``, ``up_leaves``).
    """
    waits = state.filter((F.col("waiting") == 1) & F.col("parent").isNotNull())
    child = state.select(F.col("key").alias("end"), F.col("parent").alias("key"), "up_saved", "up_leaves")
    runs = waits.select("key", "saved", "leaves").join(child, "key")
    runs = written(runs.select("key", "end", (F.col("saved") + F.col("up_saved")).alias("saved"), (F.col("leaves") + F.col("up_leaves")).alias("leaves")), "runs")
    if not runs.count():
        erase(runs)
        return None
    while True:
        ahead = runs.select(F.col("key").alias("end"), F.col("end").alias("further"), F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))
        hops = runs.join(ahead, "end", "left")
        hops = hops.select(
            "key", F.coalesce("further", "end").alias("end"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), F.col("further").isNotNull().alias("moved")
        )
        last, runs = runs, written(hops, "runs")
        erase(last)
        if not runs.filter("moved").limit(1).count():
            break
    path, runs = runs.table_path, runs.drop("moved")
    runs.table_path = path
    # the end of a run takes the place of the run's top under the top's parent
    tops = runs.join(waits.select("key", "parent", "up_saved", "up_leaves"), "key").join(waits.select(F.col("key").alias("parent"), F.lit(1).alias("inside")), "parent", "left").filter("inside is null")
    moves = tops.select(F.col("end").alias("key"), F.col("parent").alias("new_parent"), (F.col("saved") + F.col("up_saved")).alias("new_saved"), (F.col("leaves") + F.col("up_leaves")).alias("new_leaves"))
    left = state.filter((F.col("waiting") != 1) | F.col("parent").isNull()).join(moves, "key", "left")
    moved = lambda new, old: F.when(F.col("new_parent").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    left = left.select("key", moved("new_parent", "parent"), "waiting", "saved", "leaves", moved("new_saved", "up_saved"), moved("new_leaves", "up_leaves"))
    return left, runs


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(key, saved, leaves, n_children) summed over each node's subtree; ``nodes`` has key, parent (null: the root) and its own ``saved``."""
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("waiting"))
    zero = F.lit(0).cast("long")
    state = nodes.join(children, "key", "left").select("key", "parent", F.coalesce("waiting", zero).alias("waiting"), "saved", F.when(F.col("waiting").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves"), zero.alias("up_saved"), zero.alias("up_leaves"))
    state = start = written(state, "trie")
    complete, runs, spent, rounds = [], [], [], 0
    while state.limit(1).count():
        if rounds % COMPRESS_EVERY == 0 and (shorter := _shorten(state)) is not None:
            spent.append(state)
            state = written(shorter[0], "trie")
            runs.append((len(complete), shorter[1]))
        rounds += 1
        complete.append(written(state.filter("waiting = 0").select("key", "parent", "saved", "leaves", "up_saved", "up_leaves"), "complete"))
        sent = complete[-1].groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("saved") + F.col("up_saved")).alias("more_saved"), F.sum(F.col("leaves") + F.col("up_leaves")).alias("more_leaves"))
        left = state.filter("waiting > 0").join(sent, "key", "left")
        left = left.select(
            "key", "parent", (F.col("waiting") - F.coalesce("n", zero)).alias("waiting"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), "up_saved", "up_leaves"
        )
        spent.append(state)
        state = written(left, "trie")
    # nodes left out get their totals from the end of their run, the last ones first
    at, totals = len(complete), None
    for since, run in reversed([(0, None), *runs]):
        for table in complete[since:at]:
            rows = table.select("key", "saved", "leaves")
            totals = rows if totals is None else totals.unionByName(rows)
        at = since
        if run is not None:
            ends = totals.select(F.col("key").alias("end"), F.col("saved").alias("end_saved"), F.col("leaves").alias("end_leaves"))
            totals = written(totals.unionByName(run.join(ends, "end").select("key", (F.col("saved") + F.col("end_saved")).alias("saved"), (F.col("leaves") + F.col("end_leaves")).alias("leaves"))), "totals")
            spent.append(totals)
    if totals is None:
        totals = start.select("key", "saved", "leaves")
    out = written(totals.join(start.select("key", F.col("waiting").alias("n_children")), "key"), "trie-totals")
    erase(state, *spent, *complete, *(run for _, run in runs))
    return out


def _pieces(batches: Batches) -> Batches:
    """Rows (key, id) in order: the ids of a key as text, joined by commas, in pieces."""

    def piece(key: bytes, first: int, ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first]), pa.array([",".join(map(str, ids)).encode()], pa.binary())], names=["key", "first", "ids"])

    at, held = None, []
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != at or len(held) * 8 >= PIECE_BYTES:
                if held:
                    yield piece(at, held[0], held)
                at, held = key, []
            held.append(conv)
    if held:
        yield piece(at, held[0], held)


def _hashes(batches: Batches) -> Batches:
    """Rows (key, first id, piece) in order: SHA-256 of a key's pieces, joined by commas."""
    at, state, out = None, None, []
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == at:
                state.update(b"," + piece)
                continue
            if at is not None:
                out.append((at, state.hexdigest()))
            at, state = key, hashlib.sha256(piece)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["key", "ends_sha256"])
        out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from rows (key, conv_id), as a written table. Ids of a key are sorted
    and joined by many tasks; one task only hashes the finished pieces."""
    with batches_of(ends.sparkSession, ROWS):
        ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        pieces = ranged.mapInArrow(lean(_pieces), "key binary, first long, ids binary").repartition("key").sortWithinPartitions("key", "first")
        return written(pieces.mapInArrow(lean(_hashes), "key binary, ends_sha256 string"), "ends")


def trie(conversations: DataFrame, rebuild: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per node: smallest member, depth, the parent's smallest member, members, children,
    leaves and savable bytes of its subtree, and a hash of the members that end there.

    ``rebuild``: a conversation c first opens with the first turns of conversation c - c % 5, as many as the crc32 of its id modulo 9.
    """
    turns = numbered(conversations)
    plan = written(openings(turns, rebuild), "openings")
    rows = paths(turns, plan, block)
    grouped = rows.groupBy("key", "parent", "depth", "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "conv_id", "n_convs")
    nodes = written(grouped.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes"), "nodes")
    ends = end_hashes(rows.filter("last").select("key", "conv_id").unionByName(plan.filter("total = 0").select(F.lit(ROOT).alias("key"), "conv_id")))
    totals = subtree_totals(nodes.select("key", "parent", "saved"))
    parents = written(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(totals.filter("n_children > 0").select(F.col("key").alias("parent")), "parent"), "parents")
    full = nodes.drop("saved").join(totals, "key").join(ends, "key", "left")
    out = join_counted(full, parents, "parent", "left")
    found = written(
        out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")), "prefix-trie"
    )
    erase(turns, plan, rows, nodes, ends, totals, parents)
    return found
