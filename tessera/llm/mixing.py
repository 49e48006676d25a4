"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

DataFrame operations only. Each source gets a target of words (weights over a
share of all words, capped at a multiple of the source, the excess reshared).
Rows are dealt into shards by a seeded hash of their content, so that a (shard, source)
cell is of bounded size even where one source holds a third of all rows, and the mix
does not depend on how rows are partitioned. In every shard the sources compete for
the shard's blocks by the quotients target / (2s - 1), targets counted in blocks; the
seats won are the source's integer quota. A cell's words, in seeded order, form a
stream cut into equal blocks, as many as come nearest to ``block`` words each; a cell
too small for ``FEWEST`` such blocks is cut into as many smaller ones, down to single
words, so that quotas in whole blocks come near the targets of small sources too. The
quota is met by whole passes over the stream plus the blocks that come first by a
seeded hash. A document takes the words of it that lie in chosen blocks.

Edge cases: a null or blank text has size 0 and takes 0; a null source is a
source of its own, ordered last; repeated rows are documents of their own, numbered
where they are equal and so dealt apart; ties of quotients go to the source of the
lesser name; a very long text is one row with as many words, cut by blocks like any;
an empty table gives an empty result; further columns take no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, join_counted, release, written

#: Words of a block, about, and rows of a shard on average.
BLOCK_WORDS = 128
SHARD_ROWS = 25_000
#: Blocks of a cell at least, if it has as many words.
FEWEST = 100
WEIGHTS = (3, 1, 2)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = 2) -> DataFrame:
    """One row per source: its words and its target (150% of all words, by weight).

    Targets stop at ``repeat`` times the source. With sources in order of
    cap / weight, the first whose fair share of what is left does not exceed its
    cap fixes the share per unit of weight for itself and all that follow.
    All products are of integers, so the result does not depend on summation order.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, total = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = (
        ranked.withColumn("cap", F.col("source_size") * repeat)
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("left2", F.sum("source_size").over(total) * 3 - F.coalesce(F.sum("cap").over(before), F.lit(0)) * 2)
        .withColumn("weight_left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("free", F.when(F.col("left2") * F.col("weight") <= F.col("cap") * F.col("weight_left") * 2, F.struct("at", "left2", "weight_left")))
        .withColumn("from", F.min("free").over(total))
    )
    share = F.col("weight") * F.col("from.left2") / (F.col("from.weight_left") * 2)
    return steps.select("skey", "source_size", F.when(F.col("at") < F.col("from.at"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def quotas(cells: DataFrame) -> DataFrame:
    """Seats of each cell: in each shard the highest quotients target / (2s - 1) win.

    ``cell_target`` is in blocks. A divisor method keeps the seats of a cell within
    (n + 1) / 2 * target / total + 1/2 of its target, so only the seats in that
    range compete; those below it are won in any case.
    """
    shard = Window.partitionBy("shard")
    contest = (
        cells.filter(F.col("cell_target") > 0)
        .withColumn("all_target", F.sum("cell_target").over(shard))
        .withColumn("n", F.count(F.lit(1)).over(shard))
        .withColumn("slack", F.col("cell_target") / F.col("all_target") * (F.col("n") + 1) / 2 + 1)
        .withColumn("low", F.greatest(F.lit(0), F.floor(F.col("cell_target") - F.col("slack"))).cast("long"))
        .withColumn("high", F.ceil(F.col("cell_target") + F.col("slack")).cast("long"))
        .withColumn("open", F.round("all_target").cast("long") - F.sum("low").over(shard))
    )
    seats = contest.withColumn("seat", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    order = Window.partitionBy("shard").orderBy((F.col("cell_target") / (F.col("seat") * 2 - 1)).desc(), "skey", "seat")
    won = seats.withColumn("place", F.row_number().over(order))
    return won.groupBy("shard", "skey", "low").agg(F.count(F.when(F.col("place") <= F.col("open"), 1)).alias("more")).select("shard", "skey", (F.col("low") + F.col("more")).alias("quota"))


def identity(*parts: Column) -> Column:
    """What a row's lot is drawn by; null parts are left out."""
    return F.md5(F.concat_ws("|", *parts))


def _numbered(sized: DataFrame) -> DataFrame:
    """Adds copy, the number of a row among those of one identity.

    Counted by identity and part of the table, then over the parts, so that no task
    holds all rows of one identity. Which of equal rows has which number is of no consequence.
    """
    repeated = written(sized.groupBy("same").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("same"), "repeated", rows=1)
    if not repeated.take(1):
        return sized.withColumn("copy", F.lit(0).cast("long"))
    again = join_counted(sized, repeated, "same", "left_semi").withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy("same", "part").agg(F.count(F.lit(1)).alias("rows")).select("same", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    local = again.withColumn("local", F.row_number().over(Window.partitionBy("same", "part").orderBy("row")))
    numbered = local.join(counts, ["same", "part"]).withColumn("copy", F.col("base") + F.col("local") - 1)
    return join_counted(sized, repeated, "same", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(numbered.select(*sized.columns, "copy"))


def _dealt(rows: DataFrame, block: int, shard_rows: int, seed: str, weights: tuple[int, ...], repeat: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per source the targets; every block with its copies; every row with its place in its cell's stream.

    ``rows``: key (handed on), row (unique), same (see ``identity``), source and size.
    """
    sized = written(rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "sized")
    total = sized.count()
    sized = _numbered(sized).withColumn("lot", identity(F.lit(seed), F.col("same"), F.col("copy").cast("string")))
    shards = max(1, math.ceil(total / shard_rows))
    sized = sized.withColumn("shard", (F.conv(F.substring("lot", 1, 8), 16, 10).cast("long") % shards).cast("int"))
    targets = source_targets(sized, weights, repeat)
    cells = (
        sized.groupBy("shard", "skey").agg(F.sum("size").alias("cell_size"))
        .join(targets, "skey")
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("cell_size") / block), F.least(F.col("cell_size"), F.lit(FEWEST))).cast("long"))
        .withColumn("cell_target", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    )
    cells = written(cells, "cells", rows=total)
    release(cells.sparkSession)
    cell = Window.partitionBy("shard", "skey")
    start_of = lambda j: F.expr(f"({j} * cell_size) div blocks")
    chosen = (
        cells.filter(F.col("cell_size") > 0).join(quotas(cells), ["shard", "skey"], "left")
        .withColumn("quota", F.least(F.coalesce("quota", F.lit(0)), F.col("blocks") * repeat))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("place", F.row_number().over(cell.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "skey", F.col("shard").cast("string"), F.col("block").cast("string"))), "block")))
        .withColumn("passes", F.floor(F.col("quota") / F.col("blocks")))
        .withColumn("copies", F.col("passes") + F.when(F.col("place") <= F.col("quota") % F.col("blocks"), 1).otherwise(0))
        .withColumn("start", start_of("block"))
        .withColumn("words", start_of("(block + 1)") - F.col("start"))
        .withColumn("before", F.coalesce(F.sum(F.col("copies") * F.col("words")).over(cell.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("shard", "skey", "block", "start", "words", "passes", "copies", "before")
    )
    stream = cell.orderBy("lot", "row").rowsBetween(Window.unboundedPreceding, -1)
    block_of = lambda word: F.expr(f"(({word} + 1) * blocks - 1) div cell_size")
    placed = (
        sized.withColumn("begin", F.coalesce(F.sum("size").over(stream), F.lit(0)))
        .join(cells.select("shard", "skey", "blocks", "cell_size"), ["shard", "skey"])
        .withColumn("block_a", F.when(F.col("size") > 0, block_of("begin")))
        .withColumn("block_b", F.when(F.col("size") > 0, block_of("(begin + size - 1)")))
    )
    return targets, chosen, placed


def mix(documents: DataFrame, key: str = "doc_id", block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, repeat: int = 2) -> DataFrame:
    """``key``, size, source_size, target and taken of every row of ``documents``."""
    rows = documents.select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), identity(F.col(key).cast("string"), F.md5("text"), F.col("source")).alias("same"), "source", word_count(F.col("text")).alias("size")
    )
    targets, chosen, placed = _dealt(rows, block, shard_rows, seed, weights, repeat)
    side = lambda x: chosen.select("shard", "skey", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "start", "copies", "before")])
    first, last = side("a"), side("b")
    until = lambda at, x: F.col(f"before_{x}") + F.col(f"copies_{x}") * (at - F.col(f"start_{x}"))
    taken = until(F.col("begin") + F.col("size"), "b") - until(F.col("begin"), "a")
    return (
        placed.join(first, ["shard", "skey", "block_a"], "left")
        .join(last, ["shard", "skey", "block_b"], "left")
        .join(targets, "skey")
        .select(F.col("key").alias(key), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce(taken, F.lit(0))).otherwise(0).cast("long").alias("taken"))
    )


def spans(rows: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, repeat: int = 2) -> DataFrame:
    """row, whole and cuts of every row that the mix takes words of: how often the
    document is taken whole, and each further run of its words, (first word, words), in order.

    ``rows``: row, same, source and size. A row meets each of its blocks by a join of
    narrow rows; a run of adjacent blocks is counted at the first of them that the document reaches.
    """
    _, chosen, placed = _dealt(rows, block, shard_rows, seed, weights, repeat)
    run = Window.partitionBy("shard", "skey", "more", "run")
    blocks = (
        chosen.withColumn("more", F.col("copies") > F.col("passes"))
        .withColumn("run", F.col("block") - F.row_number().over(Window.partitionBy("shard", "skey", "more").orderBy("block")))
        .withColumn("run_block", F.min("block").over(run))
        .withColumn("run_start", F.min("start").over(run))
        .withColumn("run_end", F.max(F.col("start") + F.col("words")).over(run))
        .select("shard", "skey", "block", "passes", "more", "run_block", "run_start", "run_end")
    )
    low = F.greatest(F.col("run_start") - F.col("begin"), F.lit(0))
    high = F.least(F.col("run_end") - F.col("begin"), F.col("size"))
    reached = F.col("more") & (F.col("block") == F.greatest("block_a", "run_block"))
    met = (
        placed.filter(F.col("size") > 0)
        .select("row", "size", "shard", "skey", "begin", "block_a", F.explode(F.sequence("block_a", "block_b")).alias("block"))
        .join(blocks, ["shard", "skey", "block"])
        .filter((F.col("passes") > 0) & (F.col("block") == F.col("block_a")) | reached)
        .select("row", "size", "passes", F.when(reached, F.struct(low.alias("first"), (high - low).alias("words"))).alias("cut"))
    )
    held = met.groupBy("row").agg(F.first("size").alias("size"), F.first("passes").alias("passes"), F.sort_array(F.collect_list("cut")).alias("cuts"))
    full = F.coalesce(F.get("cuts", F.lit(0))["words"] == F.col("size"), F.lit(False))
    return held.select(
        "row",
        (F.col("passes") + full.cast("int")).cast("int").alias("whole"),
        F.when(full, F.slice("cuts", 1, 0)).otherwise(F.col("cuts")).alias("cuts"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of ``documents``: a document appears whole
    as often as all of it is taken, and once more for each further run of its words that
    lies in chosen blocks, cut to that run. A run keeps the white space between its words."""
    columns = documents.columns
    keyed = written(documents.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "mix-rows")
    text = F.col("doc.text")
    others = F.to_json(F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in columns if c != "text"]))
    sized = keyed.select("row", identity(F.md5(text), others).alias("same"), F.col("doc.source").alias("source"), word_count(text).alias("size"))
    joined = keyed.join(spans(sized, **options), "row")
    text_of = lambda words, cut: F.array_join(F.slice(words, (cut["first"] + 1).cast("int"), cut["words"].cast("int")), "")
    trimmed = lambda cut, text: F.when(cut["first"] > 0, F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")).otherwise(text)
    # the words are an argument of the outer transform, so a text is taken apart once, however many runs it has
    parts = F.flatten(
        F.transform(
            F.array(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))),
            lambda words: F.transform("cuts", lambda cut: trimmed(cut, text_of(words, cut))),
        )
    )
    none = F.array().cast("array<string>")
    uses = joined.withColumn("use", F.explode(F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("whole")), F.when(F.size("cuts") > 0, parts).otherwise(none))))
    made = {"text": F.coalesce("use", text)}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("use").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("use")).cast(documents.schema["n_chars"].dataType)
    return uses.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])
