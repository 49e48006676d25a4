"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. Codes are cut into segments of
16 bits, each with an index from segment value to codes. A query's segment radius
grows step by step, one segment at a time: after radius r in segments 0..j (and
r - 1 in the rest) every code within distance m*r + j has been seen (m segments),
since a code that is farther in each would differ in more bits than that. The
search of a query ends once k verified distances are within the covered distance.

The stated queries (ids divisible by ``QUERY_STEP``) meet all rows in blocks: rows are
dealt into blocks of bounded size, each task indexes one block and reads the codes of
the queries, chunk by chunk, from a table in the shared folder, so that neither rows
nor queries are copied by a shuffle. A block gives k rows per query; those are merged
by query. Equal codes of a block are kept once, with their k smallest ids.

Edge cases: null, empty or odd-sized vectors have no code: they are not found and
as queries get no rows; a null or NaN component counts as not positive; ties go to
the smaller id; a query finds itself; repeated rows are found once per row; with
fewer than k codes all are returned; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written
from .storage import read_table
from .textkit import lean

SEGMENT_BITS = 16
K = 10
QUERY_STEP = 50
#: Rows of a block at most and, so that all cores have some, at least; queries searched at once.
BLOCK_ROWS = 500_000
LEAST_ROWS = 5_000
CHUNK_QUERIES = 4_000
#: Verified pairs held at once.
PAIRS = 1 << 20


def code_words(embedding: Column, bits: int) -> Column:
    """Signs of the components as an array of 64-bit words, lowest component first; null unless ``bits`` long."""
    bit = lambda i: F.when(F.get(embedding, F.lit(i)) > 0, F.when(F.isnan(F.get(embedding, F.lit(i))), 0).otherwise(1)).otherwise(0).cast("long")
    words = []
    for w in range(0, bits, 64):
        word = F.lit(0).cast("long")
        for i in range(w, min(w + 64, bits)):
            word = word.bitwiseOR(F.shiftleft(bit(i), i - w))
        words.append(word)
    return F.when(F.size(embedding) == bits, F.array(*words))


@lru_cache
def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(SEGMENT_BITS), radius)], dtype=np.int64)


def segments(codes: np.ndarray) -> np.ndarray:
    """(n, words) uint64 -> (n, segments) int64."""
    return np.ascontiguousarray(codes).view("<u2").reshape(len(codes), -1).astype(np.int64)


class Block:
    """The rows of a block by code and id, and an index of its different codes by each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.lexsort((ids, *codes.T))
        self.ids, codes = ids[order], codes[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)
        self.copies = np.diff(np.append(self.first, len(codes)))
        self.segments = segments(codes[self.first])
        self.index = []
        for s in range(self.segments.shape[1]):
            by = np.argsort(self.segments[:, s], kind="stable")
            self.index.append((by, np.searchsorted(self.segments[by, s], np.arange((1 << SEGMENT_BITS) + 1))))


def search_block(query: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the k nearest rows of a block for each query code."""
    ids, first, copies, seg, index = block.ids, block.first, block.copies, block.segments, block.index
    qseg, m = segments(query), seg.shape[1]
    bits = m * SEGMENT_BITS
    seen = np.zeros((len(query), bits + 1), dtype=np.int64)  # rows verified, by distance
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = np.arange(len(query))
    for r in range(SEGMENT_BITS + 1):
        for j in range(m):
            if not len(open_):
                break
            by, start = index[j]
            flips = masks(r)
            step = max(1, PAIRS // (4 * max(1, len(flips))))
            for a in range(0, len(open_), step):
                part = open_[a : a + step]
                value = (qseg[part, j][:, None] ^ flips[None]).reshape(-1)
                lo, n = start[value], start[value + 1] - start[value]
                owner = np.repeat(part, len(flips))
                some = n > 0
                lo, n, owner = lo[some], n[some], owner[some]
                ends = np.cumsum(n)
                for b, e in _runs(ends):
                    base = ends[b - 1] if b else 0
                    count = n[b:e]
                    q = np.repeat(owner[b:e], count)
                    at = by[np.repeat(lo[b:e] - (ends[b:e] - count - base), count) + np.arange(ends[e - 1] - base)]
                    apart = np.bitwise_count(qseg[q] ^ seg[at])
                    # each code is taken where it is met first: (smallest radius, then segment)
                    fresh = (apart[:, :j] > r).all(axis=1) & (apart[:, j:] >= r).all(axis=1)
                    q, at, d = q[fresh], at[fresh], apart[fresh].sum(axis=1)
                    np.add.at(seen, (q, d), copies[at])
                    hits.append((q, at, d))
            covered = m * r + j
            done = np.cumsum(seen[open_], axis=1)[:, min(covered, bits)] >= k
            open_ = open_[~done]
    if not hits:
        return (np.zeros(0, dtype=np.int64),) * 3
    q, at, d = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((d, q))
    q, at, d = q[order], at[order], d[order]
    # distances beyond that of the k-th row cannot be among the k nearest
    total = np.cumsum(seen, axis=1)
    limit = np.where(total[:, -1] >= k, (total >= k).argmax(axis=1), bits)
    near = d <= limit[q]
    q, at, d = q[near], at[near], d[near]
    count = np.minimum(copies[at], k)
    row = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    q, d, found = np.repeat(q, count), np.repeat(d, count), ids[row]
    order = np.lexsort((found, d, q))
    q, d, found = q[order], d[order], found[order]
    begin = np.searchsorted(q, q)
    top = np.arange(len(q)) - begin < k
    return q[top], found[top], d[top]


def _runs(ends: np.ndarray):
    """Ranges of entries whose pairs together stay near ``PAIRS``."""
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        yield at, stop
        at = stop


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, bits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest rows for every stated query.

    ``bits`` is the vectors' size; by default the most frequent one, of equally frequent ones the larger.
    """
    spark = vectors.sparkSession
    if bits is None:
        sizes = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("bits")).count()
        found = sizes.orderBy(F.col("count").desc(), F.col("bits").desc()).first()
        bits = found[0] if found else 64
    coded = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), code_words(F.col("embedding"), bits).alias("code")).filter("code is not null and vec_id is not null")
    # repeated rows count once each, but no more than k of them can be found
    rows = coded.groupBy("vec_id", "code").agg(F.count(F.lit(1)).alias("rows"))
    rows = written(rows.select("vec_id", "code", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(k)).cast("int"))).alias("copy")), "codes")
    queries = written(rows.filter((F.col("vec_id") % query_step == 0) & (F.col("copy") == 1)).select("vec_id", "code"), "queries", rows=1)
    total, words = rows.count(), -(-bits // 64)
    blocks = max(1, math.ceil(total / BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(total / LEAST_ROWS)))
    files = queries.inputFiles()

    def codes_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), codes_of(b.column(1))) for b in batches if b.num_rows]
        if not held:
            return
        block = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        for file in files:
            asked = read_table(file).combine_chunks()
            for at in range(0, asked.num_rows, CHUNK_QUERIES):
                part = asked.slice(at, CHUNK_QUERIES).to_batches()[0]
                q, found, d = search_block(codes_of(part.column("code")), block, k)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(q)), pa.array(found), pa.array(d.astype(np.int64))], names=["query_id", "vec_id", "distance"])

    small_batches(spark)
    dealt = rows.repartition(blocks, F.xxhash64("vec_id", "code", "copy")).select("vec_id", "code")
    near = dealt.mapInArrow(lean(search), "query_id long, vec_id long, distance long")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
