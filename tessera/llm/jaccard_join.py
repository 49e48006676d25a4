"""Similarity join on word shingles by chosen paths.

Documents become sets of hashed ``WORDS``-word shingles; equal sets are one node.
A node samples its ``SAMPLE`` smallest tokens. In each of several runs every node
chooses sampled tokens by a hash under a threshold (1 / similarity tokens are
expected); nodes that choose the same token share a bucket. A pair at the
threshold misses all buckets of one run with probability 1/e, so runs are
repeated until the target recall. Buckets of at most ``BRUTE`` nodes are compared
pair by pair on 128-bit sketches.

A larger bucket is split again. Tokens that most of it has (a passage in a third
of all texts, the body of a large group of near copies) would not split it, so
they are found by the votes of ``LEADERS`` random members and left out of the
further choice, which is dense enough for the tokens that remain to keep the
recall, with as many runs as that needs (``runs_within``). A node whose sample is common to the bucket in more than ``CORE`` of it has
too little left to choose from: such nodes, near copies of each other, are
compared in pairs of blocks, and with those that have more than ``ZONE``. At the
last depth a large bucket is compared in pairs of blocks altogether, so none is
ever capped.

Buckets give only the edges of a spanning forest, never all pairs. Its connected
components are then verified exactly: the shingle sets of a component are
intersected by blocked products, which gives each node's links and, from true
links alone, the final classes. So a link is found wherever its ends are in one
component, and no link is reported that was not verified. Blocks are bounded by
tokens (``VERIFY_TOKENS``); a group of b blocks ships each of its sets b times.

Results per row: class_id (least doc_id of the class), n_links (rows, copies
included, with similarity of at least the threshold).

Edge cases: a text of fewer than ``WORDS`` words has one shingle, all its words; a
text without words (null, empty, blank) links to nothing and is its own class;
repeated rows are copies of each other; similarities that equal the threshold are
links, and of equal candidates for a class_id the least is taken; a very long text
is one set, made stretch by stretch and held whole, with 8 bytes a word; a row with null
doc_id takes no part and has null class_id; an empty table gives no rows; further
columns are ignored. Sets are told apart by 128 bits of hash, nodes by a number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import batches_of, erase, join_counted, release, small_batches, unused, written
from .textkit import lean, mix64, shingles, slices, utf8

WORDS = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.9999
SAMPLE = 64
#: Most nodes of a bucket compared in one go; depth of splitting.
BRUTE = 4096
DEPTH = 4
#: Members that vote on the tokens common to a bucket.
LEADERS = 9
#: Shares of common tokens in a sample from which a node is compared with the core, and is core itself.
ZONE, CORE = 0.4, 0.75
#: Sketch bits that must agree: expected 115 of 128 at similarity 0.8, 64 at 0.
SKETCH_AGREE = 98
#: Tokens of a block of sets intersected with another in one task.
VERIFY_TOKENS = 1 << 19
_SKETCH = 128
_MULTIPLIERS = mix64(np.arange(1, _SKETCH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def runs_for(recall: float = RECALL, similarity: float = float(SIMILARITY)) -> int:
    """Runs of 1 / similarity expected choices that reach ``recall`` at the threshold."""
    return math.ceil(math.log(1 / (1 - recall)))


def runs_within(runs: int, recall: float = RECALL) -> int:
    """Runs within each large bucket that keep ``recall``.

    A pair at the threshold shares ``runs`` buckets in expectation, and k runs within a
    bucket find it there with 1 - exp(-k); so all miss it with exp(-runs * (1 - exp(-k))).
    """
    needed = math.log(1 / (1 - recall)) / runs
    return max(1, math.ceil(-math.log(1 - needed))) if needed < 1 else runs


def sketch(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 one-bit min-hashes per set, as two words; zero for an empty set."""
    out = np.zeros((len(begin) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    for i, m in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(tokens * m, begin[full])
        out[full, i // 64] |= (mix64(least) & np.uint64(1)) << np.uint64(i % 64)
    return out


def chosen(tokens: np.ndarray, per_set: np.ndarray, path: np.ndarray | int, runs: int, common: np.ndarray | int = 0) -> np.ndarray:
    """Which sampled tokens any run chooses; ``per_set`` is the sample size of each token's set,
    ``common`` how many of them cannot be chosen. A pair at the threshold shares
    similarity * per_set tokens, and one of those open to choice is expected per run."""
    limit = 1 / np.maximum(float(SIMILARITY) * per_set - common, 1.0)
    limit = (limit * (2.0**64 - 2048)).astype(np.uint64)
    hit = np.zeros(len(tokens), dtype=bool)
    for r in range(runs):
        salt = mix64(np.atleast_1d(np.asarray(path, dtype=np.uint64)) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        hit |= mix64(tokens ^ salt) <= limit
    return hit


_NODE_FIELDS = "n long, h1 long, h2 long, s1 long, s2 long, sample binary, paths array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def nodes_of(texts: list[bytes], runs: int) -> dict[str, np.ndarray | list]:
    tokens, begin = shingles(texts, WORDS)
    n = np.diff(begin)
    full = n > 0
    sums = np.zeros((2, len(n)), dtype=np.uint64)
    if len(tokens):
        at = begin[:-1][full]
        sums[0, full] = np.add.reduceat(mix64(tokens), at)
        sums[1, full] = np.add.reduceat(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
    size = np.minimum(n, SAMPLE)
    doc = np.repeat(np.arange(len(n)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    sample = tokens[begin[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]]  # tokens of a set are sorted
    hit = chosen(sample, size[doc], 0, runs)
    paths = np.split(_signed(sample[hit]), np.cumsum(np.bincount(doc[hit], minlength=len(n)))[:-1])
    bits = sketch(tokens, begin)
    raw = sample.astype("<u8").tobytes()
    return {
        "n": n, "h1": _signed(mix64(sums[0]) + n.astype(np.uint64)), "h2": _signed(sums[1]), "s1": _signed(bits[:, 0]), "s2": _signed(bits[:, 1]),
        "sample": [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], "paths": paths,
        "tokens": tokens, "begin": begin,
    }


def _shingled(documents: DataFrame, runs: int) -> DataFrame:
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {_NODE_FIELDS}"
    names = ["doc_id", *(x.split()[0] for x in _NODE_FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                x = nodes_of(texts[a:b], runs)
                columns = [pa.array(x[c], pa.int64()) for c in names[1:6]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, pa.array(x["sample"], pa.binary()), pa.array(x["paths"], pa.list_(pa.int64()))], names=names)

    return documents.select("doc_id", "text").mapInArrow(lean(run), schema)


def _common(leaders: DataFrame) -> DataFrame:
    """(path, common): the sampled tokens that most leaders of a bucket have, from rows (path, samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for samples in batch.column(1).to_pylist():
                token, votes = np.unique(np.concatenate([np.frombuffer(x, dtype="<u8") for x in samples]), return_counts=True)
                common.append(token[2 * votes > len(samples)].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(common, pa.binary())], names=["path", "common"])

    return leaders.mapInArrow(lean(run), "path long, common binary")


def _split(rows: DataFrame, runs: int) -> DataFrame:
    """Rows (node, sample, path, s1, s2, n, common) of large buckets under the paths of their next choice
    (kind 0), as core of their bucket (kind 1), and as its zone (kind 2)."""
    names = ["kind", "path", "node", "s1", "s2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(2).to_numpy().view(np.uint64)
            sample = [np.frombuffer(x, dtype="<u8") for x in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in sample])
            row, tokens = np.repeat(np.arange(len(sample)), size), np.concatenate(sample)
            shared = dict(zip(path.tolist(), batch.column(6).to_pylist(), strict=True))
            known = [mix64(np.frombuffer(x, dtype="<u8") ^ mix64(np.array([p], dtype=np.uint64))) for p, x in shared.items()]
            common = np.isin(mix64(tokens ^ mix64(path)[row]), np.concatenate(known))
            count = np.bincount(row[common], minlength=len(sample))
            share = count / size
            hit = chosen(tokens, size[row], path[row], runs, count[row]) & ~common & (share <= CORE)[row]
            longer = mix64(path[row[hit]] * np.uint64(0x9E3779B97F4A7C15) + tokens[hit])
            near = np.flatnonzero(share >= ZONE)
            kind = np.concatenate([np.zeros(len(longer), dtype=np.int32), np.where(share[near] > CORE, 1, 2).astype(np.int32)])
            pick = pa.array(np.concatenate([row[hit], near]))
            columns = [pa.array(kind), pa.array(_signed(np.concatenate([longer, path[near]]))), batch.column(0).take(pick), *(batch.column(i).take(pick) for i in (3, 4, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("node", "sample", "path", "s1", "s2", "n", "common").mapInArrow(lean(run), "kind int, path long, node long, s1 long, s2 long, n long")


class Forest:
    """Union of adjacent items; ``edges`` holds the pairs that joined two trees."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.members = {i: [i] for i in range(size)}
        self.edges: list[tuple[int, int]] = []

    def join(self, item: int, others: np.ndarray) -> None:
        label, first = np.unique(self.label[others], return_index=True)
        own = int(self.label[item])
        for lab, at in zip(label.tolist(), first.tolist(), strict=True):
            if lab != own:
                mine = int(self.label[item])
                self.edges.append((item, int(others[at])))
                small, big = sorted((mine, lab), key=lambda x: len(self.members[x]))
                moved = self.members.pop(small)
                self.label[moved] = big
                self.members[big] += moved


def alike(s: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Earlier items whose sketch and size allow the similarity with item ``i``."""
    agree = _SKETCH - np.bitwise_count(s[:i] ^ s[i]).sum(axis=1, dtype=np.int64)
    close = SIMILARITY.denominator * np.minimum(n[:i], n[i]) >= SIMILARITY.numerator * np.maximum(n[:i], n[i])
    return np.flatnonzero((agree >= SKETCH_AGREE) & close)


def forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of each bucket in a stream sorted by its key columns.

    Columns: key (any number), then node, s1, s2, n. A bucket has at most
    twice ``BRUTE`` rows, so what is held is bounded.
    """
    held: list[pa.RecordBatch] = []

    def edges(table: pa.Table) -> pa.RecordBatch:
        k = table.num_columns - 4
        keys = [table.column(i).to_numpy() for i in range(k)]
        node, s1, s2, n = (table.column(k + i).to_numpy() for i in range(4))
        s = np.stack([s1.view(np.uint64), s2.view(np.uint64)], axis=1)
        new = np.ones(len(node), dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(node)))
        two = start[size == 2]
        ok = (_SKETCH - np.bitwise_count(s[two] ^ s[two + 1]).sum(axis=1, dtype=np.int64) >= SKETCH_AGREE) & (SIMILARITY.denominator * np.minimum(n[two], n[two + 1]) >= SIMILARITY.numerator * np.maximum(n[two], n[two + 1]))
        a, b = [node[two[ok]]], [node[two[ok] + 1]]
        for at, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            forest, part, sizes = Forest(m), s[at : at + m], n[at : at + m]
            for i in range(1, m):
                forest.join(i, alike(part, sizes, i))
            if forest.edges:
                pair = np.array(forest.edges)
                a.append(node[at + pair[:, 0]])
                b.append(node[at + pair[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    last = lambda batch: tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(batch.num_columns - 4))
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.num_columns - 4
        final = last(batch)
        same = np.logical_and.reduce([batch.column(i).to_numpy() == final[i] for i in range(k)])
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut or (held and last(held[-1]) != final):
            yield edges(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield edges(pa.Table.from_batches(held))


def _compare(rows: DataFrame, *keys: str) -> DataFrame:
    small = rows.select(*keys, "node", "s1", "s2", "n")
    return small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(forest_edges), "a long, b long")


def _in_core_blocks(near: DataFrame) -> DataFrame:
    """Rows of kind 1 and 2 under pairs of blocks, at most 2 * ``BRUTE`` rows together, that
    cover all pairs of a bucket with a row of kind 1 (its core) in them."""
    counts = written(near.groupBy("path").agg(F.count_if(F.col("kind") == 1).alias("core"), F.count_if(F.col("kind") == 2).alias("zone")).filter("core > 0"), "cores")
    own, other = F.ceil(F.col("core") / BRUTE).cast("int"), F.ceil(F.col("zone") / BRUTE).cast("int")
    is_core, lot = F.col("kind") == 1, F.xxhash64("node")
    dealt = (
        join_counted(near, counts, "path")
        .withColumn("block", F.when(is_core, F.pmod(lot, own)).otherwise(own + F.pmod(lot, F.greatest(other, F.lit(1)))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_core, own + other).otherwise(own) - 1)))
    )
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def candidate_edges(nodes: DataFrame, runs: int) -> DataFrame:
    """Spanning edges of all buckets of all runs, split and compared as above, as a written table."""
    rows = nodes.select(F.explode("paths").alias("path"), "node", "s1", "s2", "n")
    expected = nodes.count() * (runs + 3)
    found, tables = [], []
    for depth in range(1, DEPTH + 1):
        # written, so that the join's sides are both plain exchanges and a hot path's rows can be split
        sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes", rows=expected)
        rows = written(rows.join(sizes, "path"), "paths", rows=expected)
        tables += [sizes, rows]
        found.append(_compare(rows.filter(F.col("m") <= BRUTE), "path"))
        large = rows.filter(F.col("m") > BRUTE)
        buckets = sizes.filter(F.col("m") > BRUTE)
        if not buckets.take(1):
            break
        if depth == DEPTH:
            found.append(_compare(_in_core_blocks(large.withColumn("kind", F.lit(1))), "path", "low", "high"))
            break
        votes = large.groupBy("path").agg(*[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"leader{i}") for i in range(LEADERS)])
        leaders = written(votes.select("path", F.explode(F.array(*[f"leader{i}" for i in range(LEADERS)])).alias("node")), "leaders", rows=1)
        samples = join_counted(nodes.select("node", "sample"), leaders, "node").groupBy("path").agg(F.collect_list("sample").alias("samples"))
        common = written(_common(samples), "common", rows=1)
        members = written(join_counted(large, common, "path"), "members", rows=expected)
        split = written(_split(join_counted(nodes.select("node", "sample"), members, "node"), runs_within(runs)), "split", rows=expected)
        found.append(_compare(_in_core_blocks(split.filter("kind > 0")), "path", "low", "high"))
        rows = split.filter("kind = 0").drop("kind")
        tables += [leaders, common, members, split]
        release(nodes.sparkSession)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    edges = written(out.distinct(), "edges", rows=expected)
    erase(*tables)
    release(nodes.sparkSession)
    return edges


#: Sets of one side, and tokens, in one product.
TILE, STEP = 512, 2048


def links_of(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Verified links of the sets numbered ``left`` with those numbered ``right``.

    (copies linked to each set, spanning edges). ``within``: both are the same block.
    Intersections come from products of 0/1 matrices over slices of the tokens
    that occur in two sets at least, for ``TILE`` sets of the left at a time.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    _, token = np.unique(token, return_inverse=True)
    rights = np.full(m, -1)
    rights[right] = np.arange(len(right))
    links, forest = np.zeros(m, dtype=np.int64), Forest(m)
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    for at in range(0, len(left), TILE):
        part = left[at : at + TILE]
        lefts = np.full(m, -1)
        lefts[part] = np.arange(len(part))
        both = np.zeros((len(part), len(right)), dtype=np.float32)
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, STEP):
            lo, hi = np.searchsorted(token, [a, a + STEP])
            t, o = token[lo:hi] - a, owner[lo:hi]
            x, y = np.zeros((len(part), STEP), dtype=np.float32), np.zeros((len(right), STEP), dtype=np.float32)
            mine, theirs = lefts[o] >= 0, rights[o] >= 0
            x[lefts[o[mine]], t[mine]] = 1
            y[rights[o[theirs]], t[theirs]] = 1
            both += x @ y.T
        linked = both * (num + den) >= num * (size[part][:, None] + size[right][None])
        if within:
            linked[np.arange(len(part)), rights[part]] = False
        links[part] += linked @ copies[right]
        if not within:
            links[right] += linked.T @ copies[part]
        for i in np.flatnonzero(linked.any(axis=1)):
            forest.join(int(part[i]), right[np.flatnonzero(linked[i])])
    return links, forest.edges


def _verified(groups: DataFrame) -> DataFrame:
    """Rows (a, b, links) from rows (group, low, high, block, node, copies, tokens) sorted by group.

    A group holds one block, or two, of about ``VERIFY_TOKENS`` tokens each.
    """

    def finish(held: dict[int, tuple]) -> pa.RecordBatch:
        rows = list(held.values())
        low, high = rows[0][1], rows[0][2]
        block = np.array([r[3] for r in rows])
        copies = np.array([r[5] for r in rows])
        sets = [np.frombuffer(r[6], dtype="<u8") for r in rows]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, edges = links_of(sets, copies, left, right, low == high) if len(left) and len(right) else (np.zeros(len(rows), dtype=np.int64), [])
        node = [r[4] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*node, *(node[a] for a, _ in edges)], pa.int64()),
                pa.array([*[None] * len(node), *(node[b] for _, b in edges)], pa.int64()),
                pa.array([*links.tolist(), *[0] * len(edges)], pa.int64()),
            ],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = {}, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held and group != row[:3]:
                    yield finish(held)
                    held = {}
                group = row[:3]
                held.setdefault(row[4], row)  # repeated rows bring a node's tokens again
        if held:
            yield finish(held)

    return groups.mapInArrow(lean(run), "a long, b long, links long")


def _with_tokens(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, h1, h2, node, copies, group, blocks) with the node's tokens, read again from its document."""
    joined = join_counted(documents.select("doc_id", "text"), wanted, "doc_id").select("text", "h1", "h2", "node", "copies", "group", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # of repeated rows a task hands on one
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(texts):
                x = nodes_of(texts[a:b], 0)
                part = batch.slice(a, b - a)
                right = (x["h1"] == part.column(1).to_numpy()) & (x["h2"] == part.column(2).to_numpy())
                node = part.column(3).to_pylist()
                pick = [i for i in np.flatnonzero(right).tolist() if node[i] not in given and not given.add(node[i])]
                begin = x["begin"].tolist()
                tokens = pa.array([x["tokens"][begin[i] : begin[i + 1]].astype("<u8").tobytes() for i in pick], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(pick, pa.int64())) for c in part.columns[3:]), tokens], names=["node", "copies", "group", "blocks", "tokens"])

    return joined.mapInArrow(lean(run), "node long, copies long, group long, blocks int, tokens binary")


def _in_blocks(sets: DataFrame) -> DataFrame:
    """Each set under all pairs of blocks that its own block is in."""
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "tokens")


def _classed(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every row, with its node and component (null for a row without part)."""
    spark = documents.sparkSession
    small_batches(spark)
    runs = runs_for(recall)
    rows = written(_shingled(documents, runs), "shingled")
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    groups = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "s1", "s2", "sample", "paths")])
    # numbers given once, in a table that is not made anew
    nodes = written(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = candidate_edges(nodes, runs)
    loose = components(edges, "loose")
    erase(edges)
    members = loose.join(nodes.select("node", "doc_id", "h1", "h2", "n", "copies"), "node").withColumnRenamed("component", "group")
    blocks = members.groupBy("group").agg(F.ceil(F.sum("n") / VERIFY_TOKENS).cast("int").alias("blocks"))
    wanted = written(members.join(blocks, "group").drop("n"), "wanted", rows=nodes.count())
    sets = _in_blocks(_with_tokens(documents, wanted)).repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    with batches_of(spark, 64):  # token sets of long documents are large
        checked = written(_verified(sets), "links")
    release(spark)
    links = checked.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(checked.filter("b is not null").select("a", "b"), "classes")
    known = (
        nodes.select("node", "h1", "h2", "doc_id", "copies")
        .join(links, "node", "left")
        .join(labels, "node", "left")
        .select("node", "h1", "h2", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    )
    least = known.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    known = known.join(least, "component").select("h1", "h2", "component", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    takes_part = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = rows.select("doc_id", *[F.when(takes_part, F.col(c)).alias(c) for c in ("h1", "h2")]).join(known, ["h1", "h2"], "left")
    erase(loose, wanted)
    return out.select("doc_id", F.col("h1").alias("node"), "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every row."""
    return _classed(documents, recall).select("doc_id", "class_id", "n_links")


def _with_node(documents: DataFrame) -> DataFrame:
    """``documents`` with a hash of each row's set, null for a text without words."""
    at, names = documents.columns.index("text"), [*documents.columns, unused(documents, "_node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            for a, b in slices(texts):
                x = nodes_of(texts[a:b], 0)
                node = pa.array(x["h1"], pa.int64(), mask=x["n"] == 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, node], names=names)

    return documents.mapInArrow(lean(run), T.StructType([*documents.schema.fields, T.StructField(names[-1], T.LongType())]))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class, of the least id; columns unchanged.

    A row is known by its id where no other row has it. Of repeated ids that are
    linked to anything each row is known by its node: rows of other texts, like
    rows with null doc_id, stay whatever befalls their namesakes.
    """
    decided = written(_classed(documents), "classes")
    release(documents.sparkSession)
    linked = decided.filter("n_links > 0")
    repeated = decided.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_links").alias("links")).filter("rows > 1 and links > 0").select("doc_id")
    dropped = linked.filter("doc_id != class_id").select("doc_id").distinct()
    if not repeated.take(1):
        return join_counted(documents, dropped, "doc_id", "left_anti").select(documents.columns)
    repeated = written(repeated, "repeated-ids")
    sole = join_counted(documents, dropped.union(repeated).distinct(), "doc_id", "left_anti").select(documents.columns)
    keepers = linked.filter("doc_id = class_id").groupBy("component").agg(F.min("node").alias("keeper"))
    fates = linked.join(repeated, "doc_id", "left_semi").join(keepers, "component")
    node, keeps, lot = (unused(documents, c) for c in ("_node", "_keeps", "_lot"))
    fates = fates.select("doc_id", F.col("node").alias(node), ((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("keeper"))).alias(keeps)).distinct()
    # of equal rows of a kept node one stays; each unlinked row is in a lot of its own
    known = _with_node(join_counted(documents, repeated, "doc_id", "left_semi").select(documents.columns))
    lots = known.join(fates, ["doc_id", node], "left").filter(F.col(keeps).isNull() | F.col(keeps))
    lots = lots.withColumn(lot, F.when(F.col(keeps), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return sole.unionByName(lots.dropDuplicates(["doc_id", node, lot]).select(documents.columns))
