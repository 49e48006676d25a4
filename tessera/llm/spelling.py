"""Spelling variants: words one code point apart, by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced code point makes one the other.
Of words of T code points and words one shorter, sorted forwards and sorted backwards,
those that agree with a word before position i are an interval of the first order, and
those that agree with it behind i an interval of the second. Each word of T is a point
(forward rank, backward rank), so the near words are the points of a rectangle, one
rectangle a position. A wavelet matrix over the points reports them level by level, for
all words and positions of a step at once.

The work is dealt by what near words must share. For edits at a position in [a, b) that
is the prefix of length a and the suffix behind b; the first ranges are the two halves
of a word. A group of over ``GROUP_BYTES`` is dealt again, each range halved with what
more its words then share, until it fits or its range is a single position, where a
group has no more words than the alphabet has letters. So no task holds more than a few
groups, and one of a third of all words is spread. A pair is reported at its last
position alone, so by exactly one group, and only counts and the most frequent near word
leave a task, never pairs.

Words are runs of letters, in lower case (A-Z), of at least ``MIN_CHARS`` code points and
``MIN_COUNT`` occurrences. A word's form is its near word of most occurrences, if they
are ``TIMES`` the word's or more; its root is where following forms ends, found by
doubling pointers.

Edge cases: a null or empty text has no words; ties go to the smallest word in code-point
order; repeated rows count each; a null doc_id is written as an empty string where
occurrences are altered; a very long text is read by one task in memory of a few times
its size; a very long word is a word like others; an empty table has no words; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, erase, join_counted, small_batches, written
from .textkit import Batches, lean, slices, utf8

MIN_CHARS = 7
MIN_COUNT = 2
TIMES = 10
#: One in so many occurrences (by the hash of document and word) lacks a code point.
ALTERED = 31
LETTERS = "A-Za-zÀ-ÿ"  # all within Latin-1, so a code point is a byte of it
#: Bytes of the words of a group, beyond which it is dealt again; and of the groups that one step handles.
GROUP_BYTES = 1 << 18
STEP_BYTES = 1 << 20
#: Bytes of words that a task gets on average.
TASK_BYTES = 2 << 20
#: Rectangles that one descent handles.
RECTANGLES = 1 << 19
#: Distinct words a task counts before it sends them on.
HELD_WORDS = 200_000
ROWS = 1 << 14


def _counts(batches: Batches) -> Batches:
    find = re.compile(f"[{LETTERS}]{{{MIN_CHARS},}}").findall
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        texts, ids = utf8(batch.column(1)), batch.column(0).to_pylist()
        for a, b in slices(texts):
            for i in range(a, b):
                runs = Counter(find(texts[i].lower().decode("utf-8", "replace")))  # bytes: A-Z alone
                doc = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), doc)
                    if h % ALTERED:
                        total[run] += n
                    elif len(run) > MIN_CHARS:
                        at = h % len(run)
                        total[run[:at] + run[at + 1 :]] += n
                if len(total) > HELD_WORDS:
                    yield flush()
    if total:
        yield flush()


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of the words, as a written table."""
    small_batches(documents.sparkSession)
    counted = documents.select("doc_id", "text").mapInArrow(lean(_counts), "word string, n long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT), "words")


class WaveletMatrix:
    """Values below 2**bits in a fixed order; reports the places of those within a range of places and of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all points of the rectangles [lo, hi) x [low, high). Values are distinct."""
        query, base = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64)
        for depth in range(self.bits):
            ones, zeros, half = self.ones[depth], self.zeros[depth], 1 << (self.bits - 1 - depth)
            lo1, hi1 = ones[lo], ones[hi]
            lo0, hi0 = lo - lo1, hi - hi1
            middle = base + half
            left = np.flatnonzero((hi0 > lo0) & (base < high[query]) & (middle > low[query]))
            right = np.flatnonzero((hi1 > lo1) & (middle < high[query]) & (middle + half > low[query]))
            lo, hi = np.concatenate([lo0[left], lo1[right] + zeros]), np.concatenate([hi0[left], hi1[right] + zeros])
            query, base = np.concatenate([query[left], query[right]]), np.concatenate([base[left], middle[right]])
        return query, base


def _order(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows, and how many leading columns each sorted row shares with the one before."""
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")
    rows = matrix[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, np.concatenate([[0], common])


def _interval(order: np.ndarray, common: np.ndarray, long: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the interval of the long words, by their rank in this order, that share its first ``length`` columns."""
    begin = np.flatnonzero(common < length) if length else np.zeros(1, dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(long[order])])
    edge = count[np.append(begin, len(order))]
    group = np.zeros(len(order), dtype=np.int64)
    group[begin[1:]] = 1
    group = np.cumsum(group)
    lo, hi = np.empty_like(group), np.empty_like(group)
    lo[order], hi[order] = edge[:-1][group], edge[1:][group]
    return lo, hi


def near_pairs(words: list[bytes], size: int, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, near row) for edits at positions of [first, stop): rows of ``size`` bytes with each other,
    seen from either side, and rows of one byte less with those, seen from the shorter."""
    matrix = np.array(words, dtype=f"S{size}").view(np.uint8).reshape(-1, size)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    long = length == size
    at = np.arange(size)[None, :]
    back = np.take_along_axis(matrix, np.where(at < length[:, None], length[:, None] - 1 - at, at), axis=1)
    forward, shared = _order(matrix)
    backward, shared_back = _order(back)
    fronts, backs = forward[long[forward]], backward[long[backward]]
    rank = np.empty(len(words), dtype=np.int64)
    rank[backs] = np.arange(len(backs))
    points = WaveletMatrix(rank[fronts])
    # no two words share more than this, so other positions have nothing to report
    first, stop = max(first, size - 1 - int(shared_back.max())), min(stop, int(shared.max()) + 1)
    held = []
    for i in range(first, stop):
        lo, hi = _interval(forward, shared, long, i)
        low, high = _interval(backward, shared_back, long, size - 1 - i)
        ask = np.flatnonzero((hi - lo > long) & (high - low > long))  # a long word always finds itself
        held.append((ask, lo[ask], hi[ask], low[ask], high[ask], np.full(len(ask), i)))
        if sum(len(x[0]) for x in held) < RECTANGLES and i + 1 < stop:
            continue
        ask, lo, hi, low, high, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        for a in range(0, len(ask), RECTANGLES):
            part = slice(a, a + RECTANGLES)
            query, value = points.report(lo[part], hi[part], low[part], high[part])
            row, spot, near = ask[part][query], place[part][query], backs[value]
            # a letter inserted into a run of equal ones counts where the run ends
            keep = (row != near) & (long[row] | (matrix[row, spot] != matrix[near, spot]))
            yield row[keep], near[keep]


def _best(rows: np.ndarray, near: np.ndarray, n: np.ndarray, name_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: how many near words, and the one of largest n (ties: the least name)."""
    order = np.lexsort((name_rank[near], -n[near], rows))
    rows, near = rows[order], near[order]
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
    return rows[start], np.diff(np.append(start, len(rows))), near[start]


def _search(batches: Batches) -> Batches:
    """Rows (size, first, stop, group, word, n) sorted by all: per word what its groups report."""

    def step(size: int, first: int, stop: int, words: list[bytes], counts: list[int]) -> pa.RecordBatch | None:
        pairs = [p for p in near_pairs(words, size, first, stop) if len(p[0])]
        if not pairs:
            return None
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        length, n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), np.array(counts)
        short = length[a] < size  # those are seen from one side
        rows, near = np.concatenate([a, b[short]]), np.concatenate([b, a[short]])
        name_rank = np.empty(len(words), dtype=np.int64)
        name_rank[np.argsort(np.array(words, dtype=f"S{size}"), kind="stable")] = np.arange(len(words))
        row, found, best = _best(rows, near, n, name_rank)
        text = pa.array([w.decode("latin-1") for w in words])
        return pa.RecordBatch.from_arrays([text.take(pa.array(row)), pa.array(found), text.take(pa.array(best)), pa.array(n[best])], names=["word", "n_near", "best", "best_n"])

    at, group, words, counts, held, whole = None, None, [], [], 0, 0
    for batch in batches:
        for size, first, stop, key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (size, first, stop) != at or (key != group and held >= STEP_BYTES):
                if words and (out := step(*at, words, counts)) is not None:
                    yield out
                at, words, counts, held = (size, first, stop), [], [], 0
            group = key
            words.append(word.encode("latin-1"))
            counts.append(n)
            held += size
    if words and (out := step(*at, words, counts)) is not None:
        yield out


def _shared(word: str, size: str, first: str, stop: str) -> str:
    """SQL: the hash of what words share whose edits are at positions of [first, stop); a shorter word's suffix is as long as a longer one's."""
    return f"xxhash64({size}, {first}, {stop}, left({word}, {first}), right({word}, {size} - {stop}))"


def dealt(words: DataFrame, limit: int = GROUP_BYTES) -> list[DataFrame]:
    """(size, first, stop, group, word, n) with no group of more than ``limit`` bytes but those of one position, as written tables."""
    classes = words.withColumn("length", F.length("word")).selectExpr("word", "n", "explode(array(length, length + 1)) AS size")
    halves = classes.selectExpr("word", "n", "size", "inline(array(struct(0 AS first, int(size div 2) AS stop), struct(int(size div 2) AS first, size AS stop)))")
    columns = ["size", "first", "stop", "group", "word", "n"]
    open_ = written(halves.withColumn("group", F.expr(_shared("word", "size", "first", "stop"))).select(*columns), "groups")
    done = []
    on = ["size", "first", "stop", "group"]
    while True:
        large = open_.groupBy(*on).agg(F.sum(F.length("word")).alias("held")).filter((F.col("held") > limit) & (F.col("stop") - F.col("first") > 1))
        large = written(large.select(*on), "large-groups", rows=1)
        if not large.limit(1).count():
            erase(large)
            return [*done, open_]
        done.append(written(join_counted(open_, large, on, "left_anti").select(*columns), "groups"))
        again = join_counted(open_, large, on, "left_semi").selectExpr("word", "n", "size", "inline(array(struct(first, int((first + stop) div 2) AS stop), struct(int((first + stop) div 2) AS first, stop)))")
        last, open_ = open_, written(again.withColumn("group", F.expr(_shared("word", "size", "first", "stop"))).select(*columns), "groups")
        erase(last, large)


def near_words(words: DataFrame, limit: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, best, best_n) of words that have near words, as a written table."""
    spark = words.sparkSession
    tables = dealt(words, limit)
    rows = reduce(DataFrame.unionByName, tables)
    held = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    on = ["size", "first", "stop", "group"]
    with batches_of(spark, ROWS):
        searched = rows.repartition(parts, *on).sortWithinPartitions(*on).mapInArrow(lean(_search), "word string, n_near long, best string, best_n long")
        ranked = searched.select("word", "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("top"))
        found = ranked.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
        out = written(found.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n")), "near-words")
    erase(*tables)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last of the forms that follow, as a written table.
    A form occurs ten times as often as its word, so there are few to follow, and no circles."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = ends.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        last, hops = ends, written(hops, "roots")
        erase(last)
        path, ends = hops.table_path, hops.drop("moved")
        ends.table_path = path
        if not hops.filter("moved").limit(1).count():
            return ends


def variants(documents: DataFrame, limit: int = GROUP_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    words = word_counts(documents)
    near = near_words(words, limit)
    known = words.join(near, "word", "left")
    has_form = F.col("best_n") >= TIMES * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
    known = written(known, "spellings")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
