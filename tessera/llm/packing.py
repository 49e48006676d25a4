"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the
driver. There the best-fit decreasing packing, worked out on the histogram, is the
first incumbent. If it takes more sequences than all tokens need, bin completion
looks for better ones: depth first, a sequence is completed around the largest length
still left by each undominated filling of the remaining room, least waste first. A
filling is dominated if an unused length could stand in for several chosen ones, or
for ones of less in sum, without overflow. Waste that would cost as many sequences as
the incumbent prunes fillings and branches; a better packing becomes the incumbent. A
pattern is used as often as the histogram allows, then also once. ``NODES`` and
``BUDGET`` bound the search; what they leave open is how far from the fewest
sequences a packing is, never whether it is one.

Back on the cluster a piece finds its slot by its rank among the pieces of its
length: pieces are numbered by length within the task that cuts them, and the
counts of tasks added up, so equal lengths or ids gather nowhere.

Edge cases: a null or empty text is the one id 0; repeated rows are documents of
their own; equal lengths are interchangeable; a very long text is cut into pieces by one
task, in stretches of 4 MB that end between words; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_counted, release, small_batches, written
from .textkit import kept, lean, slices, stretches, utf8

CAPACITY = 2048
#: Nodes of the search for the fillings of one sequence, and of all together.
NODES = 4000
BUDGET = 400_000
#: Words that a worker remembers; those met first stay, the frequent ones among them.
CACHE_WORDS = 400_000
#: Bytes from which a text is encoded in stretches.
STRETCH = 4 << 20


class _Codes(dict):
    """Numbers its keys in order of first use; ``new`` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself, or from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, next_ = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else next_))
        next_ += b not in plain
    return out


class WordEncoder:
    """Exact token ids, with each distinct blank-separated word encoded once per worker.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order. It also lowers case and takes a run of
    letters and a run of marks apart, so a word of Latin letters with marks after
    it is its letters, in lower case, and its marks; for letters alone the BPE
    model is asked directly.
    """

    SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?%&$#*|]*)")

    def __init__(self, path: str, remembered: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.code = _Codes()
        self.flat, self.begin = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the words numbered since the last time, and of letters and marks that they consist of."""
        code, base = self.code, len(self.begin) - 1
        words, tokenize = code.new, self.tokenizer.model.tokenize
        ids: list[list[int] | tuple[int, ...]] = []
        other = []
        for word in words:  # grows by letters and marks not met before
            simple = self.SIMPLE.fullmatch(word)
            if simple is None:
                other.append(len(ids))
                ids.append(())
                continue
            stem, marks = simple.groups()
            stem = stem.lower() if stem.isascii() else stem.decode().lower().encode()
            if stem == word:
                ids.append([t.id for t in tokenize(stem.decode() if stem.isascii() else "".join(self.letters[b] for b in stem))])
            else:
                ids.append((code[stem], code[marks]) if marks else (code[stem],))
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            for at, e in zip(part, self.tokenizer.encode_batch_fast([words[j].decode("utf-8", "replace") for j in part], add_special_tokens=False), strict=True):
                ids[at] = e.ids
        of = lambda c: ids[c - base] if c >= base else self.flat[self.begin[c] : self.begin[c + 1]].tolist()
        ids = [[x for c in i for x in of(c)] if isinstance(i, tuple) else i for i in ids]
        lengths = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths[-1]))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + lengths])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, each closed by id 0, and where each text begins."""
        split = [t.split() for t in texts]
        code = self.code
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        if code.new:
            self._learn()
        size = np.diff(self.begin)
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        # every text is closed by a virtual word whose one id is 0
        doc_end = np.cumsum(n_words)
        codes = np.insert(codes, doc_end, len(size))
        size = np.append(size, 1)
        start = np.append(self.begin[:-1], len(self.flat))
        flat = np.append(self.flat, np.uint32(0))
        count = size[codes]
        total = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(count, out=total[1:])
        at = np.repeat(start[codes] - total[:-1], count) + np.arange(total[-1])
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        begin[1:] = total[doc_end + np.arange(1, len(texts) + 1)]
        if len(code) > self.remembered:  # the words met last are forgotten
            for word in code.new[max(0, len(code.new) - (len(code) - self.remembered)) :]:
                del code[word]
            self.begin = self.begin[: len(code) + 1]
            self.flat = self.flat[: self.begin[-1]]
        code.new = []
        return flat[at], begin


def encoder(path: str, remembered: int = CACHE_WORDS) -> Callable:
    if path not in kept:
        kept[path] = WordEncoder(path, remembered)
    return kept[path]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True, key: str = "doc_id", remembered: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, document (a number of the row, unique in
    the table), lot and place (task and number there among the pieces of the length) and, if wanted, the ids.
    ``remembered``: words that a worker keeps the ids of."""
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, document long, lot int, place long" + ", ids array<int>" * with_ids

    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, remembered)
        lot, rows, placed = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, dtype=np.int64)

        def emit(keys: pa.Array, ids: np.ndarray, begin: np.ndarray, before: int = 0) -> pa.RecordBatch:
            """The pieces of texts whose ids are given, from the piece numbered ``before`` on."""
            nonlocal placed
            n = -(-np.diff(begin) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            first = np.zeros(len(n), dtype=np.int64)
            first[1:] = np.cumsum(n)[:-1]
            piece = np.arange(len(doc)) - first[doc]
            at = begin[doc] + piece * capacity
            length = np.minimum(capacity, begin[1:][doc] - at)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            place = np.empty_like(length)
            place[order] = placed[ranked] + np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            placed += np.bincount(length, minlength=capacity + 1)
            piece += before
            columns = [keys.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
            columns += [pa.array((lot << 33) + rows + doc), pa.array(np.full(len(doc), lot, dtype=np.int32)), pa.array(place)]
            if with_ids:  # pieces follow each other as their ids do
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, begin[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                keys = batch.column(0).slice(a, b - a)
                if b - a > 1 or len(texts[a]) <= STRETCH:
                    yield emit(keys, *encode(texts[a:b]))
                else:
                    left, before = np.zeros(0, dtype=np.uint32), 0
                    for stretch, last in stretches(texts[a], STRETCH):
                        ids = np.concatenate([left, encode([stretch])[0][: None if last else -1]])
                        whole = len(ids) if last else len(ids) // capacity * capacity
                        if whole:
                            yield emit(keys, ids[:whole], np.array([0, whole]), before)
                        left, before = ids[whole:], before + whole // capacity
                rows += b - a

    small_batches(documents.sparkSession)
    return documents.select(key, "text").mapInArrow(lean(cut, keeps=tokenizer_path), schema)


Plan = list[tuple[list[tuple[int, int]], int]]


def size_of(plan: Plan) -> int:
    return sum(times for _, times in plan)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing, for all pieces of a length at once: each goes where it leaves least room.

    Sequences of equal content are one entry of the work list, kept by the room they have; a
    length changes each entry it meets whole but for one, so there are few.
    """
    held: list[tuple[int, int, dict[int, int], int]] = []  # room, order, content, times
    made = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        count = histogram[length]
        while count:
            at = bisect_left(held, (length,))
            if at < len(held):
                room, _, content, times = held.pop(at)
            else:
                room, content, times = capacity, {}, count
            each = min(room // length, count)
            full = min(times, count // each)
            made += 2
            if full < times and content:
                insort(held, (room, made, content, times - full))
            insort(held, (room - each * length, made + 1, content | {length: each}, full))
            count -= each * full
    return [(sorted(content.items(), reverse=True), times) for _, _, content, times in held]


def dominated(chosen: list[int], waste: int, lengths: list[int], unused: list[int]) -> bool:
    """Whether an unused length could stand in for chosen ones: for some of less in sum, or for
    several of the same sum, with no more than ``waste`` of additional room."""
    some, several = 1, 0  # bit s: some chosen lengths, two at least, add up to s
    for x in chosen:
        several |= several << x | (some & ~1) << x
        some |= some << x
    for x, n in zip(lengths, unused, strict=True):
        if n and (several >> x & 1 or some >> max(1, x - waste) & ((1 << max(0, x - max(1, x - waste))) - 1)):
            return True
    return False


def fillings(room: int, lengths: list[int], left: list[int], allowed: int, nodes: int = NODES) -> tuple[list[list[int]], int]:
    """Undominated fillings of ``room`` that waste at most ``allowed``, least waste first, and the nodes looked at.

    ``lengths`` ascend, with ``left`` of each. Depth first with larger lengths first, by an
    explicit stack, since a filling may have as many pieces as there is room; a branch ends
    where all that could still be chosen leaves more waste than allowed. An exact single fit
    dominates everything else.
    """
    at = bisect_left(lengths, room)
    if at < len(lengths) and lengths[at] == room and left[at]:
        return [[room]], 1
    below = [0]
    for length, count in zip(lengths, left, strict=True):
        below.append(below[-1] + length * count)
    left, chosen, found, budget = list(left), [], [], nodes
    enter = lambda space, top: [space, bisect_right(lengths, space, 0, top + 1) - 1, False]
    levels = [enter(room, len(lengths) - 1)]
    while levels and budget > 0:
        space, i, tried = levels[-1]
        while i >= 0 and not left[i]:
            i -= 1
        if i >= 0 and space - below[i + 1] <= allowed:
            budget -= 1
            levels[-1][1:] = i, True
            left[i] -= 1
            chosen.append(lengths[i])
            levels.append(enter(space - lengths[i], i))
            continue
        if not tried and space <= allowed and not dominated(chosen, space, lengths, left):
            found.append((space, list(chosen)))
            if not space and len(found) > 64:
                break
        levels.pop()
        if levels:
            i = levels[-1][1]
            chosen.pop()
            left[i] += 1
            levels[-1][1] = i - 1
    found.sort(key=lambda f: f[0])
    return [x for _, x in found], nodes - budget


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, budget: int = BUDGET) -> Plan:
    """Patterns ((length, copies), ...) with how often each is used, for the whole histogram."""
    total = sum(n * c for n, c in histogram.items())
    bound = math.ceil(total / capacity)
    best = best_fit(histogram, capacity)

    def children(counts: dict[int, int], plan: Plan, waste: int) -> Iterator[tuple[dict[int, int], Plan, int]]:
        nonlocal budget
        lengths = sorted(n for n, c in counts.items() if c)
        top = lengths[-1]
        left = [counts[n] - (n == top) for n in lengths]
        allowed = (size_of(best) - 1) * capacity - total - waste
        options, used = fillings(capacity - top, lengths, left, allowed, min(nodes, budget))
        budget -= 1 + used
        for filling in options:
            pattern: dict[int, int] = {}
            for n in [top, *filling]:
                pattern[n] = pattern.get(n, 0) + 1
            spare = capacity - sum(n * m for n, m in pattern.items())
            most = min(counts[n] // m for n, m in pattern.items())
            for times in dict.fromkeys((most, 1)):
                # the waste may have been too much since the incumbent changed
                if waste + times * spare <= (size_of(best) - 1) * capacity - total:
                    yield {n: c - pattern.get(n, 0) * times for n, c in counts.items()}, [*plan, (sorted(pattern.items(), reverse=True), times)], waste + times * spare

    open_ = [children(dict(histogram), [], 0)] if size_of(best) > bound else []
    while open_ and budget > 0 and size_of(best) > bound:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
        elif not any(step[0].values()):
            if size_of(step[1]) < size_of(best):
                best = step[1]
        else:
            open_.append(children(*step))
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces()``, which are written to the shared folder first."""
    rows = written(cut, "pieces")
    release(cut.sparkSession)
    names = [n for n in rows.columns if n not in ("lot", "place")]
    counts = written(rows.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n")), "lengths", rows=1)
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = []  # length, first rank, copies, first sequence, offset in the pattern
    sequence, used = 0, dict.fromkeys(histogram, 0)
    for pattern, times in complete_bins(histogram, capacity):
        offset = 0
        for length, copies in pattern:
            slots.append((length, used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += length * copies
        sequence += times
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    schema = rows.select(names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sort_key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            slot = table[np.searchsorted(sort_key, length << 48 | rank, side="right") - 1]
            within = rank - slot[:, 1]
            sequence_id = slot[:, 3] + within // slot[:, 2]
            offset = slot[:, 4] + within % slot[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence_id), pa.array(offset)], names=schema.names)

    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    base = written(counts.select("length", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases", rows=1)
    ranked = join_counted(rows, base, ["length", "lot"])
    return ranked.select(*names, (F.col("base") + F.col("place")).alias("rank")).mapInArrow(lean(place), schema)
