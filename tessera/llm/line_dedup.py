"""Line dedup: two Bloom filters find the lines that may repeat; only those are shuffled and confirmed.

A line's key is the line without blanks at its ends, A-Z in lower case. A key of at
least ``MIN_CHARS`` code points that ``MIN_DOCS`` documents or more hold loses all its
lines, except those of the largest doc_id that holds it.

1. One pass over the texts writes a narrow table: per document its distinct keys, as
   128-bit digests. Texts do not move.
2. Two Bloom filters over the digests, in segments: a bit of the
   first is set once a key has hit it, of the second once another hit follows. Each task
   sends what it saw once and what it saw twice, so that a line of a third of all
   documents costs two entries a task; a segment's owner merges them, bit by bit.
   ``BITS`` a key make some 0.5 % of the lines that occur once suspects.
3. Keys all of whose bits are in the second filter are suspects. The filter is cut into
   slices of 64 MB; a task holds one slice at a time. While there is
   one slice, digests are tested where they lie; with more, they are first dealt by
   slice, salted by document.
4. Only suspects are grouped, by the whole digest: exact counts, and the largest
   document, which keeps its lines. Their documents get the list of what they lose.

Edge cases: a null or empty text is one empty line; rows without a doc_id count as no
document and lose nothing; repeated rows are one document, each row is returned; equal
lines of one document stay or go together; a very long text is split by one task, in
memory of a few times its size; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, erase, join_counted, small_batches, written
from .storage import read_table
from .textkit import SPACES, Batches, lean, slices, utf8

MIN_DOCS = 3
MIN_CHARS = 20
#: Bits of the filters a key, and bits a key sets.
BITS = 16
HITS = 3
#: A segment has at least this many bits, and more once there would be over ``SEGMENTS`` of them.
SEGMENT_BITS = 1 << 20
SEGMENTS = 4096
#: Bits of the slice that a task holds at once: 64 MB.
SLICE_BITS = 1 << 29
#: Digests that one step of a task looks at.
STEP_ROWS = 1 << 18
#: Parts that the digests of a slice are dealt to by document.
SALTS = 16


@dataclass(frozen=True)
class Layout:
    """Where the bits of a digest lie."""

    segments: int
    segment_bits: int
    slice_bits: int

    @classmethod
    def of(cls, keys: int) -> Layout:
        bits = SEGMENT_BITS
        while bits < SLICE_BITS and keys * BITS > bits * SEGMENTS:
            bits *= 2
        return cls(max(1, -(-keys * BITS // bits)), bits, SLICE_BITS)

    @property
    def slice_segments(self) -> int:
        return max(1, self.slice_bits // self.segment_bits)

    @property
    def slices(self) -> int:
        return -(-self.segments // self.slice_segments)

    def places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment of each digest, and its positions there, one column each."""
        low = low.view(np.uint64)
        start, step = low & np.uint64(0xFFFFFFFF), low >> np.uint64(32) | np.uint64(1)
        return high % self.segments, np.stack([((start + np.uint64(k) * step) & np.uint64(self.segment_bits - 1)).astype(np.int64) for k in range(HITS)], axis=1)


def key_of(line: bytes) -> bytes | None:
    """The key of a line, if it is long enough to count."""
    key = line.strip(SPACES).lower()  # of bytes: A-Z alone
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(batches: Batches) -> Batches:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in slices(texts):
            at, found = [], []
            for i in range(a, b):
                keys = {digest(k) for k in map(key_of, texts[i].split(b"\n")) if k is not None}
                at += [i] * len(keys)
                found += keys
            halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "high", "low"])


def _steps(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Batches of about ``STEP_ROWS``, whatever the size of those that come."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= STEP_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _inserts(layout: Layout):
    """Per segment the positions that a step hits once, and those it hits twice or more."""

    def run(batches: Batches) -> Batches:
        for batch in _steps(batches):
            segment, places = layout.places(*(batch.column(i).to_numpy() for i in range(2)))
            bit, n = np.unique((segment[:, None] * layout.segment_bits + places).ravel(), return_counts=True)
            own, place = bit // layout.segment_bits, (bit % layout.segment_bits).astype(np.int32)
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            lists = list(zip(np.split(place, cut[1:]), np.split(n > 1, cut[1:]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[cut]), pa.array([x[~again] for x, again in lists], pa.list_(pa.int32())), pa.array([x[again] for x, again in lists], pa.list_(pa.int32()))],
                names=["segment", "once", "twice"],
            )

    return run


def _merge(layout: Layout):
    """Rows sorted by segment become the second filter of each segment; the first is needed only on the way."""

    def filter_of(segment: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

    def mark(bits: np.ndarray, places: np.ndarray) -> None:
        np.bitwise_or.at(bits, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))

    def run(batches: Batches) -> Batches:
        at, first, second = None, None, None
        for batch in batches:
            for segment, once, twice in zip(*(batch.column(i) for i in range(3)), strict=True):
                if segment.as_py() != at:
                    if at is not None:
                        yield filter_of(at, second)
                    at, first, second = segment.as_py(), np.zeros(layout.segment_bits // 8, dtype=np.uint8), np.zeros(layout.segment_bits // 8, dtype=np.uint8)
                hit, again = (np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (once, twice))
                mark(second, hit[_set(first, hit)])
                mark(second, again)
                mark(first, hit)
                mark(first, again)
        if at is not None:
            yield filter_of(at, second)

    return run


def _set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool)


def _suspects(layout: Layout, files: dict[int, list[str]]):
    """Rows whose bits are all in the second filter. Beyond one slice, rows come by slice."""
    size = layout.segment_bits // 8

    def load(piece: int) -> np.ndarray:
        held = np.zeros(min(layout.slice_segments, layout.segments) * size, dtype=np.uint8)
        for read in map(read_table, files.get(piece, [])):
            for segment, bits in zip(read.column("segment").to_pylist(), read.column("bits"), strict=True):
                at = segment % layout.slice_segments * size
                held[at : at + size] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
        return held

    def run(batches: Batches) -> Batches:
        piece, held = None, None
        for batch in _steps(batches):
            segment, places = layout.places(*(batch.column(i).to_numpy() for i in (1, 2)))
            own = segment // layout.slice_segments
            places += (segment % layout.slice_segments * layout.segment_bits)[:, None]
            suspect = np.zeros(len(segment), dtype=bool)
            for now in np.unique(own).tolist():
                if now != piece:
                    piece, held = now, load(now)
                at = np.flatnonzero(own == now)
                suspect[at] = _set(held, places[at]).all(axis=1)
            yield batch.filter(pa.array(suspect))

    return run


def losses(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, gone): the digests of the keys whose lines a document loses; documents that lose none are left out."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    keys = written(documents.select("doc_id", "text").filter("doc_id is not null").mapInArrow(lean(_digests), f"doc_id {kind}, high long, low long"), "line-keys")
    layout = Layout.of(keys.count())
    with batches_of(spark, 1 << 16):
        sent = keys.select("high", "low").mapInArrow(lean(_inserts(layout)), "segment long, once array<int>, twice array<int>")
        dealt = sent.repartition("segment").sortWithinPartitions("segment")
        filters = written(dealt.mapInArrow(lean(_merge(layout)), "segment long, bits binary").withColumn("slice", F.expr(f"segment div {layout.slice_segments}")), "line-filter", by="slice")
    files: dict[int, list[str]] = {}
    for file in filters.inputFiles():
        files.setdefault(int(file.rsplit("/slice=", 1)[1].split("/")[0]), []).append(file)
    tested = keys
    if layout.slices > 1:
        tested = keys.withColumn("slice", F.expr(f"pmod(high, {layout.segments}) div {layout.slice_segments}"))
        tested = tested.repartition(layout.slices * SALTS, "slice", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).sortWithinPartitions("slice").drop("slice")
    with batches_of(spark, 1 << 16):
        suspects = written(tested.mapInArrow(lean(_suspects(layout, files)), keys.schema), "line-suspects")
    erase(keys, filters)
    # distinct (key, document) first, so that a key of a third of all documents is summed in parts
    held = suspects.distinct().groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    repeated = written(held.filter(F.col("docs") >= min_docs).select("high", "low", "keeper"), "repeated-lines")
    lost = join_counted(suspects.distinct(), repeated, ["high", "low"]).filter("doc_id != keeper")
    gone = written(lost.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("gone")), "line-losses")
    erase(suspects, repeated)
    return gone


def dedup(documents: DataFrame, min_docs: int = MIN_DOCS, hashed: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row; ``hashed``: ``kept_sha256``
    in place of the text, taken where the lines are joined, so that texts don't return from the tasks."""
    last = "kept_sha256" if hashed else "kept"
    of = (lambda text: hashlib.sha256(text).hexdigest()) if hashed else (lambda text: text.decode("utf-8", "replace"))
    texts = documents.select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, gone = utf8(batch.column(1)), batch.column(2)
            for a, b in slices(texts):
                n_lines, n_dropped, kept = [], [], []
                for i in range(a, b):
                    lines = texts[i].split(b"\n")
                    lost = {x["high"].to_bytes(8, "little", signed=True) + x["low"].to_bytes(8, "little", signed=True) for x in gone[i].as_py() or ()}
                    left = [x for x in lines if (key := key_of(x)) is None or digest(key) not in lost] if lost else lines
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    kept.append(of(b"\n".join(left) if n_dropped[-1] else texts[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", last])

    joined = join_counted(texts, losses(documents, min_docs), "doc_id", "left", F.size("gone")).select("doc_id", "text", "gone")
    small_batches(documents.sparkSession)
    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_lines long, n_dropped long, {last} string")
