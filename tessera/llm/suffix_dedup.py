"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every ``LENGTH``-byte string that starts at two places, in one document or two,
is covered with all its occurrences. Three steps find them.

1. Anchors. Each string has one anchor, the ``ANCHOR``-byte piece of least hash in
   it. Neighbouring strings with the same anchor form a section of the text, at
   most 2 * LENGTH - ANCHOR bytes long. Equal strings have equal anchors at equal
   places, so only sections with the same anchor can share a string. Sections are
   counted by (anchor, content), with map-side combine. An anchor that occurs once
   is done; if all sections of an anchor are equal, they form one interval.

2. Transforms. Different sections of one anchor are read once each and aligned on
   it. A shard of them has a positional Burrows-Wheeler transform: for each column
   its symbols in the order of the reversed text before it. Shards are merged as in
   Holt and McMillan's merge of multi-string transforms: the interleave, which says
   from which shard the next symbol comes, starts as shard after shard and each
   iteration refines it stably by the symbols of the next column; nothing is sorted
   anew. Alongside, the common length with the neighbour before is carried on as
   the least over the neighbours in between. Intervals whose common length reaches
   ``LENGTH`` at a column are the repeated strings that end there.

3. Cover. The intervals' strings are mapped back to all sections with their
   content, and each text unites its covered runs.

What is decided by what: two sections are taken for equal if both their 64-bit hashes,
of anchor and content, are; everything about sections that share an anchor but differ
is decided by the transforms. An anchor's sections are one group of bounded text
each, equal ones held once. A group of over ``SPLIT`` different sections is split by
where in them a string starts: strings that start in one half of the range have more
bytes in common with each other than the anchor, and are grouped by these; so on, by
halves, down to single starts, where a group is one string and is only counted. So no
group is ever merged that is larger, whatever a passage's surroundings are.

Edge cases: null text is empty; texts under ``LENGTH`` bytes are never touched;
repeated rows cover each other, and equal texts are covered once for all; there are
no ties, since all occurrences go; long texts are cut into overlapping stretches so
that memory stays bounded by a few times the text; an empty table gives no rows;
further columns are ignored by ``cover``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, erase, join_counted, release, small_batches, written
from .textkit import _INVERSE, _PRIME, lean, mix64, powers, utf8

LENGTH = 200
ANCHOR = 32
SPLIT = 20_000
#: Bytes of a text anchored at once, sections of a shard, and sections merged at once.
STRETCH = 1 << 20
SHARD = 4096
MERGE = 32_768
_ROOM = LENGTH - ANCHOR
#: Halvings of the range of starts, from -_ROOM to 0 before the anchor, until each is alone.
LEVELS = 8
COLUMNS = 2 * _ROOM + ANCHOR


def sections(text: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, start, size, bytes before the anchor) of the sections of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(text) - LENGTH + 1, 0), STRETCH):
        part = np.frombuffer(text, dtype=np.uint8)[at : at + STRETCH + LENGTH - 1]
        n = len(part)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_PRIME, n), out=total[1:])
        down = powers(_INVERSE, n)
        piece = mix64((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
        # hash above, place below: the least is the leftmost of the least hash
        least = (piece & ~np.uint64(0xFFFFFF)) | np.arange(len(piece), dtype=np.uint64)
        width, span = _ROOM + 1, 1
        n_starts = n - LENGTH + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n_starts], least[width - span : width - span + n_starts])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        stop = np.append(first[1:], n_starts) - 1 + LENGTH
        content = mix64((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out.append((piece[place[first]].view(np.int64), content.view(np.int64), first + at, stop - first, place[first] - first))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shard_transform(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, members) of a shard, column by column, in the order of the reversed text before it."""
    symbols = np.empty_like(columns)
    # stable sorts of symbols and shard numbers, here and in the merge, are counting passes (radix sorts of 8 and 16 bits)
    members = np.empty((len(columns) + 1, columns.shape[1]), dtype=np.int32)
    members[0] = np.arange(columns.shape[1])
    for j, column in enumerate(columns):
        symbols[j] = column[members[j]]
        members[j + 1] = members[j][np.argsort(symbols[j], kind="stable")]
    return symbols, members


def merge_intervals(columns: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Which strings of which section are repeated: (sections, string starts) booleans.

    ``columns``: (COLUMNS, n) symbols aligned on the anchor; section i holds columns
    ``begin[i]``..``end[i]`` and stands for ``weight[i]`` equal sections.
    """
    n = columns.shape[1]
    shards = [shard_transform(np.ascontiguousarray(columns[:, a : a + shard])) for a in range(0, n, shard)]
    offset = np.arange(0, n, shard)
    symbols = np.concatenate([s for s, _ in shards], axis=1)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.shape[1] for s, _ in shards])
    # common[p]: first column from which members p - 1 and p agree; one entry more for the end
    common = np.zeros(n + 1, dtype=np.int16)
    repeated = np.zeros((n, _ROOM + 1), dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    for j in range(len(columns)):
        rank[np.argsort(interleave, kind="stable")] = np.arange(n)
        symbol = symbols[j][rank]
        order = np.argsort(symbol, kind="stable")
        between = np.maximum.reduceat(common, order + 1)
        interleave, symbol = interleave[order], symbol[order]
        common[0] = common[n] = j + 1
        common[1:n] = np.where(symbol[1:] == symbol[:-1], between[:-1], j + 1)
        start = j - LENGTH + 1
        if start < 0:
            continue
        rank[np.argsort(interleave, kind="stable")] = np.arange(n)
        member = np.concatenate([m[j + 1] + a for (_, m), a in zip(shards, offset, strict=True)])[rank]
        whole = (begin[member] <= start) & (end[member] > j)
        interval = np.cumsum(common[:n] > start)
        heavy = np.bincount(interval, weights=np.where(whole, weight[member], 0)) >= 2
        repeated[member, start] = whole & heavy[interval]
    return repeated


def runs(mask: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return np.stack([edge[0::2], edge[1::2] - 1], axis=1)


#: ``place`` packs 16 more bits of the text's hash, the start of a section, its size and the bytes before its anchor.
_SECTION = "key long, anchor long, content long, place long"


def _packed(check, start, size, lead):
    return check << 48 | start << 17 | size << 8 | lead


def _unpacked(place) -> tuple:
    """(check, start, size, lead) of packed places; works on integers and arrays."""
    return place >> 48 & 0xFFFF, place >> 17 & 0x7FFFFFFF, place >> 8 & 0x1FF, place & 0xFF


def _keyed(text: Column) -> list[Column]:
    """key and check, 80 bits of hash that tell texts apart; rows of equal texts share them."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0xFFFF)).alias("check")]


def _sectioned(texts: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in _SECTION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sections(t) for t in utf8(batch.column(2))]
            if not found:
                continue
            key, check = (np.repeat(batch.column(i).to_numpy(), [len(x[0]) for x in found]) for i in (0, 1))
            anchor, content, start, size, lead = (np.concatenate([x[i] for x in found]) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(anchor), pa.array(content), pa.array(_packed(check, start, size, lead))], names=names)

    return texts.select("key", "check", "text").mapInArrow(lean(run), _SECTION)


_PIECE = "group long, anchor long, content long, copies long, skip int, lead int, bytes binary, half int"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PIECE_TYPES)], names=[x.split()[0] for x in _PIECE.split(", ")])


def bounds(level: int, half: int) -> tuple[int, int]:
    """First and last start, from the anchor, of part ``half`` of the range of starts after ``level`` halvings."""
    at = lambda i: (_ROOM + 1) * i >> level
    return at(half) - _ROOM, at(half + 1) - 1 - _ROOM


def halved(anchor: int, content: int, copies: int, skip: int, lead: int, raw: bytes, half: int, level: int) -> Iterator[tuple]:
    """The two parts, at ``level``, of a piece whose strings start in part ``half`` of the level before."""
    for part in (2 * half, 2 * half + 1):
        low, high = bounds(level, part)
        a, b = max(low + lead, 0), min(high + lead, len(raw) - LENGTH)
        if a <= b:
            # all strings that start from low to high have these bytes, wherever the section ends
            core = raw[max(high, -_ROOM) + lead : low + lead + LENGTH]
            group = hashlib.blake2b(part.to_bytes(2, "little") + core, digest_size=8, salt=anchor.to_bytes(8, "little", signed=True), person=b"%d" % level).digest()
            yield int.from_bytes(group, "little", signed=True), anchor, content, copies, skip + a, lead - a, raw[a : b + LENGTH], part


def _read_sections(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted sections: one row each, grouped by anchor, or those of a large group in halves (half 0 and 1)."""
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "copies", "place", "different")).alias("wanted"))
    joined = texts.join(listed, "key").select("check", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()  # equal texts of a task hand on their sections once
        for batch in batches:
            rows = []
            for own, text, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for w in wanted:
                    check, start, size, lead = _unpacked(w["place"])
                    base = w["anchor"], w["content"], w["copies"]
                    if check != own or base[:2] in given:
                        continue
                    given.add(base[:2])
                    raw = text[start : start + size]
                    rows += halved(*base, 0, lead, raw, 0, 1) if w["different"] > SPLIT else [(w["anchor"], *base, 0, lead, raw, -1)]
            yield _pieces(rows)

    return joined.mapInArrow(lean(run), _PIECE)


def _halved(pieces: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pieces([x for r in batch.to_pylist() for x in halved(*(r[c] for c in ("anchor", "content", "copies", "skip", "lead", "bytes", "half")), level)])

    return pieces.mapInArrow(lean(run), _PIECE)


def _split(pieces: DataFrame) -> list[DataFrame]:
    """Intervals of the groups of ``pieces`` (level 1), halved until none is above ``SPLIT``."""
    hits = []
    for level in range(1, LEVELS + 1):
        # a section that equal texts of several tasks handed on is one
        once = pieces.groupBy("group", "anchor", "content").agg(F.first("copies").alias("copies"))
        sizes = written(once.groupBy("group").agg(F.count(F.lit(1)).alias("different"), F.sum("copies").alias("all")), "halves")
        if level == LEVELS:
            alone = join_counted(pieces, sizes.filter(F.col("all") > 1), "group")
            hits.append(alone.select("anchor", "content", F.struct(F.col("skip").alias("first"), (F.col("skip") + LENGTH).alias("stop")).alias("span")))
            break
        large = sizes.filter(F.col("different") > SPLIT).select("group")
        hits.append(_merged(join_counted(pieces, large, "group", "left_anti")))
        if not large.take(1):
            break
        pieces = written(_halved(join_counted(pieces, large, "group", "left_semi"), level + 1), f"halves{level}")
    return [h if "spans" in h.columns else h.select("anchor", "content", _span_bytes("span").alias("spans")) for h in hits]


def _span_bytes(span: str) -> Column:
    """One (first, stop) as the bytes that ``spans`` holds: two little-endian 16-bit numbers."""
    little = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256).cast("int")), 2, "0"))
    return F.unhex(F.concat(little(F.col(f"{span}.first")), little(F.col(f"{span}.stop"))))


def _merged(pieces: DataFrame) -> DataFrame:
    """(anchor, content, spans): covered runs within each different section, as pairs of offsets."""
    schema = "anchor long, content long, spans binary"

    def finish(table: pa.Table) -> pa.RecordBatch:
        seen: set[tuple] = set()  # sections that equal texts of several tasks handed on
        names = zip(*(table.column(c).to_pylist() for c in ("group", "anchor", "content")), strict=True)
        table = table.take(pa.array([i for i, x in enumerate(names) if x not in seen and not seen.add(x)]))
        raw, lead, skip = table.column("bytes").to_pylist(), table.column("lead").to_numpy(), table.column("skip").to_numpy()
        begin = _ROOM - lead.astype(np.int64)
        end = begin + np.array([len(x) for x in raw])
        flat = np.zeros((len(raw), COLUMNS), dtype=np.uint8)
        for row, a, text in zip(flat, begin.tolist(), raw, strict=True):
            row[a : a + len(text)] = np.frombuffer(text, dtype=np.uint8)
        repeated = merge_intervals(np.ascontiguousarray(flat.T), begin, end, table.column("copies").to_numpy())
        some = np.flatnonzero(repeated.any(axis=1))
        spans = []
        for i in some.tolist():
            found = runs(repeated[i]) - begin[i] + skip[i]
            found[:, 1] += LENGTH
            spans.append(found.astype("<u2").tobytes())
        pick = pa.array(some)
        return pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks().take(pick), table.column("content").combine_chunks().take(pick), pa.array(spans, pa.binary())], names=["anchor", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            if rows + len(group) > MERGE:  # close at the last change of group
                change = np.flatnonzero(group[1:] != group[:-1]) + 1
                cut = int(change[-1]) if len(change) else 0
                if cut or (held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != group[0]):
                    yield finish(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, rows = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield finish(pa.Table.from_batches(held))

    return pieces.repartition("group").sortWithinPartitions("group").mapInArrow(lean(run), schema)


def cover(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, with the kept bytes if wanted."""
    spark = documents.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", *_keyed(text), text.alias("text"))
    texts = keyed.select("key", "check", "text").filter(F.octet_length("text") >= LENGTH)
    placed = written(_sectioned(texts), "sections")
    # one row per anchor, combined before the shuffle: how often it occurs, and whether its sections differ
    by_anchor = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("copies"), F.min("content").alias("low"), F.max("content").alias("high"))
    # written, so that the join's sides are both plain exchanges and a hot anchor's sections can be split
    twice = written(by_anchor.filter("copies > 1").select("anchor", (F.col("low") == F.col("high")).alias("equal")), "anchors")
    repeated = written(placed.join(twice, "anchor").select("key", "anchor", "content", "place", "equal"), "repeated")
    erase(placed, twice)
    release(spark)
    # both of one row: aggregates that take the first take it together
    different = repeated.filter("not equal").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.first("key").alias("key"), F.first("place").alias("place"))
    sizes = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"))
    shared = written(different.join(sizes, "anchor"), "shared")
    release(spark)
    with batches_of(spark, 2048):
        pieces = written(_read_sections(texts, shared), "pieces")
        release(spark)
        parts = [written(_merged(pieces.filter("half < 0")), "intervals")]
        if pieces.filter("half >= 0").take(1):
            parts += [written(x, "intervals") for x in _split(pieces.filter("half >= 0"))]
        erase(pieces)
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    erase(shared)
    release(spark)
    # sections of an anchor whose sections are all equal are covered whole; equal texts have equal lists
    whole = repeated.filter("equal").select("key", "place", F.lit(None).cast("binary").alias("spans"))
    some = repeated.filter("not equal").join(hits, ["anchor", "content"]).select("key", "place", "spans")
    covered = whole.unionByName(some).groupBy("key").agg(F.collect_set(F.struct("place", "spans")).alias("covered"))
    joined = keyed.join(covered, "key", "left").select("doc_id", "check", "text", "covered")
    schema = documents.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text, covered in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                change = np.zeros(len(text) + 1, dtype=np.int64)
                for c in covered or ():
                    check, start, size, _ = _unpacked(c["place"])
                    if check != own:
                        continue
                    if c["spans"] is None:
                        found = np.array([[0, size]])
                    else:
                        found = np.frombuffer(c["spans"], dtype="<u2").reshape(-1, 2).astype(np.int64)
                    np.add.at(change, start + found[:, 0], 1)
                    np.add.at(change, start + found[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if covered else text
                rows.append((len(text), len(text) - len(kept), len(runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types[: len(schema.names) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return joined.mapInArrow(lean(run), schema)
