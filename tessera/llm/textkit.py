"""Vectorised text primitives shared by the corpus operators.

Texts reach Python as Arrow batches; everything here works on the raw UTF-8
bytes of a slice of documents at once, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A word is a maximal run of bytes outside this set (space, tab to CR).
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text handled by one vectorised step; longer documents go alone.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


Batches = Iterator[pa.RecordBatch]


#: What a worker keeps for the next task of the same kind, by kind.
kept: dict[str, object] = {}


def lean(run: Callable[[Batches], Batches], keeps: str = "") -> Callable[[Batches], Batches]:
    """``run`` for workers that live on beside other stages: what tasks of other kinds kept
    is let go at its start, and free memory goes back to the system at its end."""

    def each(batches: Batches) -> Batches:
        for kind in [k for k in kept if k != keeps]:
            del kept[kind]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return each


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    kept = _powers.get(base)
    if kept is None:
        kept = np.ones(1, dtype=np.uint64)
    while len(kept) < n:
        step = np.uint64(pow(base, len(kept), 1 << 64))
        kept = np.concatenate([kept, kept * step])
    _powers[base] = kept
    return kept[:n]


def digest64(data: bytes) -> int:
    """A 64-bit hash by which different bytes may be told apart, whoever wrote them."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``limit`` bytes together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Word boundaries and hashes of a slice of documents.

    ``start`` and ``end`` are byte positions in ``data`` (documents joined by a
    line feed), ``first`` holds the index of each document's first word and one
    more entry for the end.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.doc_start[1:])
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes: up to eight bytes are mixed as they are, longer words hashed with BLAKE2."""
        n = self.end - self.start
        packed = np.zeros(len(n), dtype=np.uint64)
        for k in range(8):
            at = np.flatnonzero(n > k)
            packed[at] |= self.data[self.start[at] + k].astype(np.uint64) << np.uint64(8 * k)
        out = mix64(mix64(packed) + n.astype(np.uint64))
        long = np.flatnonzero(n > 8)
        if len(long):
            raw, known = self.data.tobytes(), {}
            for i, a, b in zip(long.tolist(), self.start[long].tolist(), self.end[long].tolist(), strict=True):
                word = raw[a:b]
                h = known.get(word)
                if h is None:
                    h = known[word] = digest64(word)
                out[i] = h
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by the run's first word; each step mixes what came before."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out = mix64((out + np.uint64(_PRIME)) ^ word_hashes[k : k + m])
    return out


#: Bytes from which a text is shingled in stretches.
LONG_BYTES = 8 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def stretches(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """``text`` in parts of about ``size`` bytes that end between words, and whether each is the last."""
    at = 0
    while at + size < len(text):
        cut = _BLANK.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()], False
        at = cut.start()
    yield text[at:], True


def _long_shingles(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of one long text, by stretches; the last ``n - 1`` words of one open the next."""
    found, before, count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), 0
    for stretch, _ in stretches(text, LONG_BYTES // 2):
        words = Words([stretch]).hashes()
        count += len(words)
        run = np.concatenate([before, words])
        found = np.union1d(found, window_hashes(run, n))
        before = run[max(0, len(run) - n + 1) :]
    if 0 < count < n:
        found = _short(before)
    return found, np.array([0, len(found)])


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    return mix64(window_hashes(words, len(words)) ^ np.uint64(len(words)))


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's ``n``-word shingles, and where each document's begin.

    Equal shingles of one document appear once, sorted. A document of fewer
    than ``n`` words, but at least one, has the one shingle of all its words.
    """
    if len(texts) == 1 and len(texts[0]) > LONG_BYTES:
        return _long_shingles(texts[0], n)
    return _shingles(texts, n)


def _shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    h, first = words.hashes(), words.first
    count = np.diff(first)
    runs = window_hashes(h, n)
    per_doc = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(per_doc, out=begin[1:])
    doc = np.repeat(np.arange(len(texts)), per_doc)
    at = first[:-1][doc] + (np.arange(begin[-1]) - begin[:-1][doc])
    long = count[doc] >= n
    out = np.zeros(begin[-1], dtype=np.uint64)
    out[long] = runs[at[long]]
    for i in np.flatnonzero((count < n) & (count > 0)):
        out[begin[i]] = _short(h[first[i] : first[i + 1]])[0]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    begin[1:] = np.cumsum(np.bincount(doc[keep], minlength=len(texts)))
    return out[keep], begin
