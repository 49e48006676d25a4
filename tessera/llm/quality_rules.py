"""Line-first cleaning: judge lines, remove the failures, reject documents that lose too much.

A line with a word fails by
- punctuation: over a tenth of its word characters are symbols of ``[#*$%&|<>]``;
  or it has three words or more and as many exclamation marks as words;
  or it is short and its last character closes no sentence;
- navigation: at least two bars with no more than four words between them on average;
- boilerplate: a line of at most ``BOILERPLATE_WORDS`` words with a stock phrase.

A document is kept if it passes the base rules (20 words at least; no more than
30% of its words in repeated 8-word windows) and the failed lines hold at most
half of its word characters.

Edge cases: a null, empty or blank text has no words and fails the base rules;
repeated rows are judged each; there are no ties, since lines are judged one by one; a
very long text is judged whole by one task, in memory of some 100 times its size; an
empty table gives no rows; further columns are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches
from .textkit import Words, digest64, lean, mix64, slices, utf8, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line of fewer words must close with one of TERMINALS.
SHORT_LINE_WORDS = 8
TERMINALS = (".", "!", "?", ":", ";", "…", '"', "'", ")", "]", "”", "»", "。", "！", "？")
NAVIGATION_WORDS = 4
BOILERPLATE_WORDS = 20
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "lorem ipsum", "licensed under the", "released under the", "is licensed under", "copyright ©", "copyright (c)",
    "subscribe to our newsletter", "click here", "skip to content", "share on facebook",
)
#: A document that loses more than this share of its word characters is rejected.
MAX_LOSS_PERCENT = 50

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "chars_removed")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key came before."""
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = keys[order][1:] == keys[order][:-1]
    return later


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The counts of ``COLUMNS`` per document, and the (start, end) of each failed line, per document."""
    w = Words(texts)
    data, n_docs = w.data, len(texts)
    doc_at = w.doc_start
    n_words = np.diff(w.first)
    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[w.start] += 1
    in_word[w.end] -= 1
    char = (np.cumsum(in_word[:-1]) > 0) & ((data & 0xC0) != 0x80)
    chars, symbols = _sums(char), _sums(_table(SYMBOLS)[data])

    # words in repeated windows
    hashes, doc = w.hashes(), w.doc_of_word()
    windows = window_hashes(hashes, WINDOW)
    inside = doc[: len(windows)] == doc[WINDOW - 1 :] if len(windows) else np.zeros(0, dtype=bool)
    salt = mix64(np.arange(n_docs, dtype=np.uint64) + np.uint64(1))
    at = np.flatnonzero(inside)
    at = at[_repeats(windows[at] ^ salt[doc[at]])] if len(at) else at
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1) if len(at) else None
    covered = _sums(np.cumsum(cover[:-1]) > 0)

    # lines: documents are joined by line feeds, so every line ends at one
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    line_doc = np.searchsorted(doc_at, start, side="right") - 1
    first_word = np.searchsorted(w.start, start)
    words = np.searchsorted(w.start, stop) - first_word
    real = np.flatnonzero(words)
    start, stop, line_doc, words, last_word = start[real], stop[real], line_doc[real], words[real], first_word[real] + words[real] - 1
    raw = data.tobytes()
    line_hash = np.fromiter((digest64(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), dtype=np.uint64, count=len(start)) ^ salt[line_doc]
    dup = _later(line_hash)

    line_chars = chars[stop] - chars[start]
    bars, bangs = (_sums(data == ord(c)) for c in "|!")
    bars, bangs = bars[stop] - bars[start], bangs[stop] - bangs[start]
    failed = (10 * (symbols[stop] - symbols[start]).astype(np.int64) > line_chars) | ((words >= 3) & (bangs >= words))
    closed = np.zeros(len(start), dtype=bool)
    end = w.end[last_word] if len(last_word) else last_word
    for mark in (t.encode() for t in TERMINALS):
        hit = end - start >= len(mark)
        for k, byte in enumerate(reversed(mark)):
            hit &= data[np.maximum(end - 1 - k, 0)] == byte
        closed |= hit
    failed |= (words < SHORT_LINE_WORDS) & ~closed
    failed |= (bars >= 2) & (words - bars <= NAVIGATION_WORDS * (bars + 1))
    lower, stock = raw.lower(), np.zeros(len(start), dtype=bool)
    for phrase in (p.encode() for p in BOILERPLATE):
        spot = lower.find(phrase)
        while spot >= 0:
            line = np.searchsorted(start, spot, side="right") - 1
            stock[line] |= line >= 0 and spot + len(phrase) <= stop[line]
            spot = lower.find(phrase, int(max(stop[line], spot + 1)) if line >= 0 else spot + 1)
    failed |= stock & (words <= BOILERPLATE_WORDS)

    per_doc = lambda weights=None, pick=slice(None): np.bincount(line_doc[pick], weights=weights, minlength=n_docs).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": (chars[doc_at[1:]] - chars[doc_at[:-1]]).astype(np.int64),
        "n_symbols": (symbols[doc_at[1:]] - symbols[doc_at[:-1]]).astype(np.int64),
        "n_dup_lines": per_doc(pick=dup),
        "n_repeat_words": (covered[w.first[1:]] - covered[w.first[:-1]]).astype(np.int64),
        "n_lines": per_doc(),
        "n_lines_removed": per_doc(pick=failed),
        "chars_removed": per_doc(line_chars[failed], failed),
    }
    spans = np.stack([start - doc_at[line_doc], stop - doc_at[line_doc]], axis=1)[failed] if len(start) else np.zeros((0, 2), dtype=np.int64)
    cuts = np.searchsorted(line_doc[failed], np.arange(1, n_docs))
    return out, np.split(spans, cuts)


def verdicts(counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    kept = ~base_failed & (100 * counts["chars_removed"] <= MAX_LOSS_PERCENT * counts["word_chars"])
    return base_failed, kept


def judge(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and verdicts, one row per document."""
    names = [key, *COLUMNS[:5], "base_failed", "kept", *COLUMNS[5:]]
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, {', '.join(f'{c} long' for c in COLUMNS[:5])}, base_failed boolean, kept boolean, {', '.join(f'{c} long' for c in COLUMNS[5:])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                counts, _ = measure(texts[a:b])
                base_failed, kept = verdicts(counts)
                columns = [pa.array(counts[c], pa.int64()) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns[:5], pa.array(base_failed), pa.array(kept), *columns[5:]], names=names)

    small_batches(documents.sparkSession)
    return documents.select(key, "text").mapInArrow(lean(run), schema)


def clean(documents: DataFrame) -> DataFrame:
    """The kept documents without their failed lines; all columns stay."""
    names = documents.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(text_at))
            for a, b in slices(texts):
                counts, failed = measure(texts[a:b])
                _, kept = verdicts(counts)
                out = []
                for text, spans in zip(texts[a:b], failed, strict=True):
                    parts, at = [], 0
                    for start, stop in spans.tolist():
                        parts.append(text[at:start])
                        at = stop + 1
                    out.append(b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
                part = batch.slice(a, b - a)
                columns = [pa.array(out, part.schema.field(i).type) if i == text_at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(lean(run), documents.schema)
