import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import LENGTH


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k : k + LENGTH] for _, t in texts for k in range(len(t) - LENGTH + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in suffix_dedup.cover(df).collect())


def test_equals_brute_force(documents, rows_of):
    want = brute(rows_of)
    assert sum(r[2] for r in want) > 3000
    assert found(documents) == want


def test_repeated_rows_and_clashing_columns(clashing, rows_of):
    twice = clashing.unionByName(clashing)
    assert found(twice) == brute(rows_of * 2)


def test_empty(nothing):
    assert found(nothing) == []


def test_split_anchors_and_short_stretches(monkeypatch, documents, rows_of):
    """Hot anchors are split on more context, long texts cut: same results."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    monkeypatch.setattr(suffix_dedup, "MERGE", 64)
    assert found(documents) == brute(rows_of)


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """A passage of 116 bytes and one of 160, each among many different texts: groups stay small, results are those of brute force."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", 100)
    r = np.random.default_rng(2)
    noise = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    short, long = noise(116), noise(160)
    tails = [noise(100) for _ in range(5)]
    texts = [noise(120) + short + noise(120) for _ in range(300)] + [noise(30) + long + tails[i % 5] + noise(20) for i in range(300)]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("level", range(1, suffix_dedup.LEVELS + 1))
def test_halves_hold_every_start_once(level):
    starts = [s for half in range(1 << level) for a, b in [suffix_dedup.bounds(level, half)] for s in range(a, b + 1)]
    assert starts == list(range(-suffix_dedup._ROOM, 1))
    for half in range(1 << level):
        a, b = suffix_dedup.bounds(level, half)
        parts = [suffix_dedup.bounds(level + 1, 2 * half + i) for i in (0, 1)]
        assert parts[0][0] == a and parts[1][1] == b
    assert level < suffix_dedup.LEVELS or all(a >= b for a, b in (suffix_dedup.bounds(level, h) for h in range(1 << level)))


def test_many_copies_of_one_row(spark):
    """Copies of a row share one list of sections: work grows with the rows, not with their square."""
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(3000))
    rows = [(1, text)] * 1500 + [(2, text + " tail")] * 3 + [(3, "x" * 150)] * 3
    got = Counter(found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert got == Counter({row: n for row, n in zip(brute([rows[0], rows[0], rows[1500], rows[1500], rows[-1], rows[-1]])[::2], (1500, 3, 3), strict=True)})


@pytest.mark.parametrize("shard", [1, 3, 7, 4096])
def test_merged_shards_equal_window_counts(shard):
    """Aligned strings over few symbols: the merge finds exactly the windows that occur twice."""
    rng = np.random.default_rng(shard)
    n = 40
    base = rng.integers(1, 3, (4, suffix_dedup.COLUMNS), dtype=np.uint8)
    rows = base[rng.integers(0, 4, n)].copy()
    for row in rows:
        row[rng.integers(0, suffix_dedup.COLUMNS, 2)] = 3
    begin, weight = rng.integers(0, suffix_dedup._ROOM, n), rng.integers(1, 3, n)
    end = np.minimum(begin + LENGTH + rng.integers(0, 150, n), suffix_dedup.COLUMNS)
    for row, a, b in zip(rows, begin, end, strict=True):
        row[:a] = row[b:] = 0
    got = suffix_dedup.merge_intervals(np.ascontiguousarray(rows.T), begin, end, weight, shard)
    want = np.zeros_like(got)
    for s in range(got.shape[1]):
        counts = Counter()
        for row, a, b, w in zip(rows, begin, end, weight, strict=True):
            if a <= s and s + LENGTH <= b:
                counts[row[s : s + LENGTH].tobytes()] += w
        for i, (row, a, b) in enumerate(zip(rows, begin, end, strict=True)):
            want[i, s] = a <= s and s + LENGTH <= b and counts[row[s : s + LENGTH].tobytes()] > 1
    assert want.any() and (got == want).all()


def test_kept_bytes(documents):
    got = suffix_dedup.cover(documents, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
