import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tessera.llm.line_dedup import Layout

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, min_chars=20):
    """Straight from the rule, on str instead of bytes."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    out = line_dedup.dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def lined(seed=1, docs=60):
    r = np.random.default_rng(seed)
    shared = [f"Shared line number {i:03d} ÉTÉ" for i in range(12)] + ["ü" * 19, "ü" * 20, "short line", "x" * 19, "\U0001f600" * 20]
    rows = []
    for i in range(docs):
        lines = [f"Own line {i} of this text, number {k}" for k in range(r.integers(0, 6))]
        for s in r.choice(shared, r.integers(0, 7)):
            lines.append([s, "  " + s + "\t", s.upper() if s.isascii() else s, s + "\r", "\x0b" + s][r.integers(5)])
        r.shuffle(lines)
        rows.append((int(i * 7 % 61), "\n".join(lines)))
    hot = "The one line that every third document holds."
    rows += [(1000 + i, f"{hot}\nonly here {i} and in no other text\n{hot}") for i in range(40)]
    return [*rows, (2000, None), (2001, ""), (2002, "\n\n"), (None, hot), (None, None), (1005, hot), (2003, hot + "\n" + "long text of one line " * 20_000)]


@pytest.fixture(scope="module")
def rows_():
    return lined()


SCHEMA = "doc_id long, text string"


def test_equals_brute_force(spark, rows_):
    want = brute(rows_)
    assert sum(r[2] for r in want) > 150
    assert found(spark.createDataFrame(rows_, SCHEMA)) == want


def test_hashed_where_joined(spark, rows_):
    out = line_dedup.dedup(spark.createDataFrame(rows_, SCHEMA), hashed=True)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows_)


def test_corpus(documents, rows_of):
    assert found(documents) == brute([r[:2] for r in rows_of])


def test_repeated_rows_clashing_columns_and_nothing(spark, rows_, nothing):
    twice = spark.createDataFrame(rows_ * 2, SCHEMA)
    for name in ("gone", "high", "low", "slice", "segment", "keeper", "kept", "docs"):
        twice = twice.withColumn(name, F.lit("clash"))
    assert found(twice) == brute(rows_ * 2)
    assert found(nothing) == []


def test_many_slices(spark, rows_, monkeypatch):
    """Filters cut into slices give the same lines."""
    monkeypatch.setattr(line_dedup, "SEGMENT_BITS", 64)
    monkeypatch.setattr(line_dedup, "SLICE_BITS", 512)
    assert Layout.of(400).slices > 5
    assert found(spark.createDataFrame(rows_, SCHEMA)) == brute(rows_)


def test_filters_hold_all_repeats_and_few_others():
    """Every digest met twice, in one step or in two, is a suspect; of 20,000 single ones, under one in a hundred."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    digests = r.integers(-(2**63), 2**63 - 1, (20_000, 2))
    layout = Layout.of(len(digests) + 300)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["high", "low"])
    steps = [np.concatenate([digests[:12_000], digests[:100], digests[50:60]]), np.concatenate([digests[12_000:], digests[100:200]])]
    sent = [b for s in steps for b in line_dedup._inserts(layout)(iter([batch(s)]))]
    table = pa.Table.from_batches(sent).sort_by("segment")
    held = {s: np.frombuffer(b, dtype=np.uint8) for f in line_dedup._merge(layout)(iter(table.to_batches())) for s, b in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True)}
    segment, places = layout.places(digests[:, 0], digests[:, 1])
    suspect = np.array([line_dedup._set(held[s], p).all() for s, p in zip(segment.tolist(), places, strict=True)])
    assert suspect[:200].all()
    assert suspect[200:].mean() < 0.01


def test_layout_grows_with_the_keys():
    assert Layout.of(0) == Layout(1, line_dedup.SEGMENT_BITS, line_dedup.SLICE_BITS)
    large = Layout.of(10**11)
    assert large.segments <= line_dedup.SEGMENTS and large.segments * large.segment_bits >= 16 * 10**11
    assert large.slice_segments * large.segment_bits == line_dedup.SLICE_BITS
