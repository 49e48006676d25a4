import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(seed=2, docs=60):
    r = np.random.default_rng(seed)
    letters = list("aabbcdeÀéÿ×÷z")
    stems = ["".join(r.choice(letters, r.integers(7, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab"]
    many = [s for s in stems[:6] for _ in range(200)]
    out = []
    for i in range(docs):
        words = list(r.choice(many, 30))
        for s in r.choice(stems, 25):
            k, c = int(r.integers(len(s))), r.choice(letters)
            words += [s, s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + s[k:]][r.integers(4) :][:1] * 2
        out.append((i, " 1,\n".join(words).upper() if i % 7 == 0 else "-".join(words)))
    long = "".join(r.choice(list("abc"), 3000))
    out += [(900, f"{long} {long} {long[:1500]}d{long[1500:]} {long[1:]} {long[1:]}"), (901, f"{long[:1500]}d{long[1500:]}"), (902, None), (903, ""), (904, "12 çat"), (905, "rootword " * 500 + "rootwords " * 40 + "rootwordsy " * 3)]
    return out


@pytest.fixture(scope="module")
def rows_():
    return texts()


def test_equals_brute_force(spark, rows_):
    want = brute(rows_)
    assert sum(r[1] is not None for r in want) > 20 and sum(r[2] != (r[1] or r[0]) for r in want) >= 1
    assert found(spark.createDataFrame(rows_, SCHEMA)) == want


def test_large_groups_are_dealt_again(spark, rows_, monkeypatch):
    """With groups of at most 40 bytes nearly all are halved, down to single positions."""
    assert found(spark.createDataFrame(rows_, SCHEMA), limit=40) == brute(rows_)


def test_a_third_of_all_words_share_their_ends(spark):
    """Words with one beginning and one end that differ in the middle: groups stay small."""
    r = np.random.default_rng(4)
    words = sorted({"common" + "".join(r.choice(list("abcd"), 5)) + "ending" for _ in range(300)})
    rows = [(i, " ".join([w, w])) for i, w in enumerate(words)]
    assert found(spark.createDataFrame(rows, SCHEMA), limit=400) == brute(rows)
    tables = spelling.dealt(spelling.word_counts(spark.createDataFrame(rows, SCHEMA)), limit=400)
    sizes = [x for t in tables for x in t.groupBy("size", "first", "stop", "group").agg(F.sum(F.length("word")).alias("held")).collect()]
    assert all(x["held"] <= 400 or x["stop"] - x["first"] == 1 for x in sizes)


def test_repeated_rows_clashing_columns_and_nothing(spark, rows_, nothing):
    twice = spark.createDataFrame(rows_[:30] * 2, SCHEMA)
    for name in ("word", "n", "form", "root", "size", "first", "stop", "group", "best"):
        twice = twice.withColumn(name, F.lit("clash"))
    assert found(twice) == brute(rows_[:30] * 2)
    assert found(nothing) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 300])
def test_wavelet_matrix_reports_rectangles(n):
    r = np.random.default_rng(n)
    values = r.permutation(n)
    matrix = spelling.WaveletMatrix(values)
    ends = [np.sort(r.integers(0, n + 1, (2, 50)), axis=0) for _ in range(2)]
    query, value = matrix.report(*ends[0], *ends[1])
    got = sorted(zip(query.tolist(), value.tolist(), strict=True))
    want = [(q, int(v)) for q in range(50) for v in values[ends[0][0][q] : ends[0][1][q]] if ends[1][0][q] <= v < ends[1][1][q]]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [7, 8, 9])
def test_near_pairs_of_all_words(size):
    """All words of two letters: each pair is reported once from the side that asks."""
    import itertools

    words = [bytes(w) for k in (size - 1, size) for w in itertools.product(b"ab", repeat=k)][::3]
    got = [(words[a], words[b]) for first, stop in ((0, size // 2), (size // 2, size)) for x, y in spelling.near_pairs(words, size, first, stop) for a, b in zip(x, y, strict=True)]
    want = [(a, b) for a in words for b in words if len(b) == size and a != b and one_apart(a, b)]
    assert sorted(got) == sorted(want)
