import random
import re

import numpy as np

from tessera.llm import components, jaccard_join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, least[root(k)], links[k]) for k, (i, _) in enumerate(sets))


def found(df):
    return sorted(tuple(r) for r in jaccard_join.classes(df).collect())


def near_copies(n):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randrange(8)):
            words[r.randrange(300)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_equals_brute_force(documents, rows_of):
    want = brute(rows_of)
    assert sum(r[2] for r in want) >= 8
    assert found(documents) == want


def test_near_copies_in_small_blocks(spark, monkeypatch):
    """Large buckets of like nodes go block by block, unlike ones are split: same links."""
    monkeypatch.setattr(jaccard_join, "BRUTE", 6)
    monkeypatch.setattr(jaccard_join, "VERIFY_TOKENS", 1200)
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    shared = " ".join(f"s{k}" for k in range(40))
    r = random.Random(9)
    rows = [(i, t) for i, t in enumerate(near_copies(30) + [shared + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60)) for _ in range(30)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_repeated_rows_and_clashing_columns(clashing, rows_of):
    rows = rows_of[:30]
    part = clashing.filter("doc_id < 30")
    assert found(part.unionByName(part)) == brute(rows * 2)


def test_empty(nothing):
    assert found(nothing) == []


def test_long_texts_in_stretches(monkeypatch):
    from tessera.llm import textkit

    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(400)).encode(), b"x" * 900 + b" a b c d e f " + b"y" * 700, b"one two", b"z" * 1000, b"  " + b"p q " * 300 + b"\n"]
    want = [textkit.shingles([t])[0].tolist() for t in texts]
    monkeypatch.setattr(textkit, "LONG_BYTES", 100)
    assert [textkit.shingles([t])[0].tolist() for t in texts] == want


def test_null_id_takes_no_part(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.classes(df).collect()), key=str) == [(1, 1, 1), (2, 1, 1), (None, None, 0)]


def test_one_of_each(documents, rows_of):
    want = {i for i, c, _ in brute(rows_of) if i == c}
    got = jaccard_join.one_of_each(documents.unionByName(documents.filter("doc_id = 20")))
    assert got.columns == documents.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (7, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 300], 0), 100: 100, 101: 100}


def test_sketches_tell_like_from_unlike():
    rng = np.random.default_rng(1)
    common, rest = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 1200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rest[:100]])), np.unique(np.concatenate([common, rest[100:200]])), np.unique(rest[200:])]
    s = jaccard_join.sketch(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    agree = lambda a, b: 128 - int(np.bitwise_count(s[a] ^ s[b]).sum())
    assert agree(0, 1) >= jaccard_join.SKETCH_AGREE > agree(0, 2)


def test_one_of_each_drops_only_copies(spark):
    """Repeated ids: a row goes by its own text; null ids and unlinked namesakes stay."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (3, text(4)), (3, text(5)), (3, None), (4, text(6)), (5, text(6) + " tail"), (5, text(7)), (6, text(8)), (6, ""), (7, text(9)), (7, text(9) + " end")]
    rows += [(8, text(10)), (8, text(10)), (8, text(11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()), key=str)
    gone = [(1, text(1)), (2, text(1)), (5, text(6) + " tail"), (8, text(10))]
    want = list(rows)
    for r in gone:
        want.remove(r)
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert [r for r in got if r[0] != 7] == sorted((r for r in want if r[0] != 7), key=str)


def test_large_group_of_near_copies_among_texts_of_one_passage(spark, monkeypatch):
    """A passage that 900 texts share and 5,000 near copies: classes of the copies, links as counted plainly."""
    monkeypatch.setattr(jaccard_join, "BRUTE", 512)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    copies = []
    for i in range(5000):
        words = list(base)
        for k in range(i % 3):
            words[20 + 30 * k] = f"e{r.randrange(10**6)}"
        copies.append(" ".join(words))
    passage = " ".join(f"s{k}" for k in range(40))
    others = [passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60)) for _ in range(900)]
    others[1] = others[0] + " tail"
    texts = copies + others
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [shingle_set(t) for t in texts]
    sample = [*range(0, 5000, 250), 5000, 5001, 5002]
    assert [got[i][2] for i in sample] == [sum(9 * len(sets[i] & s) >= 4 * (len(sets[i]) + len(s)) for s in sets) - 1 for i in sample]
    assert {c for i, c, n in got[:5000] if n} == {0} and [c for _, c, _ in got[5000:5003]] == [5000, 5000, 5002]


def test_words_that_polynomials_confuse(spark, lookalike):
    """Documents of different words are not linked, whatever their words' polynomial hashes."""
    one, other = lookalike
    rows = [(0, " ".join([one] * 8)), (1, " ".join([other] * 8)), (2, " ".join([one] * 8))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 1)}


def test_runs_within_keep_the_recall():
    """Simulated: pairs share a Poisson number of buckets, each found within by the runs there, one or two levels down."""
    runs, r = jaccard_join.runs_for(), np.random.default_rng(1)
    within = jaccard_join.runs_within(runs)
    assert within < runs
    shared = r.poisson(runs, 2_000_000)
    lower = r.poisson(within, (shared.sum()))
    owner = np.repeat(np.arange(len(shared)), shared)
    two = r.random(len(lower)) < 1 - np.exp(-within * lower)
    for found in (lower > 0, two):
        met = np.bincount(owner[found], minlength=len(shared)) > 0
        assert 1 - met.mean() < 1.2 * (1 - jaccard_join.RECALL)
