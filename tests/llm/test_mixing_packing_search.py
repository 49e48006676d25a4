import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hamming_search, mixing, packing
from tessera.llm.queries import tokenizer_file


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fair_targets(rows, weights=(3, 1, 2)):
    """Shares by weight; whatever is above a cap is shared again, until nothing is."""
    sizes = defaultdict(int)
    for _, t, _, source, *_ in rows:
        sizes[source] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = left / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * share > 2 * sizes[s] + 1e-9}
        if not over:
            return sizes, target | {s: weight[s] * share for s in open_}
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over


def test_mix(documents, rows_of):
    got = mixing.mix(documents, block=8).collect()
    sizes, target = fair_targets(rows_of)
    source = {r[0]: r[3] for r in rows_of}
    taken = Counter()
    for r in got:
        assert r.size == words(rows_of[r.doc_id][1]) and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows_of)
    for s, n in taken.items():
        assert abs(n - target[s]) <= 8
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(documents, block=8).collect()))


def test_mix_over_several_shards(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), None, "big" if i % 3 else f"s{i % 8}", 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, block=16, shard_rows=100).collect()
    sizes, target = fair_targets(rows)
    taken = Counter()
    for r in got:
        taken[rows[r.doc_id][3]] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 12 * 9 for s in sizes)


def plain_seats(targets, block):
    seats, house = Counter(), round(sum(targets.values()) / block)
    for _ in range(house):
        seats[max(targets, key=lambda k: (targets[k] / (2 * seats[k] + 1), [-ord(c) for c in k]))] += 1
    return seats


def test_quotas_are_sainte_lague(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for shard in range(6):
        targets = {f"k{j:02d}": float(rng.integers(0, 3000) if j else rng.integers(0, 60_000)) for j in range(int(rng.integers(1, 40)))}
        rows += [(shard, k, t / 100) for k, t in targets.items()]
        want |= {(shard, k): n for k, n in plain_seats({k: t for k, t in targets.items() if t}, 100).items()}
    df = spark.createDataFrame(rows, "shard int, skey string, cell_target double")
    got = {(r.shard, r.skey): r.quota for r in mixing.quotas(df).collect() if r.quota}
    assert got == want


def test_mix_edge_cases(clashing, nothing, spark, rows_of):
    assert mixing.mix(clashing.unionByName(clashing)).count() == 2 * len(rows_of)
    assert mixing.mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.size, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0)}


def test_mixed_documents(clashing, rows_of):
    out = mixing.mixed_documents(clashing, block=8)
    assert out.columns == clashing.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(clashing.select("doc_id", "text", "source"), block=8).collect()}
    got = Counter()
    for r in out.collect():
        assert rows_of[r.doc_id][1].startswith(r.text.rstrip()) or r.text in rows_of[r.doc_id][1]
        assert r.n_chars == len(r.text)
        got[r.doc_id] += words(r.text)
    assert sum(got.values()) == pytest.approx(sum(taken.values()), rel=0.1)
    assert all(n <= 2 * words(rows_of[i][1]) for i, n in got.items())


def plain_mixed(rows, block):
    """(doc_id, words) of every row of the mix over one shard; no two rows are equal."""
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    sizes, target = fair_targets(rows)
    streams = {s: [] for s in sizes}

    def lot(row):
        others = {k: v for k, v in zip(("doc_id", "lang", "source", "n_chars"), (row[0], *row[2:]), strict=True) if v is not None}
        same = md5(*([] if row[1] is None else [md5(row[1])]), json.dumps(others, separators=(",", ":")))
        return md5("mix-1", same, 0)

    for at in sorted(range(len(rows)), key=lambda at: lot(rows[at])):
        streams[rows[at][3]] += [(at, j) for j in range(words(rows[at][1]))]
    blocks = {s: max(1, math.floor(len(x) / block + 0.5), min(len(x), mixing.FEWEST)) for s, x in streams.items()}
    skey = {s: "" if s is None else "=" + s for s in sizes}
    seats = plain_seats({skey[s]: target[s] * blocks[s] / sizes[s] for s in sizes if sizes[s]}, 1)
    out = []
    for s, stream in streams.items():
        n = blocks[s]
        passes, more = divmod(min(seats[skey[s]], 2 * n), n)
        extra = sorted(range(n), key=lambda b: md5("mix-1", skey[s], 0, b))[:more]
        places = defaultdict(list)
        for b in sorted(extra):
            for at, j in stream[b * len(stream) // n : (b + 1) * len(stream) // n]:
                places[at].append(j)
        for at in {at for at, _ in stream}:
            text = re.findall(r"[^\x20\x09-\x0D]+", rows[at][1])
            out += [(rows[at][0], text)] * passes
            starts = [j for j in places[at] if j - 1 not in places[at]]
            out += [(rows[at][0], text[a : next(e for e in range(a, len(text) + 1) if e not in places[at])]) for a in starts]
    return sorted(out)


@pytest.mark.parametrize("block", [8, 128])
def test_mixed_documents_are_the_chosen_blocks(spark, block):
    """A hot source of long texts with a small share, and many equal sources: the words are those of the blocks."""
    rows = [(i, "\n ".join(f"d{i}w{j}" for j in range(300 + 31 * i)), None, "hot" if i % 3 else f"s{i:02d}", 0) for i in range(20)]
    rows += [(40, " lead  and tail \t", None, "hot", 0), (41, None, None, "hot", None), (42, " ", None, None, 1), (43, "one", None, "Aone", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = mixing.mixed_documents(df, block=block).collect()
    text_of = {r[0]: r[1] for r in rows}
    assert all(r.text in text_of[r.doc_id] for r in got)
    want = plain_mixed(rows, block)
    assert sorted((r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in got) == want
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_documents(df.repartition(7), block=block).collect()))


def test_many_small_sources(spark):
    """3,000 sources of two short documents: their words come near the targets."""
    rows = [(i, " ".join(["w"] * (20 + i * 7 % 31)), None, f"s{i // 2:04d}", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes, target = fair_targets(rows)
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[rows[r.doc_id][3]] += r.taken
        assert r.taken <= 2 * r.size
    assert sum(abs(taken[s] - target[s]) / target[s] for s in sizes) / len(sizes) < 0.02


def test_equal_rows_and_any_partitioning(spark):
    """Equal rows and rows without an id are dealt apart; partitions do not matter; working names may be columns."""
    rows = [(None if i % 3 else 7, f"t{i % 4} " * (5 + i % 9), "s", "x", 1, "y") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, doc int, cuts string")
    one, many = (sorted(map(tuple, mixing.mixed_documents(d, block=4, shard_rows=50).collect()), key=str) for d in (df.coalesce(1), df.repartition(9)))
    assert one == many and len(one) > 300
    assert mixing.mixed_documents(df).columns == df.columns
    narrow = df.select("doc_id", "text", "source")
    one, many = (sorted(map(tuple, mixing.mix(d, block=4, shard_rows=50).collect()), key=str) for d in (narrow.coalesce(1), narrow.repartition(9)))
    assert one == many and sum(r[4] for r in one) == pytest.approx(1.5 * sum(r[1] for r in one), rel=0.05)


def pieces_of(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    out = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            out.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check_packing(rows, want):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return check_packing_places(rows)


def check_packing_places(rows):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held)


def test_packing(clashing, rows_of, nothing):
    twice = clashing.unionByName(clashing)
    rows = packing.pack(packing.pieces(twice, tokenizer_file(), with_ids=False)).collect()
    used = check_packing(rows, pieces_of(rows_of * 2))
    assert used == math.ceil(sum(r.length for r in rows) / 2048)
    assert packing.pack(packing.pieces(nothing, tokenizer_file(), with_ids=False)).count() == 0


@pytest.mark.parametrize("histogram", [{1: 5000}, {2: 1500, 1: 3}, {2040: 2, 2: 1200, 1: 1100}])
def test_many_pieces_of_one_sequence(histogram):
    plan = packing.complete_bins(histogram)
    packed = Counter()
    for pattern, times in plan:
        assert sum(n * m for n, m in pattern) <= 2048
        for n, m in pattern:
            packed[n] += m * times
    assert packed == Counter(histogram)
    assert sum(t for _, t in plan) == math.ceil(sum(n * c for n, c in histogram.items()) / 2048)


def test_packing_of_empty_texts(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    rows = packing.pack(packing.pieces(df, tokenizer_file(), with_ids=False)).collect()
    assert len(rows) == 5000 and check_packing(rows, sorted((r.doc_id, 0, 0, 1, r.ids_crc32) for r in rows)) == 3


def test_ids(documents, rows_of):
    row = packing.pieces(documents.filter("doc_id = 3"), tokenizer_file()).first()
    assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32 and row.ids[-1] == 0


def test_long_text_in_stretches(spark):
    """Texts beyond the bytes of a stretch are cut as if encoded whole, and keep their ids."""
    words = [f"word{i % 977}x" for i in range(1_000_000)]
    rows = [(0, "short one"), (1, " ".join(words)), (2, None), (3, "\n".join(words[:700_000]))]
    assert all(len(t) > packing.STRETCH for t in (rows[1][1], rows[3][1]))
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_file()).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces_of(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found[::50])
    assert len({r.document for r in found}) == 4 and len({(r.length, r.place) for r in found}) == len(found)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", " ", "ÀÉß Straße ıİ don't it's x<|endoftext|>y <|EndOfText|> ！。 Ünï... 3,5 áb é. École,» «x» naïve!? ÿŸ", "\x1c a\x1cb c d", "Ĳ ǅ ﬁn ½ A̧", "we'll, 's don't.", "İstanbul. ẞ. Σίσυφος. ОДИН", "%%% a### b$$$, x|y ‼"]
    ids, begin = packing.encoder(tokenizer_file())([t.encode() for t in texts])
    tokenizer = Tokenizer.from_file(tokenizer_file())
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def fewest(items, capacity):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += items[i]
                put(i + 1, rest)
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_incumbent_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 60, 400).tolist()
    plan = packing.best_fit(Counter(items), 100)
    packed = Counter()
    for pattern, times in plan:
        assert sum(n * m for n, m in pattern) <= 100
        for n, m in pattern:
            packed[n] += m * times
    assert packed == Counter(items)
    assert packing.size_of(plan) == plain_best_fit(items, 100) >= packing.size_of(packing.complete_bins(Counter(items), 100))


def test_fillings_are_all_undominated_ones():
    """Against all fillings tested pair by pair: kept are those that nothing dominates."""
    lengths, left, room = [2, 3, 5, 7, 8], [2, 1, 2, 1, 1], 14
    every = {()}
    for n, c in zip(lengths, left, strict=True):
        every |= {tuple(sorted([*f, *[n] * k])) for f in every for k in range(c + 1) if sum(f) + n * k <= room}

    def beaten(f):
        for x in {n for n, c in zip(lengths, left, strict=True) if f.count(n) < c}:
            for k in range(1, len(f) + 1):
                for part in combinations(f, k):
                    if sum(part) <= x <= sum(part) + room - sum(f) and (sum(part) < x or k > 1):
                        return True
            if x <= room - sum(f):
                return True
        return False

    want = sorted((room - sum(f), f) for f in every if not beaten(f))
    got, _ = packing.fillings(room, lengths, left, room)
    assert sorted((room - sum(f), tuple(sorted(f))) for f in got) == want


def test_better_than_best_fit():
    """Best-fit decreasing takes three sequences where two do."""
    items = Counter([4, 4, 3, 3, 3, 3])
    assert packing.size_of(packing.best_fit(items, 10)) == 3 and packing.size_of(packing.complete_bins(items, 10)) == 2


def test_rows_without_ids_are_told_apart(spark):
    """Equal rows and null ids gather in no task: places are by task and length."""
    df = spark.createDataFrame([(None, "a b c")] * 3000 + [(1, None)] * 500, "doc_id long, text string").repartition(6)
    rows = packing.pack(packing.pieces(df, tokenizer_file())).collect()
    assert len({r.document for r in rows}) == 3500 and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert check_packing_places(rows) == math.ceil(sum(r.length for r in rows) / 2048)


@pytest.mark.parametrize("seed", range(12))
def test_few_bins(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(1, 20, 11).tolist(), reverse=True)
    plan = packing.complete_bins(Counter(items), 20)
    packed = Counter()
    for pattern, times in plan:
        assert sum(n * m for n, m in pattern) <= 20
        for n, m in pattern:
            packed[n] += m * times
    assert packed == Counter(items)
    assert sum(t for _, t in plan) == fewest(items, 20)


def search_brute(rows, k, step):
    code = lambda e: [x is not None and x > 0 for x in e]
    usable = [(i, code(e)) for i, e in rows if e is not None and len(e) == 64 and i is not None]
    out = []
    for i, c in sorted({(i, tuple(c)) for i, c in usable if i % step == 0}):
        near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), j) for j, d in usable)[:k]
        out += [(i, n, j, dist) for n, (dist, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(500_000, 4_000), (60, 3)])
def test_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(hamming_search, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hamming_search, "CHUNK_QUERIES", blocks[1])
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + 0.6 * rng.standard_normal(64)).tolist()) for i in range(240)]
    rows += [(i, centres[0].tolist()) for i in range(300, 360)]
    rows += [(400, centres[3].tolist())] * 20
    rows += [(500, None), (501, []), (550, [1.0] * 3), (None, centres[1].tolist()), (510, [None, *centres[2].tolist()[1:]]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hamming_search.top_k(df, k=7, query_step=10).collect()))
    assert got == search_brute(rows, 7, 10)


def test_search_small_tables(spark):
    one = spark.createDataFrame([(0, [1.0] * 64), (3, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hamming_search.top_k(one).collect())) == [(0, 1, 0, 0), (0, 2, 3, 64)]
    assert hamming_search.top_k(one.limit(0)).count() == 0


def test_search_by_the_most_frequent_size(spark):
    """The size of whichever row comes first does not decide."""
    rows = [(100, [1.0] * 3), (150, [1.0] * 3), *((i, [1.0 if (i >> b) & 1 else -1.0 for b in range(64)]) for i in range(3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert sorted(map(tuple, hamming_search.top_k(df).collect())) == [(0, 1, 0, 0), (0, 2, 1, 1), (0, 3, 2, 1)]
    tie = spark.createDataFrame([(0, [1.0] * 64), (50, [1.0] * 128)], "vec_id long, embedding array<float>").coalesce(1)
    assert sorted(map(tuple, hamming_search.top_k(tie).collect())) == [(50, 1, 50, 0)]
