import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie
from tessera.llm.queries import QUERIES


def brute(rows, rebuild):
    """A plain recursion over tuples of turns."""
    digest = lambda r: hashlib.sha256(str(len(r[0].encode())).encode() + b":" + r[0].encode() + r[1].encode()).digest()[:16]
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda t: (t[0], digest(t[1])))] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        base = c - int(np.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = [*own.get(base, [])[:h], *turns[h:]] if rebuild and c != base else turns
    members = {}
    for c, turns in convs.items():
        key = ()
        members.setdefault(key, []).append(c)
        for d in range(len(turns)):
            key = hash((key, turns[d])), d
            members.setdefault(key, []).append(c)
    # keys above are hashes of hashes: fine for a test
    nodes, out = {}, []
    for key, held in members.items():
        depth = key[1] + 1 if key else 0
        turns = convs[held[0]]
        nodes[key] = {"depth": depth, "conv": min(held), "n": len(held), "own": (len(held) - 1) * len(turns[depth - 1][1].encode()) if depth else 0, "ends": sorted(c for c in held if len(convs[c]) == depth), "children": [], "up": None}
    for c, turns in convs.items():
        key = ()
        for d in range(len(turns)):
            below = hash((key, turns[d])), d
            if nodes[below]["up"] is None:
                nodes[below]["up"] = key
                nodes[key]["children"].append(below)
            key = below
    for key in sorted(nodes, key=lambda k: -nodes[k]["depth"]):
        n = nodes[key]
        n["leaves"] = sum(nodes[x]["leaves"] for x in n["children"]) or 1
        n["saved"] = n["own"] + sum(nodes[x]["saved"] for x in n["children"])
        up = None if n["up"] is None else nodes[n["up"]]["conv"]
        out.append((n["conv"], n["depth"], up, n["n"], len(n["children"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, rebuild=False, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in prefix_trie.trie(df, rebuild, **more).collect()), key=repr)


def talks(seed=5, convs=60):
    r = np.random.default_rng(seed)
    rows = []
    for c in r.choice(np.arange(-20, 200), convs, replace=False).tolist():
        for t in range(r.integers(1, 9)):
            rows.append((c, t if r.random() < 0.95 else None, [None, "user", "bot"][r.integers(3)], [None, "", "a", "ab", "é"][r.integers(5)]))
    return rows + rows[:7] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("rebuild", [False, True])
def test_equals_brute_force(spark, rebuild):
    rows = talks()
    want = brute(rows, rebuild)
    assert len(want) > 80
    assert found(spark, rows, rebuild) == want


def test_blocks_and_a_hot_conversation(spark):
    """A third of all turns in one conversation, which others follow for hundreds of turns; blocks of seven turns."""
    long = [(0, t, "user", f"turn {t % 3}") for t in range(400)]
    rows = long + [(c, t, "user", f"turn {t % 3}" if t < 37 * c else f"own {c}") for c in range(1, 9) for t in range(37 * c + c % 4)]
    assert found(spark, rows, block=7) == brute(rows, False) == found(spark, rows)


def test_comb(spark, monkeypatch):
    """One branch a turn: rounds are few, since runs are shortened again and again."""
    depth = 60
    rows = [(0, t, "u", f"x{t}") for t in range(depth)] + [(c, t, "u", f"x{t}" if t < c else "out") for c in range(1, depth) for t in range(c + 1)]
    assert found(spark, rows) == brute(rows, False)
    tables, written = [], prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df, name, *a, **k: (tables.append(name), written(df, name, *a, **k))[1])
    found(spark, rows)
    assert tables.count("complete") < 15


def test_copies_and_pieces_of_ids(spark, monkeypatch):
    """A hundred copies end at one node; their ids are hashed in pieces."""
    rows = [(c, t, "u", f"x{t}") for c in range(100) for t in range(3)]
    assert found(spark, rows) == brute(rows, False)


def test_turnless_conversations(spark):
    """A conversation whose base is absent and that has no turns after its opening ends at the root."""
    bare = [c for c in range(1, 300) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:6]
    rows = [(c, t, "u", "x") for c in bare for t in range(2)]
    got = found(spark, rows, rebuild=True)
    assert got == brute(rows, True)
    assert len(got) == 1 and got[0][1] == 0 and got[0][3] == 6


def test_nothing_clashing_columns_and_the_query(spark, tmp_path):
    assert found(spark, []) == []
    rows = talks(9)
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    for name in ("key", "parent", "depth", "position", "place", "part", "digest", "n_bytes", "saved", "waiting"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, True)
