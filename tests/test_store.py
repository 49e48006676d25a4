import threading

import pytest
from pyspark.sql import functions as F

from tessera.streaming.store import PARTS, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "session string, v long")


def held(df):
    return sorted((r.session, r.v) for r in df.collect())


def test_replace_and_append(spark, store):
    store.replace(rows(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]), "messages", 0)
    store.replace(rows(spark, [("a", 5)]), "messages", 1)
    store.append(rows(spark, [("b", 6)]), "messages", 2)
    assert held(store.current("messages").filter("session is not null")) == [("a", 5), ("b", 3), ("b", 6)]
    assert store.count("messages") == 4
    assert held(store.current("messages", before=1).filter("session is not null")) == [("a", 1), ("a", 2), ("b", 3)]
    assert sorted(r.batch for r in store.read("messages").collect()) == [0, 0, 0, 0, 1, 2]
    plan = store.current("messages")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_a_batch_that_comes_again_replaces_itself(spark, store):
    store.replace(rows(spark, [("a", 1), ("b", 2)]), "messages", 0)
    for v in (3, 4):
        store.replace(rows(spark, [("a", v)]), "messages", 1)
    assert held(store.current("messages")) == [("a", 4), ("b", 2)]


def test_keys_without_rows_and_whole_tables(spark, store):
    store.replace(rows(spark, [("a", 1), ("b", 2)]), "facts", 0)
    with store.change(1) as change:
        change.replace(rows(spark, []), "facts", rows(spark, [("a", 0)]))
    assert held(store.current("facts")) == [("b", 2)]
    with store.change(2) as change:
        change.overwrite(rows(spark, [("c", 9)]), "facts")
    assert held(store.current("facts")) == [("c", 9)]


def test_a_change_shows_whole_or_not_at_all(spark, store):
    store.replace(rows(spark, [("a", 1)]), "messages", 0)
    with pytest.raises(RuntimeError), store.change(1) as change:
        change.replace(rows(spark, [("a", 2)]), "messages")
        assert held(store.current("messages")) == [("a", 1)]
        raise RuntimeError("lost")
    assert held(store.current("messages")) == [("a", 1)]
    store.replace(rows(spark, [("a", 3)]), "messages", 1)  # the batch comes again
    assert held(store.current("messages")) == [("a", 3)]
    assert store.vacuum(1) > 0 and held(store.current("messages")) == [("a", 3)]


def test_a_task_that_fails_half_way_leaves_nothing(spark, store):
    store.replace(rows(spark, [("a", 1)]), "messages", 0)
    broken = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("session"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.replace(broken, "messages", 1)
    assert held(store.current("messages")) == [("a", 1)]


def test_only_full_buckets_are_rewritten(spark, store):
    for n in range(PARTS + 4):
        store.replace(rows(spark, [("a", n), (f"s{n}", n)]), "messages", n)
    want = [("a", PARTS + 3), *sorted((f"s{n}", n) for n in range(PARTS + 4))]
    assert held(store.current("messages")) == sorted(want)
    parts = store.manifest()["tables"]["messages"]["parts"]
    assert any(p.rewritten for p in parts)
    buckets = [b for p in parts for b in p.buckets]
    assert max(map(buckets.count, buckets)) <= PARTS + 1
    with pytest.raises(ValueError, match="before a rewritten one"):
        store.append(rows(spark, [("x", 1)]), "messages", 0)
    assert store.vacuum() > 0 and held(store.current("messages")) == sorted(want)


def test_writers_beside_each_other(spark, store):
    """Changes of two writers are both kept; two of one batch are not taken for one."""
    store.ensure()
    threads = [threading.Thread(target=lambda n=n: store.append(rows(spark, [(f"s{n}", n)]), "messages", n)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(store.current("messages")) == [(f"s{n}", n) for n in range(4)]
    with pytest.raises(Conflict), store.change(9) as change:
        change.append(rows(spark, [("x", 1)]), "messages")
        Store(spark, store.folder, 4).append(rows(spark, [("y", 1)]), "messages", 9)


def test_other_columns_and_absent_tables(spark, store):
    assert not store.ensure() and store.ensure()
    store.append(rows(spark, [("a", 1)]), "messages", 0)
    with pytest.raises(ValueError, match="other columns"):
        store.append(spark.createDataFrame([("a", "x")], "session string, v string"), "messages", 1)
    with pytest.raises(KeyError):
        store.read("nothing")
    assert store.current("nothing", "a string").count() == 0
    assert store.next_batch() == 1
