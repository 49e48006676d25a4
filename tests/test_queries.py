"""Registered queries: every oracle names a query, and results equal DuckDB's on a small scale."""

import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans import oracles, registry, source_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return value.isoformat() if isinstance(value, datetime.datetime) else repr(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


QUERIES, ORACLES = registry.QUERIES | source_queries.QUERIES, oracles.ORACLES | source_queries.ORACLES


def test_names():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark, duck):
    assert entry.entry(spark).count() == 20
