"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from fleetlens.workload import all_queries
from fleetlens.workload.registry import ORACLES, QUERIES

all_queries.load()

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cells(row):
    return tuple("NULL" if v is None else repr(v) for v in row)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(cells(r) for r in df.select(*columns).collect())
    result = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    assert got == sorted(cells(r) for r in result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
