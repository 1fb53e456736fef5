"""Every query of the engine against its SQL on the smallest tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from lexsieve.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{name}") else "")
        c.execute(f"create view {name.partition('.')[0]} as select * from '{path}'")
    return c


def table(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    if name in ORACLE_SQL:
        duck.execute(ORACLE_SQL[name])
        have = [d[0] for d in duck.description]
        assert sorted(have) == names
        assert table(rows) == table(tuple(r[have.index(c)] for c in names) for r in duck.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
