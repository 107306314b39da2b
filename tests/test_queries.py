"""Every query of the engine's own catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusmill.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    return round(value, 8) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    found = QUERIES[name](spark, small)
    wanted = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)
    assert a == b


def test_every_query_without_sql_returns_rows(spark, small):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, small).count() > 0, name


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
