"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import registry


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data), sorted(columns)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.collect(), df.columns)
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert got == rows(want.fetchall(), want.columns)
    else:
        assert got[0]
