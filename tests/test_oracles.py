"""Every registered query of the engine against its DuckDB oracle on the smallest tables."""

import datetime

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.8g}") + 0.0
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, small, name):
    got = registry.queries()[name](spark, small)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
