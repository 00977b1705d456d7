"""Every registered query against its reference SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lymphframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.oracles():
        assert columns and got is not None
        return
    want = db.sql(plans.oracles()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_contract(spark):
    import __spark_entry__ as E

    assert E.oracle_sql().keys() <= E.queries().keys()
    assert E.entry(spark).count() > 0
