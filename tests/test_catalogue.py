"""Every registered engine query against its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from sluicegate.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else v


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    cur = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want and got
