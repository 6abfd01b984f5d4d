"""Every relational query against its SQL on an independent engine."""

import datetime
import decimal

import duckdb
import pytest

from brindle import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    made = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal | datetime.datetime):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    found = oracle.sql(catalog.ORACLE[name])
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    assert sorted(df.columns) == sorted(found.columns)
    other = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    mine = sorted((tuple(plain(r[i]) for i in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in other) for r in found.fetchall()), key=str)
    assert mine == theirs
