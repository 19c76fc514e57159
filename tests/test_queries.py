"""Every registered query of the library's own operators against its SQL on the small tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lodestrata.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    oracle = registry.oracle_sql().get(name)
    if oracle is None:
        assert got
        return
    result = duck.execute(oracle)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
