"""Every query of the library against its SQL over the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from mnemograph.plans import catalog

from .conftest import SMALL

TABLES = [f.split(".")[0] for f in sorted(os.listdir(SMALL))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    rows = df.collect()
    columns = sorted(df.columns)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert len(columns) == len(set(columns))
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    want = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
