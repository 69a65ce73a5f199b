"""The catalogue against its SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import cases, catalogue  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    import glob
    import os

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [df.columns.index(c) for c in order]
    to = [want.columns.index(c) for c in order]
    assert sorted(repr([plain(r[i]) for i in at]) for r in got) == sorted(repr([plain(r[i]) for i in to]) for r in want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
