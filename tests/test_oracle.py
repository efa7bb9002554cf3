"""Every core query against its SQL in DuckDB, over whole small tables."""

import math
import os

import duckdb
import pytest

from tessella.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


def cell(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE:
        assert len(rows) > 0
        return
    got = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert sorted(tuple(cell(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
