"""Every core query against its SQL in DuckDB, on whole tables."""

import os

import duckdb
import pytest

from quillframe.plans.catalogue import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    types = {c[0]: str(c[1]) for c in found.description}
    assert sorted(df.columns) == sorted(columns)
    assert {n: TYPES[t] for n, t in df.dtypes} == types
    assert _plain(rows, df.columns) == _plain(found.fetchall(), columns)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
