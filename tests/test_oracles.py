"""Every registered query with SQL gives what DuckDB gives; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from cohortflow import queries as panel

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(data) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return ("nan",) if math.isnan(x) else round(x, 5) + 0.0
        return x

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(panel.QUERIES))
def test_query(spark, duck, data, name):
    df = E.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    got, wanted = canonical(df.columns, rows), canonical(columns, want.fetchall())
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert got[1] == wanted[1]


def test_entry(spark):
    assert E.entry(spark).count() > 0
