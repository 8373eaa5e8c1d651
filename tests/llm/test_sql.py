"""The llm queries that SQL can state, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from cohortflow.llm import queries


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in ([*x] for x in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(data) / t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, cells(got.columns, got.collect()))) == sorted(map(repr, cells(columns, want.fetchall())))
