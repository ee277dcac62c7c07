"""The queries that have SQL give its rows."""

import os

import pytest

from evidentia.llm import queries

SMALL = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SMALL}/{table}'")
    found = base.execute(queries.ORACLES[name])
    want = rows_of([c[0] for c in found.description], found.fetchall())
    df = queries.QUERIES[name](spark, SMALL)
    assert rows_of(df.columns, map(tuple, df.collect())) == want and want
