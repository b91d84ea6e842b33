"""The corpus operators' queries against their SQL, value for value, on the smallest tables."""

import os

import duckdb
import pytest

from strandex.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(r[i] for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    r = duck.execute(queries.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())
