"""The queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    key = lambda r: [(v is None, str(v)) for v in r]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want
