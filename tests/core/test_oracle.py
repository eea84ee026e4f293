"""Every query with SQL against DuckDB on the same tables; the others must give rows."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalog


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, data, sql, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert ordered(tuple(plain(r[c]) for c in columns) for r in df.collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_gives_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
