"""Every registered query against its SQL in DuckDB, on the smallest benchmark tables."""

import glob
import math
import os

import duckdb
import pytest

from shutterlake.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, SF_DIR)
    got = table(df.columns, df.collect())
    if query.sql is None:
        assert got
        return
    cursor = duck.execute(query.sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(columns, cursor.fetchall())
