"""Every query with SQL gives what the SQL gives, in values, names and types; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LLM = ("op", "pipeline")
QUERIES = {k: f for k, f in entry.queries().items() if not k.startswith(LLM)}
SQL = entry.oracle_sql()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
#: Its blocks have a single memory each in the smallest tables; test_operators has the cases.
EMPTY_HERE = {"truth_contradictions"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got or name in EMPTY_HERE
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    kinds = dict(df.dtypes)
    assert {c: TYPES[str(t)] for c, t in zip(want.columns, want.types)} == kinds
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
