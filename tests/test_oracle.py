"""Every report against its SQL in DuckDB: values, types and order of rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from dealflow.reports import REPORTS

FOLDER = TESTDATA / "sf0.01"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(REPORTS) <= set(QUERIES) and set(REPORTS) <= set(SQL)
    assert len(REPORTS) == 54


@pytest.mark.parametrize("name", REPORTS)
def test_same_result(spark, con, name):
    df = QUERIES[name](spark, str(FOLDER))
    result = con.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types

    names = list(types)
    expected = [tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(expected) > 0
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
