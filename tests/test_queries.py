"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from rowdex.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def rows(table) -> list:
    names = sorted(table.column_names)
    text = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in zip(*(table[c].to_pylist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toArrow(), tables.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want) and got.num_rows > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
