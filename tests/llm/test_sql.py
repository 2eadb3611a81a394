"""The queries of the subpackage that SQL can state, against DuckDB on sf0.001."""

from __future__ import annotations

import glob
from collections import Counter

import duckdb
import pytest

from sparkpul.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = Q.queries()[name](spark, SF)
    want = con.sql(Q.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda r, columns: tuple(r[columns.index(c)] for c in names)
    assert Counter(rows(tuple(r), got.columns) for r in got.collect()) == Counter(rows(r, want.columns) for r in want.fetchall())
