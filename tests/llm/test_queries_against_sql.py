"""Registered queries with SQL, compared row by row."""

import duckdb
import pytest

from foldlight.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
