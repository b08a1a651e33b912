"""Queries of the subpackage that have SQL against it."""

import duckdb
import pytest

from waymark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))
