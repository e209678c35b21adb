"""Queries against their DuckDB SQL, as the driver compares them."""

import duckdb
import pytest

from tessera.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    expected = con.sql(Q.oracle_sql()[name])
    found = Q.queries()[name](spark, D)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(str(tuple(r[expected.columns.index(c)] for c in columns)) for r in expected.fetchall())
