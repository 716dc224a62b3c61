"""Queries of this round against their SQL."""

import duckdb
import pytest

from tidemark.llm import collocations, oddsketch


@pytest.mark.parametrize(("query", "sql"), [(collocations.op11_collocations, collocations.ORACLE_SQL), (oddsketch.op13_odd_sketch, oddsketch.ORACLE_SQL)])
def test_query_equals_its_sql(spark, sf_mid, query, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_mid}/documents.parquet'")
    want = con.sql(sql)
    found = query(spark, sf_mid)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in found.select(*want.columns).collect()) == sorted(want.fetchall())
