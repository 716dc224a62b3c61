"""Every query of the retention operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import plans


def value(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, sf_small, name):
    rows = plans.queries()[name](spark, sf_small)
    if name not in plans.oracle_sql():
        assert rows.count() > 0
        return
    con = duckdb.connect()
    for file in os.listdir(sf_small):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_small}/{file}'")
    want = con.sql(plans.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(rows.columns) == order
    at = [want.columns.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(map(value, r)) for r in rows.select(*order).collect()), key=key) == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
